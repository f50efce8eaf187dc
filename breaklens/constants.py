"""Fixed values.

Everything in this module is a value that must equal the behaviour being
matched (domains, weights, thresholds, dictionaries, header aliases). They are
stated plainly and kept together; operators take them as defaults and accept
overrides as parameters.
"""

from __future__ import annotations

# ───────────────────────────── FIXED VALUES ─────────────────────────────

# Asset classes and their codes
VALID_ASSET_CLASSES = ["CEQ", "LnD", "MTN", "OTC"]
ASSET_CLASS_MAP = {"CEQ": 0, "LnD": 1, "MTN": 2, "OTC": 3}
SOURCE_SYSTEM_MAP = {"TLM": 0, "DUCO": 1, "D3S": 2}
BREAK_DIRECTION_MAP = {"Dr": 1, "CR": -1, "Cr": -1, "dr": 1, "cr": -1}
COLLATERAL_TYPE_MAP = {"Cash": 0, "Securities": 1, "Mixed": 2}
TRADE_LIFECYCLE_MAP = {"None": 0, "Novation": 1, "Termination": 2, "Amendment": 3}
SLA_DAYS_BY_AC = {"CEQ": 5, "LnD": 7, "MTN": 10, "OTC": 3}
DEFAULT_SLA_DAYS = 7

# Data-quality weights
DQ_WEIGHTS = {
    "governance_ok": 0.30,
    "age_valid": 0.20,
    "amount_nonzero": 0.20,
    "asset_class_valid": 0.15,
    "no_duplicate": 0.15,
}
DQ_MAX_AGE_DAYS = 3650

# Risk tiers and scoring
DEFAULT_THRESHOLD = 0.80
REVIEW_FLOOR = 0.50
TIER_SUPPRESS, TIER_REVIEW, TIER_ESCALATE, TIER_UNSCORED = (
    "Suppress", "Review", "Escalate", "Unscored")
ANOMALY_MIN_ROWS = 5
ANOMALY_LOW, ANOMALY_HIGH = 0.05, 0.95

# Features
OUTLIER_CUT = 3.5
MAD_EPS = 1e-9
AMOUNT_THRESHOLD_GBP = 1_000_000.0
MONTH_END_DAY = 24
QUARTER_END_MONTHS = [3, 6, 9, 12]
RECENT_AGE_DAYS = 7
MISSING_CATEGORY = "__MISSING__"
UNSEEN_CODE = -1

# Weak labels: (rule, label, confidence), first match wins
LABEL_RULES = [
    ("R01", 1, 0.85),  # rolling_7d_autoclose_rate > 0.80
    ("R02", 1, 0.90),  # offsetting_break_exists
    ("R03", 1, 0.75),  # is_statistical_outlier and break_age_days < 3
    ("R04", 1, 0.80),  # OTC, csa_margin_call_flag, break_age_days < 2
    ("R05", 1, 0.80),  # MTN, coupon_payment_proximity < 3, break_age_days < 3
    ("R06", 1, 0.80),  # CEQ, div_ex_date_proximity < 3, break_age_days < 3
    ("R07", 0, 0.70),  # governance_completeness_score >= 1.0 and age > 90
]
MIN_TRAIN_CONFIDENCE = 0.75

# Training / retraining
MIN_TRAIN_ROWS = 50
MIN_ANALYST_LABELS = 200
AUC_IMPROVEMENT_THRESHOLD = 0.02
GBT_PARAMS = {"max_iter": 300, "max_depth": 6, "step_size": 0.05,
              "subsampling_rate": 0.8, "feature_subset": "0.8",
              "seed": 42}
CV_FOLDS = 5
CV_ITERATIONS = 100
TEST_FRACTION = 0.20
SPLIT_SEED = 42
TOP_FRACTION = 0.10

# Lifecycle (phase 1)
DEFAULT_START = "2025-12-01"
DEFAULT_END = "2026-02-28"
MAX_AGE_DAYS = 90
RECURRING_MIN_DAYS = 1
UNKNOWN_REC_RANK = 999
REC_FLOW_SEPARATOR = " → "
TRADE_KEY_SEPARATOR = "|"

# Rec name → owning system (default dictionary; callers may pass their own)
ROOT_SYSTEM_MAP = {
    "FOBO Rec-Equities": "FOBO",
    "FOBO Rec-Dividend": "FOBO",
    "Fidessa vs Fiscal vs FTP - Cash Equity": "Fidessa",
    "Fidessa vs FTP - Stock/Index Futures": "Fidessa",
    "FLARE vs Fiscal Cash Control (Cash Equities)": "FLARE",
    "FLARE vs HUB Cash Contra (EQD Contra/control)": "FLARE",
    "FLARE vs HUB Cash Contra (L&D)": "FLARE",
    "Flare vs SYN - Cash Equities/SBL Control": "FLARE",
    "Netted Cash Control - Cash equities/SBL": "Netted",
    "CRI COMPTA Rec - Cash Equities/SBL": "COMPTA",
    "CRI COMPTA Rec - SED": "COMPTA",
    "CRI COMPTA Rec - SEF": "COMPTA",
    "Sophis vs FTP - Cash Equity (P&L - MTM & Cash)": "Sophis",
    "Sophis vs FTP - EQD (P&L - MTM & Cash)": "Sophis",
    "Sophis vs FTP - ETD PnL": "Sophis",
    "Sophis vs FTP - FX Spot/Fwd/NDF/FX swap PnL": "Sophis",
    "P&L Rec - CEQ": "P&L",
    "P&L Rec - SED": "P&L",
    "P&L Rec - SEF": "P&L",
    "Washbook '0006 Fiscal account' - Market Charges": "Washbook",
}

# Rec precedence (lower = earlier in the chain; default dictionary)
REC_ORDER = {
    "FOBO Rec-Equities": 1,
    "FOBO Rec-Dividend": 1,
    "Fidessa vs Fiscal vs FTP - Cash Equity": 2,
    "Fidessa vs FTP - Stock/Index Futures": 2,
    "FLARE vs Fiscal Cash Control (Cash Equities)": 3,
    "FLARE vs HUB Cash Contra (EQD Contra/control)": 4,
    "FLARE vs HUB Cash Contra (L&D)": 4,
    "Flare vs SYN - Cash Equities/SBL Control": 5,
    "Netted Cash Control - Cash equities/SBL": 6,
    "CRI COMPTA Rec - Cash Equities/SBL": 7,
    "CRI COMPTA Rec - SED": 7,
    "CRI COMPTA Rec - SEF": 7,
    "Sophis vs FTP - Cash Equity (P&L - MTM & Cash)": 8,
    "Sophis vs FTP - EQD (P&L - MTM & Cash)": 8,
    "Sophis vs FTP - ETD PnL": 8,
    "Sophis vs FTP - FX Spot/Fwd/NDF/FX swap PnL": 8,
    "P&L Rec - CEQ": 9,
    "P&L Rec - SED": 9,
    "P&L Rec - SEF": 9,
    "Washbook '0006 Fiscal account' - Market Charges": 10,
}

REC_NAME_COL = "Rec Name (as per Rec Cube)"

# MI report header aliases (incoming header → canonical name)
COLUMN_ALIASES = {
    "BreakID": "break_id",
    "Break_ID": "break_id",
    "AssetClass": "asset_class",
    "Asset_Class": "asset_class",
    "EntityID": "entity_id",
    "Entity_ID": "entity_id",
    "TeamCode": "team_code",
    "Team_Code": "team_code",
    "RecName": "rec_name",
    "SourceSystem": "source_system",
    "Source_System": "source_system",
    "BreakOpenDate": "break_open_date",
    "Break_Open_Date": "break_open_date",
    "BreakDate": "break_date",
    "Break_Date": "break_date",
    "ReportDate": "report_date",
    "Report_Date": "report_date",
    "LastActivityDate": "last_activity_date",
    "Last_Activity_Date": "last_activity_date",
    "BreakAmount": "break_amount_pence",
    "Break_Amount": "break_amount_pence",
    "NetAmount": "net_amount_pence",
    "GrossAmount": "gross_amount_pence",
    "BreakDirection": "break_direction",
    "Break_Direction": "break_direction",
    "Owner": "owner",
    "Approver": "approver",
    "Status": "status",
    "Counterparty": "counterparty",
    "SLADays": "sla_days",
    "SLA_Days": "sla_days",
}

PENCE_COLUMNS = ["break_amount_pence", "net_amount_pence", "gross_amount_pence"]
DATE_COLUMNS = ["break_open_date", "break_date", "report_date", "last_activity_date"]

# Tokens a CSV reader treats as missing values
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# ─────────────────────── feature order (42, fixed) ───────────────────────
TEMPORAL_FEATURES = [
    "break_age_days", "days_since_last_move",
    "is_month_end_week", "is_quarter_end",
    "rolling_7d_break_count", "rolling_7d_autoclose_rate",
    "time_to_coupon", "time_to_ex_div",
]
FINANCIAL_FEATURES = [
    "break_amount_gbp", "abs_amount_log",
    "amount_vs_threshold_ratio", "amount_percentile",
    "net_vs_gross_diff", "break_direction_enc",
]
ENTITY_FEATURES = [
    "entity_id_enc", "team_code_enc", "rec_name_enc", "asset_class_enc",
    "entity_hist_fp_rate", "rec_hist_fp_rate", "source_system_enc",
]
PATTERN_FEATURES = [
    "offsetting_break_exists", "prior_break_same_cpty",
    "rolling_repeat_break_flag", "mad_score",
    "segment_median_age", "is_statistical_outlier",
]
GOVERNANCE_FEATURES = [
    "owner_populated", "approver_populated", "status_populated",
    "governance_completeness_score", "days_overdue_vs_sla",
    "dq_score",
]
CEQ_FEATURES = ["div_ex_date_proximity", "corporate_action_flag"]
LND_FEATURES = ["collateral_type_enc", "rate_reset_proximity"]
MTN_FEATURES = ["coupon_payment_proximity", "maturity_proximity"]
OTC_FEATURES = ["trade_lifecycle_event_enc", "csa_margin_call_flag", "netting_agreement_flag"]
ASSET_SPECIFIC_FEATURES = CEQ_FEATURES + LND_FEATURES + MTN_FEATURES + OTC_FEATURES

ALL_FEATURES = (TEMPORAL_FEATURES + FINANCIAL_FEATURES + ENTITY_FEATURES
                + PATTERN_FEATURES + GOVERNANCE_FEATURES + ASSET_SPECIFIC_FEATURES)

SEGMENT_KEYS = ["entity_id", "team_code", "rec_name", "asset_class"]
