"""E2 - report -> DQ -> features -> labels over the ``breaks`` fixture, and oracle text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import dq as DQ
from ..operators import features as FT
from ..operators import labels as LB
from ..operators import rowstore as RS
from ..session import release
from ..sources.csv import convert_pence
from ..sources.fixtures import Fixtures


def report(fx: Fixtures, supplied_autoclose: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """The MI report (or the given ``rows`` of it) with GBP columns (S08); optionally with a supplied autoclose rate."""
    b = convert_pence(fx["breaks"] if rows is None else rows)
    if supplied_autoclose:
        b = b.withColumn("rolling_7d_autoclose_rate", F.col("supplied_autoclose_rate"))
    return b


def dq_scored(fx: Fixtures, supplied_autoclose: bool = False, rows: DataFrame | None = None) -> DataFrame:
    return DQ.compute_dq_scores(report(fx, supplied_autoclose, rows))


def features(fx: Fixtures, supplied_autoclose: bool = False, only: list[str] | None = None,
             keep: list[str] | None = None) -> DataFrame:
    """The matrix, or the ``only`` features with the ``keep`` input columns; scored first if that is asked for.

    Scored rows are kept as they come in, before anything is derived from them: all that is read
    again later is that narrow table and what is looked up for its rows.
    """
    scored = only is None or "dq_score" in only
    kept_input = True if keep is None else keep
    if not scored:
        return FT.build_feature_matrix(report(fx, supplied_autoclose), keep_input=kept_input, only=only)
    unread = [] if supplied_autoclose or keep is None else [c for c in ["supplied_autoclose_rate"] if c not in keep]
    rows = RS.keep_rows(fx["breaks"].drop(*unread), "report")
    matrix = FT.build_feature_matrix(dq_scored(fx, supplied_autoclose, rows), keep_input=kept_input, only=only)
    if only is None:  # what was looked up lies beside the rows in a table of its own
        release(rows)
    return matrix


def labelled(fx: Fixtures, supplied_autoclose: bool = False) -> DataFrame:
    """Weak labels: the features that the rules read, and nothing else of the matrix."""
    return LB.label_breaks(features(fx, supplied_autoclose, LB.RULE_FEATURES, ["break_id", "asset_class"]))


def feature_matrix_view(fx: Fixtures) -> DataFrame:
    """break_id + the 42 features; log1p rounded to 9 digits for the value check."""
    f = features(fx, keep=["break_id"])
    return f.select("break_id", *[F.round(F.col(c), 9).alias(c) if c == "abs_amount_log" else F.col(c)
                                  for c in C.ALL_FEATURES])


# ───────────────────────────── oracle text ─────────────────────────────

def _strip(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def dq_ctes() -> str:
    """CTEs ``b`` (report with GBP) and ``dq`` (scored)."""
    gov = " AND ".join(f"{c} IS NOT NULL AND {_strip(c)} <> ''" for c in ("owner", "approver", "status"))
    return f"""
b AS (SELECT *, CAST(break_amount_pence AS DOUBLE) / 100.0 AS break_amount_gbp,
             CAST(net_amount_pence AS DOUBLE) / 100.0 AS net_amount_gbp,
             CAST(gross_amount_pence AS DOUBLE) / 100.0 AS gross_amount_gbp FROM breaks),
dup AS (SELECT break_id, COUNT(*) AS n_same FROM b GROUP BY break_id),
dq0 AS (
  SELECT b.*,
    CASE WHEN {gov} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS dq_governance_ok,
    CASE WHEN date_diff('day', break_open_date, report_date) > 0
          AND date_diff('day', break_open_date, report_date) < 3650 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS dq_age_valid,
    CASE WHEN ABS(COALESCE(b.break_amount_gbp, 0.0)) > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS dq_amount_nonzero,
    CASE WHEN asset_class IN ('CEQ', 'LnD', 'MTN', 'OTC') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS dq_asset_class_valid,
    CASE WHEN dup.n_same = 1 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS dq_no_duplicate
  FROM b LEFT JOIN dup ON b.break_id IS NOT DISTINCT FROM dup.break_id),
dq AS (
  SELECT *, LEAST(GREATEST(dq_governance_ok * CAST(0.3 AS DOUBLE) + dq_age_valid * CAST(0.2 AS DOUBLE)
                           + dq_amount_nonzero * CAST(0.2 AS DOUBLE)
                           + dq_asset_class_valid * CAST(0.15 AS DOUBLE)
                           + dq_no_duplicate * CAST(0.15 AS DOUBLE), 0.0), 1.0) AS dq_score
  FROM dq0)"""


SEG = "entity_id, team_code, rec_name, asset_class"
SEG_NOT_NULL = " AND ".join(f"{k} IS NOT NULL" for k in SEG.split(", "))
SEG_JOIN = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in SEG.split(", "))


def _median_cte(name: str, src: str, value: str) -> str:
    """Exact per-segment median (mean of the two middle values) of ``value``."""
    return f"""
{name} AS (
  SELECT {SEG}, (MAX(CASE WHEN rn = (n - 1) // 2 + 1 THEN v END)
                 + MAX(CASE WHEN rn = n // 2 + 1 THEN v END)) / 2.0 AS med
  FROM (SELECT {SEG}, v, ROW_NUMBER() OVER (PARTITION BY {SEG} ORDER BY v) AS rn,
               COUNT(*) OVER (PARTITION BY {SEG}) AS n
        FROM (SELECT {SEG}, {value} AS v FROM {src} WHERE {SEG_NOT_NULL} AND {value} IS NOT NULL) q) r
  GROUP BY {SEG})"""


def feature_ctes(supplied_autoclose: bool = False) -> str:
    """CTEs ending in ``feat`` (input columns + the 42 features), without leading WITH."""
    autoclose = ("COALESCE(CAST(supplied_autoclose_rate AS DOUBLE), "
                 if supplied_autoclose else "(") + \
        "CASE WHEN COALESCE(f_age, 999) <= 2 THEN 0.85 WHEN COALESCE(f_age, 999) <= 7 THEN 0.40 ELSE 0.10 END)"
    enc = lambda c: (f"CAST(DENSE_RANK() OVER (ORDER BY COALESCE({c}, '__MISSING__')) - 1 AS DOUBLE)")
    return dq_ctes().strip() + f""",
f0 AS (
  SELECT dq.*, CAST(date_diff('day', break_open_date, report_date) AS DOUBLE) AS f_age,
         CAST(date_diff('day', last_activity_date, report_date) AS DOUBLE) AS f_dslm,
         COALESCE(break_amount_gbp, CAST(break_amount_pence AS DOUBLE) / 100.0) AS f_amt
  FROM dq),
r7 AS (SELECT entity_id AS r7_entity, CAST(COUNT(*) AS DOUBLE) AS r7 FROM f0
       WHERE entity_id IS NOT NULL AND COALESCE(f_age, 999) <= 7 GROUP BY entity_id),
cp AS (SELECT counterparty AS cp_cpty, CAST(COUNT(*) - 1 AS DOUBLE) AS cpty_n,
              CASE WHEN ABS(COALESCE(CAST(SUM(CAST(break_amount_gbp AS DECIMAL(28, 4))) AS DOUBLE), 0)) < 1.0
                   THEN 1.0 ELSE 0.0 END AS offs
       FROM f0 WHERE counterparty IS NOT NULL GROUP BY counterparty),
pct AS (
  SELECT asset_class AS pct_ac, v AS pct_v, (CAST(rk - 1 AS DOUBLE) + (c + 1) / 2.0) / n AS amount_percentile
  FROM (SELECT asset_class, v, c, SUM(c) OVER (PARTITION BY asset_class) AS n,
               SUM(c) OVER (PARTITION BY asset_class ORDER BY v) - c + 1 AS rk
        FROM (SELECT asset_class, break_amount_gbp AS v, COUNT(*) AS c FROM f0
              WHERE asset_class IS NOT NULL AND break_amount_gbp IS NOT NULL
              GROUP BY asset_class, break_amount_gbp) g) q),
ax AS (SELECT f0.*, ABS(break_amount_gbp) AS a_abs FROM f0),
{_median_cte("med1", "ax", "a_abs").strip()},
ax2 AS (SELECT ax.*, med1.med AS m1, ABS(ax.a_abs - med1.med) AS dev
        FROM ax LEFT JOIN med1 ON {SEG_JOIN("ax", "med1")}),
{_median_cte("med2", "ax2", "dev").strip()},
{_median_cte("medage", "f0", "f_age").strip()},
g AS (
  SELECT ax2.*, ABS((ax2.a_abs - ax2.m1) / (med2.med + 1e-9)) AS f_mad, medage.med AS f_segage
  FROM ax2 LEFT JOIN med2 ON {SEG_JOIN("ax2", "med2")}
  LEFT JOIN medage ON {SEG_JOIN("ax2", "medage")}),
feat AS (
  SELECT g.*,
    f_age AS break_age_days,
    f_dslm AS days_since_last_move,
    CASE WHEN dayofmonth(report_date) >= 24 THEN 1.0 ELSE 0.0 END AS is_month_end_week,
    CASE WHEN month(report_date) IN (3, 6, 9, 12) AND dayofmonth(report_date) >= 24 THEN 1.0 ELSE 0.0 END
      AS is_quarter_end,
    COALESCE(r7.r7, 1.0) AS rolling_7d_break_count,
    {autoclose} AS rolling_7d_autoclose_rate,
    CAST(NULL AS DOUBLE) AS time_to_coupon,
    CAST(NULL AS DOUBLE) AS time_to_ex_div,
    f_amt AS f_break_amount_gbp,
    ROUND(ln(1 + ABS(f_amt)), 9) AS abs_amount_log,
    f_amt / 1000000.0 AS amount_vs_threshold_ratio,
    pct.amount_percentile AS amount_percentile,
    ABS(net_amount_gbp - gross_amount_gbp) AS net_vs_gross_diff,
    CAST(CASE break_direction WHEN 'Dr' THEN 1 WHEN 'CR' THEN -1 WHEN 'Cr' THEN -1 WHEN 'dr' THEN 1
              WHEN 'cr' THEN -1 ELSE 0 END AS DOUBLE) AS break_direction_enc,
    {enc("entity_id")} AS entity_id_enc,
    {enc("team_code")} AS team_code_enc,
    {enc("rec_name")} AS rec_name_enc,
    CAST(CASE asset_class WHEN 'CEQ' THEN 0 WHEN 'LnD' THEN 1 WHEN 'MTN' THEN 2 WHEN 'OTC' THEN 3 END AS DOUBLE)
      AS asset_class_enc,
    0.0 AS entity_hist_fp_rate,
    0.0 AS rec_hist_fp_rate,
    CAST(CASE source_system WHEN 'TLM' THEN 0 WHEN 'DUCO' THEN 1 WHEN 'D3S' THEN 2 ELSE -1 END AS DOUBLE)
      AS source_system_enc,
    COALESCE(cp.offs, 0.0) AS offsetting_break_exists,
    cp.cpty_n AS prior_break_same_cpty,
    0.0 AS rolling_repeat_break_flag,
    f_mad AS mad_score,
    f_segage AS segment_median_age,
    CASE WHEN COALESCE(f_mad, 0.0) > 3.5 THEN 1.0 ELSE 0.0 END AS is_statistical_outlier,
    CASE WHEN owner IS NOT NULL THEN 1.0 ELSE 0.0 END AS owner_populated,
    CASE WHEN approver IS NOT NULL THEN 1.0 ELSE 0.0 END AS approver_populated,
    CASE WHEN status IS NOT NULL THEN 1.0 ELSE 0.0 END AS status_populated,
    ((CASE WHEN owner IS NOT NULL THEN 1.0 ELSE 0.0 END) + (CASE WHEN approver IS NOT NULL THEN 1.0 ELSE 0.0 END)
      + (CASE WHEN status IS NOT NULL THEN 1.0 ELSE 0.0 END)) / 3.0 AS governance_completeness_score,
    GREATEST(COALESCE(f_age, 0.0) - CAST(CASE asset_class WHEN 'CEQ' THEN 5 WHEN 'LnD' THEN 7 WHEN 'MTN' THEN 10
                                           WHEN 'OTC' THEN 3 ELSE 7 END AS DOUBLE), 0.0) AS days_overdue_vs_sla,
    CASE WHEN asset_class = 'CEQ' THEN CAST(div_ex_date_proximity AS DOUBLE) END AS f_div_ex_date_proximity,
    CASE WHEN asset_class = 'CEQ' THEN 0.0 END AS corporate_action_flag,
    CASE WHEN asset_class = 'LnD' THEN -1.0 END AS collateral_type_enc,
    CASE WHEN asset_class = 'LnD' THEN CAST(NULL AS DOUBLE) END AS rate_reset_proximity,
    CASE WHEN asset_class = 'MTN' THEN CAST(coupon_payment_proximity AS DOUBLE) END AS f_coupon_payment_proximity,
    CASE WHEN asset_class = 'MTN' THEN CAST(NULL AS DOUBLE) END AS maturity_proximity,
    CASE WHEN asset_class = 'OTC' THEN 0.0 END AS trade_lifecycle_event_enc,
    CASE WHEN asset_class = 'OTC' THEN COALESCE(CAST(csa_margin_call_flag AS DOUBLE), 0.0) END AS f_csa_margin_call_flag,
    CASE WHEN asset_class = 'OTC' THEN 0.0 END AS netting_agreement_flag
  FROM g LEFT JOIN r7 ON g.entity_id = r7.r7_entity
  LEFT JOIN cp ON g.counterparty = cp.cp_cpty
  LEFT JOIN pct ON g.asset_class = pct.pct_ac AND g.break_amount_gbp = pct.pct_v)"""


# features whose oracle column carries an ``f_`` prefix (the input column has the bare name)
_PREFIXED = {"break_amount_gbp", "div_ex_date_proximity", "coupon_payment_proximity",
             "csa_margin_call_flag"}


def feature_select(prefix: str = "") -> str:
    cols = []
    for c in C.ALL_FEATURES:
        src = f"f_{c}" if c in _PREFIXED else c
        cols.append(f"CAST({prefix}{src} AS DOUBLE) AS {c}")
    return ", ".join(cols)


def label_case(prefix: str = "") -> str:
    """Weak-label CASE chains over ``feat`` (first match wins)."""
    p = prefix
    ac = f"COALESCE({p}asset_class, '')"
    conds = [
        f"{p}rolling_7d_autoclose_rate > 0.80",
        f"COALESCE({p}offsetting_break_exists, 0) <> 0",
        f"COALESCE({p}is_statistical_outlier, 0) <> 0 AND {p}break_age_days < 3",
        f"COALESCE({p}f_csa_margin_call_flag, 0) <> 0 AND {p}break_age_days < 2 AND {ac} = 'OTC'",
        f"{p}f_coupon_payment_proximity < 3 AND {p}break_age_days < 3 AND {ac} = 'MTN'",
        f"{p}f_div_ex_date_proximity < 3 AND {p}break_age_days < 3 AND {ac} = 'CEQ'",
        f"{p}governance_completeness_score >= 1.0 AND {p}break_age_days > 90",
    ]
    lbl = " ".join(f"WHEN {c} THEN {r[1]}" for c, r in zip(conds, C.LABEL_RULES))
    conf = " ".join(f"WHEN {c} THEN {r[2]}" for c, r in zip(conds, C.LABEL_RULES))
    rule = " ".join(f"WHEN {c} THEN '{r[0]}'" for c, r in zip(conds, C.LABEL_RULES))
    return (f"CAST(CASE {lbl} END AS INTEGER) AS pseudo_label, "
            f"CAST(CASE {conf} END AS DOUBLE) AS label_confidence, CASE {rule} END AS label_rule")
