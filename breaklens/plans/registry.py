"""Registered queries (one per inventory operator) and their DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the whole
fixture views of the driver tables. ``ORACLE[name]`` is independent SQL text
(fixture views as CTEs) for the same result. Operators that SQL cannot
express (random / iterative ML) have no oracle and are checked by properties
in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import reports as R
from ..session import scratch_path
from ..sources.csv import csv_records
from ..sources.fixtures import Fixtures, table, with_views
from . import lifecycle_plan as LP

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: list[str] | None = None):
    def deco(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = with_views(sql, views or [])
        return fn
    return deco


P1_VIEWS = ["rec_dim", "cash", "mi"]


def _p1(body: str, start=LP.FULL_START, end=LP.FULL_END) -> str:
    return "WITH " + LP.summary_ctes(start, end).strip() + "\n" + body


# ───────────────────────────── sources ─────────────────────────────

@register("s01_csv_scan", """
SELECT doc_id, source, CAST(LENGTH(text) AS BIGINT) AS n_chars, MD5(text) AS text_md5 FROM documents""")
def s01_csv_scan(fx):
    """All documents, whose texts hold quotes and line breaks, written as CSV and scanned in splits."""
    path = scratch_path(fx.spark, "csv")
    docs = table(fx.spark, fx.sf_dir, "documents").select("doc_id", "source", "text")
    docs.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return csv_records(fx.spark, path).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.length("text").cast("bigint").alias("n_chars"),
        F.md5("text").alias("text_md5"))


# ───────────────────────────── lifecycle (P1) ─────────────────────────────

@register("f01_std_cash", f"SELECT * FROM ({LP.cash_std_sql()}) s", ["cash"])
def f01_std_cash(fx):
    """typed cash breaks."""
    return LP.std_cash(fx)


@register("f02_std_mi", f"SELECT * FROM ({LP.mi_std_sql()}) s", ["rec_dim", "mi"])
def f02_std_mi(fx):
    """typed MI rows."""
    return LP.std_mi(fx)


@register("f03_date_range",
          f"SELECT * FROM ({LP.cash_std_sql()}) s WHERE \"Date\" >= TIMESTAMP '{LP.WINDOW_START}' "
          f"AND \"Date\" <= TIMESTAMP '{LP.WINDOW_END}'", ["cash"])
def f03_date_range(fx):
    """inclusive date window on the cash breaks."""
    return L.filter_date_range(LP.std_cash(fx), "Date", LP.WINDOW_START, LP.WINDOW_END)


@register("f04_age_cap", f"SELECT * FROM ({LP.mi_std_sql()}) s WHERE \"Age Days\" <= 90",
          ["rec_dim", "mi"])
def f04_age_cap(fx):
    """MI rows with age <= 90 days."""
    return L.cap_age(LP.std_mi(fx))


@register("w01_break_chains", _p1("""
SELECT s."Date", s."TRADE_ID", s."PRODUCT", s."BREAK", s."PRODUCT" || '|' || s."TRADE_ID" AS "TradeKey",
       c."BreakChainID"
FROM cash_f s JOIN chains c ON s."PRODUCT" = c."Product" AND s."TRADE_ID" = c."Trade"
"""), P1_VIEWS)
def w01_break_chains(fx):
    """F05 + W01: cash rows with TradeKey and BreakChainID."""
    cash, _ = LP.filtered_inputs(fx)
    return L.build_break_chains(cash)


@register("a01_chain_summary", _p1("SELECT * FROM chains"), P1_VIEWS)
def a01_chain_summary(fx):
    """One row per chain."""
    return LP.chain_summary(fx)


@register("a02_rec_flow", _p1('SELECT "TRADE REF", "Rec_Flow" FROM info'), P1_VIEWS)
def a02_rec_flow(fx):
    """A02 + U01 + W09: ordered, de-duplicated rec flow per trade."""
    return LP.trade_info(fx).select("TRADE REF", "Rec_Flow")


@register("a03_root_rec", _p1('SELECT "TRADE REF", "Root_Rec" FROM info'), P1_VIEWS)
def a03_root_rec(fx):
    """First rec per trade."""
    return LP.trade_info(fx).select("TRADE REF", "Root_Rec")


@register("a04_journal_flag", _p1('SELECT "TRADE REF", "Journal_Used" FROM info'), P1_VIEWS)
def a04_journal_flag(fx):
    """Any journal posted per trade."""
    return LP.trade_info(fx).select("TRADE REF", "Journal_Used")


@register("j06_rec_rank_lookup", _p1("""
SELECT "TRADE REF", "Rec", first_d AS "First_Date", rk AS "Rec_Rank" FROM per_rec
"""), P1_VIEWS)
def j06_rec_rank_lookup(fx):
    """Rec -> precedence rank (default 999) per (trade, rec)."""
    _, mi = LP.filtered_inputs(fx)
    per_rec = mi.groupBy("TRADE REF", "Rec").agg(F.min("Date").alias("First_Date"))
    dim = LP.rec_order(fx).toDF("__rec", "__rank")
    j = per_rec.join(dim, per_rec["Rec"] == dim["__rec"], "left")
    return j.select("TRADE REF", "Rec", "First_Date",
                    F.coalesce(dim["__rank"].cast("int"), F.lit(999)).alias("Rec_Rank"))


@register("j01_final_summary", _p1("SELECT * FROM summary"), P1_VIEWS)
def j01_final_summary(fx):
    """Chains joined to trade info, False_Closure, Root_System."""
    return LP.final_summary(fx)


@register("j02_root_system_map", _p1('SELECT DISTINCT "Root_Rec", "Root_System" FROM summary'),
          P1_VIEWS)
def j02_root_system_map(fx):
    """Root rec -> root system (dictionary, else first word)."""
    return LP.final_summary(fx).select("Root_Rec", "Root_System").distinct()


@register("a05_p1_kpis", _p1("""
SELECT COUNT(*) AS total_chains, COUNT_IF("Is_Recurring") AS is_recurring,
       COUNT_IF("Journal_Used") AS journal_used, COUNT_IF("False_Closure") AS false_closure,
       CAST(SUM(CAST("Total_Amount" AS DECIMAL(28, 4))) AS DOUBLE) AS total_amount,
       ROUND_EVEN(CASE WHEN COUNT(*) > 0 THEN COUNT_IF("Is_Recurring") * 100.0 / COUNT(*) END, 1) AS is_recurring_pct,
       ROUND_EVEN(CASE WHEN COUNT(*) > 0 THEN COUNT_IF("Journal_Used") * 100.0 / COUNT(*) END, 1) AS journal_used_pct,
       ROUND_EVEN(CASE WHEN COUNT(*) > 0 THEN COUNT_IF("False_Closure") * 100.0 / COUNT(*) END, 1) AS false_closure_pct
FROM summary
"""), P1_VIEWS)
def a05_p1_kpis(fx):
    """Lifecycle KPIs (one row)."""
    return R.p1_kpis(LP.final_summary(fx, with_ids=False))


@register("a06_root_system_top", _p1("""
SELECT "Root_System", COUNT("BreakChainID") AS "Total_Chains", COUNT_IF("False_Closure") AS "False_Closures"
FROM summary WHERE "Root_System" IS NOT NULL GROUP BY "Root_System"
ORDER BY "Total_Chains" DESC, "Root_System" LIMIT 10
"""), P1_VIEWS)
def a06_root_system_top(fx):
    """A06 + T03: top-10 root systems by chains."""
    return R.root_system_top(LP.final_summary(fx, with_ids=False))


@register("a07_root_system_full", _p1("""
SELECT COALESCE("Root_System", 'Unknown') AS "Root_System", COUNT("BreakChainID") AS "Total_Chains",
       COUNT_IF("False_Closure") AS "False_Closures", COUNT_IF("Is_Recurring") AS "Recurring",
       COUNT_IF("Journal_Used") AS "Journal_Used",
       CAST(SUM(CAST("Total_Amount" AS DECIMAL(28, 4))) AS DOUBLE) AS "Total_Amount",
       ROUND_EVEN(COUNT_IF("False_Closure") * 100.0 / GREATEST(COUNT("BreakChainID"), 1), 1) AS "FC_Rate"
FROM summary GROUP BY "Root_System"
"""), P1_VIEWS)
def a07_root_system_full(fx):
    """Root-system analysis incl. Unknown and FC_Rate."""
    return R.root_system_full(LP.final_summary(fx, with_ids=False))


@register("a13_days_active_hist", _p1("""
, fc AS (SELECT "Days_Active" AS x FROM summary WHERE "False_Closure"),
mm AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM fc),
b AS (SELECT CAST(CASE WHEN mm.hi > mm.lo THEN LEAST(FLOOR((fc.x - mm.lo) * 20 / CAST(mm.hi - mm.lo AS DOUBLE)), 19)
                  ELSE 0 END AS INTEGER) AS bin, mm.lo, mm.hi FROM fc, mm)
SELECT bin, CAST(lo AS DOUBLE) + bin * (CAST(hi - lo AS DOUBLE) / 20) AS bin_start,
       CAST(lo AS DOUBLE) + (bin + 1) * (CAST(hi - lo AS DOUBLE) / 20) AS bin_end, COUNT(*) AS chains
FROM b GROUP BY bin, lo, hi
"""), P1_VIEWS)
def a13_days_active_hist(fx):
    """20-bin histogram of Days_Active over false closures."""
    return R.days_active_hist(LP.final_summary(fx, with_ids=False))


@register("t01_top_false_closures_cli", _p1("""
SELECT "Trade", "Product", "Days_Active", "Rec_Flow", "Root_Rec" FROM summary WHERE "False_Closure"
ORDER BY "Days_Active" DESC, "BreakChainID" LIMIT 10
"""), P1_VIEWS)
def t01_top_false_closures_cli(fx):
    """Top-10 false closures (5 columns)."""
    return R.top_false_closures(LP.final_summary(fx), 10, R.CLI_TOP_COLUMNS)


@register("t02_top_false_closures_ui", _p1("""
SELECT "Trade", "Product", "Days_Active", "Total_Breaks", "Total_Amount", "Root_System", "Root_Rec", "Rec_Flow"
FROM summary WHERE "False_Closure" ORDER BY "Days_Active" DESC, "BreakChainID" LIMIT 20
"""), P1_VIEWS)
def t02_top_false_closures_ui(fx):
    """Top-20 false closures (8 columns)."""
    return R.top_false_closures(LP.final_summary(fx), 20, R.UI_TOP_COLUMNS)


@register("f08_recurring_only", _p1('SELECT * FROM summary WHERE "Is_Recurring"'), P1_VIEWS)
def f08_recurring_only(fx):
    """recurring chains only."""
    return R.flag_filter(LP.final_summary(fx), recurring_only=True)


@register("f08_false_closure_only", _p1('SELECT * FROM summary WHERE "False_Closure"'), P1_VIEWS)
def f08_false_closure_only(fx):
    """false-closure chains only."""
    return R.flag_filter(LP.final_summary(fx), false_closure_only=True)


@register("f09_display_projection", _p1("""
SELECT "Trade", "Product", "Start_Date", "End_Date", "Days_Active", "Total_Breaks", "Total_Amount",
       "Is_Recurring", "Root_System", "Root_Rec", "Rec_Flow", "Journal_Used", "False_Closure", "BreakChainID"
FROM summary
"""), P1_VIEWS)
def f09_display_projection(fx):
    """display column subset of the final summary."""
    return R.display_projection(LP.final_summary(fx))


# ───────────────────────────── DQ / features / labels (P2) ─────────────────────────────
from .. import constants as C  # noqa: E402
from ..operators import dq as DQ  # noqa: E402
from ..operators import encoders as ENC  # noqa: E402
from ..operators import features as FT  # noqa: E402
from ..operators import labels as LB  # noqa: E402
from ..sources.csv import convert_pence  # noqa: E402
from . import scoring_plan as SP  # noqa: E402

BREAK_VIEWS = ["breaks"]


def _dq(body: str) -> str:
    return "WITH " + SP.dq_ctes().strip() + "\n" + body


def _feat(body: str, supplied: bool = False) -> str:
    return "WITH " + SP.feature_ctes(supplied).strip() + "\n" + body


@register("s08_pence_to_gbp", """
SELECT break_id, break_amount_pence, net_amount_pence, gross_amount_pence,
       CAST(break_amount_pence AS DOUBLE) / 100.0 AS break_amount_gbp,
       CAST(net_amount_pence AS DOUBLE) / 100.0 AS net_amount_gbp,
       CAST(gross_amount_pence AS DOUBLE) / 100.0 AS gross_amount_gbp
FROM breaks""", BREAK_VIEWS)
def s08_pence_to_gbp(fx):
    """Pence columns -> GBP columns (originals kept)."""
    return convert_pence(fx["breaks"]).select(
        "break_id", *C.PENCE_COLUMNS, *[c.replace("_pence", "_gbp") for c in C.PENCE_COLUMNS])


@register("q06_dq_score", _dq("""
SELECT break_id, asset_class, dq_governance_ok, dq_age_valid, dq_amount_nonzero, dq_asset_class_valid,
       dq_no_duplicate, dq_score FROM dq"""), BREAK_VIEWS)
def q06_dq_score(fx):
    """Q01-Q06: DQ components and weighted score per break."""
    return SP.dq_scored(fx).select("break_id", "asset_class", *DQ.COMPONENTS, "dq_score")


@register("w06_duplicate_flag", _dq("SELECT break_id, dq_no_duplicate FROM dq"), BREAK_VIEWS)
def w06_duplicate_flag(fx):
    """1.0 when the break id is unique in the report."""
    return SP.dq_scored(fx).select("break_id", "dq_no_duplicate")


@register("a10_dq_summary", _dq("""
SELECT asset_class, ROUND_EVEN(AVG(dq_score), 4) AS mean_dq_score, COUNT(*) AS "rows",
       ROUND_EVEN(AVG(dq_governance_ok), 4) AS dq_governance_ok, ROUND_EVEN(AVG(dq_age_valid), 4) AS dq_age_valid,
       ROUND_EVEN(AVG(dq_amount_nonzero), 4) AS dq_amount_nonzero,
       ROUND_EVEN(AVG(dq_asset_class_valid), 4) AS dq_asset_class_valid,
       ROUND_EVEN(AVG(dq_no_duplicate), 4) AS dq_no_duplicate
FROM dq WHERE asset_class IS NOT NULL GROUP BY asset_class
UNION ALL
SELECT 'OVERALL', ROUND_EVEN(AVG(dq_score), 4), COUNT(*), ROUND_EVEN(AVG(dq_governance_ok), 4),
       ROUND_EVEN(AVG(dq_age_valid), 4), ROUND_EVEN(AVG(dq_amount_nonzero), 4),
       ROUND_EVEN(AVG(dq_asset_class_valid), 4), ROUND_EVEN(AVG(dq_no_duplicate), 4)
FROM dq"""), BREAK_VIEWS)
def a10_dq_summary(fx):
    """A10: DQ summary per asset class and OVERALL."""
    return DQ.dq_summary(SP.dq_scored(fx))


@register("x_feature_matrix", _feat(f"SELECT break_id, {SP.feature_select()} FROM feat"), BREAK_VIEWS)
def x_feature_matrix(fx):
    """The 42-feature matrix keyed by break id."""
    return SP.feature_matrix_view(fx)


@register("w02_amount_percentile", _feat("""
SELECT break_id, asset_class, break_amount_gbp, amount_percentile FROM feat"""), BREAK_VIEWS)
def w02_amount_percentile(fx):
    """Average-rank percentile of the amount within asset class."""
    return SP.features(fx, only=["break_amount_gbp", "amount_percentile"], keep=["break_id", "asset_class"])


@register("w03_same_cpty_count", _feat("""
SELECT break_id, counterparty, prior_break_same_cpty FROM feat"""), BREAK_VIEWS)
def w03_same_cpty_count(fx):
    """Other breaks with the same counterparty."""
    return SP.features(fx, only=["prior_break_same_cpty"], keep=["break_id", "counterparty"])


@register("j03_offsetting_semi", _feat("""
SELECT break_id, counterparty, offsetting_break_exists FROM feat"""), BREAK_VIEWS)
def j03_offsetting_semi(fx):
    """Counterparty nets to (almost) zero."""
    return SP.features(fx, only=["offsetting_break_exists"], keep=["break_id", "counterparty"])


@register("w04_segment_median_age", _feat("""
SELECT break_id, entity_id, team_code, rec_name, asset_class, segment_median_age FROM feat"""), BREAK_VIEWS)
def w04_segment_median_age(fx):
    """Exact median age per (entity, team, rec, class) segment."""
    return SP.features(fx, only=["segment_median_age"], keep=["break_id", *C.SEGMENT_KEYS])


@register("w05_mad_score", _feat("""
SELECT break_id, mad_score, is_statistical_outlier FROM feat"""), BREAK_VIEWS)
def w05_mad_score(fx):
    """W05 + X27: MAD score per segment and the outlier flag."""
    return SP.features(fx, only=["mad_score", "is_statistical_outlier"], keep=["break_id"])


@register("w07_rolling_7d_count", _feat("""
SELECT break_id, entity_id, rolling_7d_break_count FROM feat"""), BREAK_VIEWS)
def w07_rolling_7d_count(fx):
    """W07 + J04: per-entity recent-break count (default 1)."""
    return SP.features(fx, only=["rolling_7d_break_count"], keep=["break_id", "entity_id"])


@register("w08_category_codes", """
SELECT 'entity_id' AS feature, value, DENSE_RANK() OVER (ORDER BY value) - 1 AS code
FROM (SELECT DISTINCT COALESCE(entity_id, '__MISSING__') AS value FROM breaks) e
UNION ALL
SELECT 'team_code', value, DENSE_RANK() OVER (ORDER BY value) - 1
FROM (SELECT DISTINCT COALESCE(team_code, '__MISSING__') AS value FROM breaks) t
UNION ALL
SELECT 'rec_name', value, DENSE_RANK() OVER (ORDER BY value) - 1
FROM (SELECT DISTINCT COALESCE(rec_name, '__MISSING__') AS value FROM breaks) r""", BREAK_VIEWS)
def w08_category_codes(fx):
    """Category dictionaries (sorted distinct values -> 0..n-1)."""
    b = fx["breaks"]
    out = None
    for c in ("entity_id", "team_code", "rec_name"):
        d = FT.category_dictionary(b, c).select(F.lit(c).alias("feature"), "value", "code")
        out = d if out is None else out.unionByName(d)
    return out


@register("j05_encoder_lookup", """
WITH d AS (SELECT value, DENSE_RANK() OVER (ORDER BY value) - 1 AS code
           FROM (SELECT DISTINCT COALESCE(entity_id, '__MISSING__') AS value FROM breaks
                 WHERE asset_class = 'CEQ') q)
SELECT b.break_id, b.entity_id, CAST(COALESCE(d.code, -1) AS DOUBLE) AS entity_id_enc
FROM breaks b LEFT JOIN d ON COALESCE(b.entity_id, '__MISSING__') = d.value""", BREAK_VIEWS)
def j05_encoder_lookup(fx):
    """Apply an encoder fitted on one subset (CEQ rows) to every row; unseen -> -1."""
    b = fx["breaks"]
    enc = FT.category_dictionary(b.where(F.col("asset_class") == "CEQ"), "entity_id")
    return FT.apply_dictionary(b, "entity_id", enc, "entity_id_enc").select(
        "break_id", "entity_id", "entity_id_enc")


@register("j05_encoder_versions", """
WITH old AS (SELECT value, DENSE_RANK() OVER (ORDER BY value) - 1 AS code
             FROM (SELECT DISTINCT COALESCE(counterparty, '__MISSING__') AS value FROM breaks
                   WHERE asset_class = 'CEQ' AND break_amount_pence < 0) q),
new AS (SELECT value, (SELECT COUNT(*) FROM old) + DENSE_RANK() OVER (ORDER BY value) - 1 AS code
        FROM (SELECT DISTINCT COALESCE(counterparty, '__MISSING__') AS value FROM breaks) q
        WHERE value NOT IN (SELECT value FROM old)),
grown AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT b.break_id, b.counterparty, CAST(COALESCE(o.code, -1) AS DOUBLE) AS old_code, CAST(g.code AS DOUBLE) AS grown_code
FROM breaks b LEFT JOIN old o ON COALESCE(b.counterparty, '__MISSING__') = o.value
LEFT JOIN grown g ON COALESCE(b.counterparty, '__MISSING__') = g.value""", BREAK_VIEWS)
def j05_encoder_versions(fx):
    """Encoders of one subset stored, read back, grown by all rows and stored again."""
    b = fx["breaks"]
    folder = scratch_path(fx.spark, "encoders")
    part = b.where((F.col("asset_class") == "CEQ") & (F.col("break_amount_pence") < 0))
    ENC.save_encoders(ENC.fit_encoders(part, ["counterparty"]), f"{folder}/v=1")
    old = ENC.load_encoders(fx.spark, f"{folder}/v=1")
    ENC.save_encoders(ENC.extend_encoders(old, b, ["counterparty"]), f"{folder}/v=2")
    grown = ENC.load_encoders(fx.spark, f"{folder}/v=2")
    rows = b.select("break_id", "counterparty")
    coded = ENC.apply_encoders(rows, old, ["counterparty"]).withColumnRenamed("counterparty_enc", "old_code")
    return ENC.apply_encoders(coded, grown, ["counterparty"]).withColumnRenamed("counterparty_enc", "grown_code")


_BY_CLASS = ["rolling_7d_break_count", "entity_id_enc", "team_code_enc", "rec_name_enc",
             "offsetting_break_exists", "prior_break_same_cpty"]


@register("x_features_by_class", _feat("""
, scoped AS (SELECT f.*, COALESCE(e, '__MISSING__') AS ve, COALESCE(t, '__MISSING__') AS vt, COALESCE(r, '__MISSING__') AS vr
             FROM (SELECT break_id, asset_class, entity_id AS e, team_code AS t, rec_name AS r, counterparty,
                          f_amt, f_age FROM f0) f),
recent AS (SELECT asset_class, e, CAST(COUNT(*) AS DOUBLE) AS n FROM scoped
           WHERE e IS NOT NULL AND COALESCE(f_age, 999.0) <= 7 GROUP BY 1, 2),
netting AS (SELECT asset_class, counterparty, CAST(COUNT(*) - 1 AS DOUBLE) AS others,
              CASE WHEN ABS(COALESCE(CAST(SUM(CAST(f_amt AS DECIMAL(28,4))) AS DOUBLE), 0.0)) < 1.0 THEN 1.0 ELSE 0.0 END AS nets
       FROM scoped WHERE counterparty IS NOT NULL GROUP BY 1, 2)
SELECT s.break_id, s.asset_class, COALESCE(recent.n, 1.0) AS rolling_7d_break_count,
       CASE WHEN s.asset_class IS NOT NULL THEN CAST(DENSE_RANK() OVER (PARTITION BY s.asset_class ORDER BY ve) - 1 AS DOUBLE) END AS entity_id_enc,
       CASE WHEN s.asset_class IS NOT NULL THEN CAST(DENSE_RANK() OVER (PARTITION BY s.asset_class ORDER BY vt) - 1 AS DOUBLE) END AS team_code_enc,
       CASE WHEN s.asset_class IS NOT NULL THEN CAST(DENSE_RANK() OVER (PARTITION BY s.asset_class ORDER BY vr) - 1 AS DOUBLE) END AS rec_name_enc,
       COALESCE(netting.nets, 0.0) AS offsetting_break_exists, netting.others AS prior_break_same_cpty
FROM scoped s LEFT JOIN recent ON recent.asset_class = s.asset_class AND recent.e = s.e
LEFT JOIN netting ON netting.asset_class = s.asset_class AND netting.counterparty = s.counterparty"""), BREAK_VIEWS)
def x_features_by_class(fx):
    """X05, X15-X17, X22, X23 with each class as its own scope, as K03 scores them."""
    return FT.build_feature_matrix(SP.report(fx), keep_input=["break_id", "asset_class"], only=_BY_CLASS,
                                   scope=["asset_class"])


@register("l_weak_labels", _feat(f"SELECT break_id, asset_class, {SP.label_case()} FROM feat"),
          BREAK_VIEWS)
def l_weak_labels(fx):
    """L01-L08 with the derived autoclose proxy."""
    return SP.labelled(fx).select("break_id", "asset_class", "pseudo_label", "label_confidence",
                                  "label_rule")


@register("l_weak_labels_supplied",
          _feat(f"SELECT break_id, asset_class, {SP.label_case()} FROM feat", supplied=True), BREAK_VIEWS)
def l_weak_labels_supplied(fx):
    """L01-L08 with a supplied autoclose rate (rules L03-L06 reachable)."""
    return SP.labelled(fx, True).select("break_id", "asset_class", "pseudo_label", "label_confidence",
                                        "label_rule")


_LBL2 = f"lab AS (SELECT feat.*, {SP.label_case()} FROM feat)"


@register("f10_training_filter", _feat(f""", {_LBL2}
SELECT break_id, asset_class, pseudo_label, label_confidence FROM lab
WHERE pseudo_label IS NOT NULL AND COALESCE(label_confidence, 0) >= 0.75""", supplied=True), BREAK_VIEWS)
def f10_training_filter(fx):
    """labelled rows with confidence >= 0.75."""
    return LB.get_training_set(SP.labelled(fx, True)).select(
        "break_id", "asset_class", "pseudo_label", "label_confidence")


@register("f11_asset_class_filter", _feat(f""", {_LBL2}
SELECT break_id, asset_class, pseudo_label, label_confidence FROM lab
WHERE pseudo_label IS NOT NULL AND COALESCE(label_confidence, 0) >= 0.70 AND asset_class = 'OTC'""",
                                         supplied=True), BREAK_VIEWS)
def f11_asset_class_filter(fx):
    """one asset class of the training rows (training floor 0.70, D5)."""
    t = LB.get_training_set(SP.labelled(fx, True), 0.70)
    return LB.asset_class_rows(t, "OTC").select("break_id", "asset_class", "pseudo_label",
                                                "label_confidence")


@register("a12_label_summary", _feat(f""", {_LBL2}
SELECT COUNT(*) AS total, COUNT_IF(pseudo_label = 1) AS false_break, COUNT_IF(pseudo_label = 0) AS genuine,
       COUNT_IF(pseudo_label IS NULL) AS unlabelled,
       ROUND_EVEN((COUNT_IF(pseudo_label = 1) + COUNT_IF(pseudo_label = 0)) * 100.0 / GREATEST(COUNT(*), 1), 1)
         AS labelled_pct
FROM lab""", supplied=True), BREAK_VIEWS)
def a12_label_summary(fx):
    """Weak-label coverage (one row)."""
    return LB.label_summary(SP.labelled(fx, True))


@register("a14_label_balance", _feat(f""", {_LBL2}
SELECT asset_class, COUNT_IF(pseudo_label = 1) AS n_false, COUNT_IF(pseudo_label = 0) AS n_genuine,
       COUNT_IF(pseudo_label = 0) / CAST(GREATEST(COUNT_IF(pseudo_label = 1), 1) AS DOUBLE) AS scale_pos_weight
FROM lab WHERE pseudo_label IS NOT NULL GROUP BY asset_class""", supplied=True), BREAK_VIEWS)
def a14_label_balance(fx):
    """A14 + M05: class balance and positive-class weight per asset class."""
    return LB.label_balance(SP.labelled(fx, True))


# ───────────────────────────── store, tiers, metrics, feedback ─────────────────────────────
from ..operators import feedback as FB  # noqa: E402
from ..operators import metrics as MT  # noqa: E402
from ..operators import tiers as TR  # noqa: E402
from ..sources import store as ST  # noqa: E402
from ..sources.uploads import prepare_for_ingest  # noqa: E402
from . import store_plan as STP  # noqa: E402


def _store(body: str) -> str:
    return "WITH " + STP.store_ctes().strip() + "\n" + body


LOOKUP_ID = "7-1"
RETIER = {"CEQ": 0.7, "OTC": 0.9}


@register("s07_prepare_ingest", f"""
SELECT break_id, CAST(break_amount_pence AS DOUBLE) / 100.0 AS break_amount_gbp,
       CAST(net_amount_pence AS DOUBLE) / 100.0 AS net_amount_gbp,
       CAST(gross_amount_pence AS DOUBLE) / 100.0 AS gross_amount_gbp,
       strftime(CAST(report_date AS DATE), '%Y-%m') AS report_month, '{STP.FIXTURE_HASH}' AS upload_hash,
       CAST(NULL AS DOUBLE) AS false_break_prob, CAST(NULL AS VARCHAR) AS risk_tier,
       CAST(NULL AS INTEGER) AS pseudo_label
FROM breaks""", BREAK_VIEWS)
def s07_prepare_ingest(fx):
    """GBP columns, report_month, upload hash and null placeholders."""
    return prepare_for_ingest(fx["breaks"], STP.FIXTURE_HASH).select(
        "break_id", "break_amount_gbp", "net_amount_gbp", "gross_amount_gbp", "report_month",
        "upload_hash", "false_break_prob", "risk_tier", "pseudo_label")


_DATE_COLS = ["break_open_date", "break_date", "report_date", "last_activity_date"]
_DATES_AS_TS = "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" for c in _DATE_COLS) + ")"


def _dates_as_ts(df):
    """Present DATE columns as timestamps (both engines hand those back alike)."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in _DATE_COLS if c in df.columns})


@register("s11_snapshot_ingest", _store(f"{_DATES_AS_TS} FROM snap"), BREAK_VIEWS)
def s11_snapshot_ingest(fx):
    """S10 + S11 + U02: typed snapshot, one row per break id (replace mode)."""
    return _dates_as_ts(STP.ingested(fx))


@register("s11_append_upload", _store(f"{_DATES_AS_TS} FROM merged"), BREAK_VIEWS)
def s11_append_upload(fx):
    """S11 + U02: a second upload appended to a written snapshot and merged on read."""
    return _dates_as_ts(STP.appended(fx))


@register("s17_breaks_load", _store(f"{_DATES_AS_TS} FROM store"), BREAK_VIEWS)
def s17_breaks_load(fx):
    """The current version of a written snapshot, scores included."""
    return _dates_as_ts(STP.store(fx))


@register("s13_dq_write_back", _store("SELECT break_id, dq_score FROM store"), BREAK_VIEWS)
def s13_dq_write_back(fx):
    """S13 + J07: dq_score written back by key."""
    return STP.store(fx).select("break_id", "dq_score")


@register("s14_score_write_back", _store("SELECT break_id, false_break_prob, risk_tier FROM store"),
          BREAK_VIEWS)
def s14_score_write_back(fx):
    """S14 + J07: probability and tier written back by key."""
    return STP.store(fx).select("break_id", "false_break_prob", "risk_tier")


@register("a08_breaks_kpis", _store("""
SELECT COUNT(*) AS total_breaks, COUNT_IF(risk_tier = 'Suppress') AS suppressed,
       COUNT_IF(risk_tier = 'Review') AS review, COUNT_IF(risk_tier = 'Escalate') AS escalate,
       CAST(COALESCE(SUM(CASE WHEN risk_tier = 'Suppress' THEN CAST(ABS(break_amount_gbp) AS DECIMAL(28, 4)) END), 0)
             AS DOUBLE) AS value_suppressed_gbp,
       ROUND_EVEN(COALESCE(AVG(dq_score), 0.0), 9) AS avg_dq_score,
       ROUND_EVEN(COUNT_IF(risk_tier = 'Suppress') * 100.0 / GREATEST(COUNT(*), 1), 1) AS suppressed_pct
FROM store"""), BREAK_VIEWS)
def a08_breaks_kpis(fx):
    """Dashboard KPIs over the stored breaks (avg rounded to 9 digits for the check)."""
    k = TR.breaks_kpis(STP.store(fx))
    return k.withColumn("avg_dq_score", F.bround("avg_dq_score", 9))


@register("f06_query_breaks", _store("""
SELECT break_id, asset_class, risk_tier, false_break_prob, break_amount_gbp FROM store
WHERE asset_class IN ('CEQ', 'OTC') AND risk_tier IN ('Suppress', 'Review')"""), BREAK_VIEWS)
def f06_query_breaks(fx):
    """IN-list filters on class and tier plus a column list."""
    return ST.query_breaks(STP.store(fx), ["CEQ", "OTC"], ["Suppress", "Review"],
                           columns=["break_id", "asset_class", "risk_tier", "false_break_prob", "break_amount_gbp"])


@register("f07_break_by_id", _store(f"{_DATES_AS_TS} FROM store WHERE break_id = '{LOOKUP_ID}'"),
          BREAK_VIEWS)
def f07_break_by_id(fx):
    """point lookup (0 or 1 row)."""
    return _dates_as_ts(ST.break_by_id(STP.store(fx), LOOKUP_ID))


SCORED_VIEWS = ["scored"]
_TIER_SQL = ("CASE WHEN false_break_prob IS NULL THEN 'Unscored' WHEN false_break_prob > {t} THEN 'Suppress' "
             "WHEN false_break_prob >= 0.5 THEN 'Review' ELSE 'Escalate' END")


@register("k01_assign_tier", f"""
SELECT break_id, asset_class, false_break_prob, {_TIER_SQL.format(t=0.8)} AS risk_tier FROM scored""",
          SCORED_VIEWS)
def k01_assign_tier(fx):
    """Probability -> Suppress / Review / Escalate (null -> Unscored)."""
    s = fx["scored"].select("break_id", "asset_class", "false_break_prob")
    return TR.assign_risk_tiers(s)


@register("k02_retier", f"""
WITH t AS (SELECT break_id, asset_class, false_break_prob, {_TIER_SQL.format(t=0.8)} AS risk_tier FROM scored)
SELECT break_id, asset_class, false_break_prob,
       CASE WHEN asset_class IN ('CEQ', 'OTC') AND false_break_prob IS NOT NULL THEN
            CASE WHEN false_break_prob > (CASE asset_class WHEN 'CEQ' THEN 0.7 ELSE 0.9 END) THEN 'Suppress'
                 WHEN false_break_prob >= 0.5 THEN 'Review' ELSE 'Escalate' END
            ELSE risk_tier END AS risk_tier
FROM t""", SCORED_VIEWS)
def k02_retier(fx):
    """Re-tier stored probabilities with per-class thresholds (others untouched)."""
    s = TR.assign_risk_tiers(fx["scored"].select("break_id", "asset_class", "false_break_prob"))
    return TR.update_risk_tiers(s, asset_thresholds=RETIER)


@register("a09_suppression_stats", f"""
WITH t AS (SELECT break_id, CAST(break_amount_pence AS DOUBLE) / 100.0 AS break_amount_gbp,
                  {_TIER_SQL.format(t=0.8)} AS risk_tier FROM scored)
SELECT COUNT(*) AS total, COUNT_IF(risk_tier = 'Suppress') AS suppressed, COUNT_IF(risk_tier = 'Review') AS review,
       COUNT_IF(risk_tier = 'Escalate') AS escalate,
       ROUND_EVEN(COUNT_IF(risk_tier = 'Suppress') * 100.0 / GREATEST(COUNT(*), 1), 1) AS suppressed_pct,
       CAST(COALESCE(SUM(CASE WHEN risk_tier = 'Suppress' THEN CAST(ABS(break_amount_gbp) AS DECIMAL(28, 4)) END), 0)
             AS DOUBLE) AS value_suppressed,
       CAST(0.8 AS DOUBLE) AS threshold
FROM t""", SCORED_VIEWS)
def a09_suppression_stats(fx):
    """Suppression statistics over tiered breaks."""
    s = fx["scored"].select("break_id", (F.col("break_amount_pence").cast("double") / 100.0)
                            .alias("break_amount_gbp"), "asset_class", "false_break_prob")
    return TR.suppression_stats(TR.assign_risk_tiers(s))


_EVAL_SQL = """
WITH d AS (SELECT asset_class, break_id, label, false_break_prob AS p FROM scored
           WHERE false_break_prob IS NOT NULL AND label IS NOT NULL),
sc AS (SELECT asset_class, p, COUNT_IF(label = 1) AS tp, COUNT_IF(label <> 1) AS fp FROM d GROUP BY asset_class, p),
r AS (SELECT *, SUM(tp) OVER w AS cum_tp, SUM(fp) OVER w AS cum_fp,
             SUM(tp) OVER (PARTITION BY asset_class) AS np, SUM(fp) OVER (PARTITION BY asset_class) AS nn
      FROM sc WINDOW w AS (PARTITION BY asset_class ORDER BY p ROWS UNBOUNDED PRECEDING)),
a AS (SELECT asset_class, MAX(np) AS n_pos, MAX(nn) AS n_neg,
             SUM(CAST(tp AS DECIMAL(38,0)) * CAST(2 * (cum_tp + cum_fp - tp - fp) + tp + fp + 1 AS DECIMAL(38,0))) AS s2,
             SUM((tp / CAST(np AS DOUBLE)) * ((np - cum_tp + tp) / CAST((np - cum_tp + tp) + (nn - cum_fp + fp) AS DOUBLE))) AS ap
      FROM r GROUP BY asset_class),
auc AS (SELECT asset_class, n_pos + n_neg AS n,
               CASE WHEN n_pos > 0 AND n_neg > 0 THEN CAST(s2 - CAST(n_pos * (n_pos + 1) AS DECIMAL(38,0)) AS DOUBLE)
                    / (CAST(2.0 AS DOUBLE) * CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE)) ELSE 0.0 END AS auc_roc,
               CASE WHEN n_pos > 0 AND n_neg > 0 THEN ap ELSE 0.0 END AS average_precision
        FROM a),
t AS (SELECT asset_class, label, ROW_NUMBER() OVER (PARTITION BY asset_class ORDER BY p DESC, break_id, label) AS rn,
             COUNT(*) OVER (PARTITION BY asset_class) AS n FROM d),
pk AS (SELECT asset_class, AVG(label) AS precision_at_10pct FROM t
       WHERE rn <= GREATEST(FLOOR(n * CAST(0.1 AS DOUBLE)), 1) GROUP BY asset_class),
cm AS (SELECT asset_class, COUNT_IF(label <> 1 AND p < 0.5) AS tn, COUNT_IF(label <> 1 AND p >= 0.5) AS fp,
              COUNT_IF(label = 1 AND p < 0.5) AS fn, COUNT_IF(label = 1 AND p >= 0.5) AS tp FROM d GROUP BY asset_class)
SELECT auc.asset_class, auc.n, ROUND_EVEN(auc_roc, 4) AS auc_roc,
       ROUND_EVEN(CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END, 4) AS f1,
       ROUND_EVEN(average_precision, 4) AS average_precision, ROUND_EVEN(precision_at_10pct, 4) AS precision_at_10pct,
       ROUND_EVEN(CASE WHEN (tp + fn > 0 OR tp + fp > 0) AND (tn + fp > 0 OR tn + fn > 0)
                       THEN fn / CAST(GREATEST(fn + tp, 1) AS DOUBLE) ELSE 0.0 END, 4) AS false_negative_rate,
       tn, fp, fn, tp
FROM auc JOIN pk ON auc.asset_class IS NOT DISTINCT FROM pk.asset_class
JOIN cm ON auc.asset_class IS NOT DISTINCT FROM cm.asset_class"""


@register("m09_evaluate", _EVAL_SQL, SCORED_VIEWS)
def m09_evaluate(fx):
    """AUC-ROC, F1, AP, P@10%, FN rate and confusion counts per asset class."""
    return MT.evaluate(fx["scored"])


@register("t05_precision_at_top10pct", """
WITH d AS (SELECT asset_class, break_id, label, false_break_prob AS p FROM scored
           WHERE false_break_prob IS NOT NULL AND label IS NOT NULL),
t AS (SELECT asset_class, label, ROW_NUMBER() OVER (PARTITION BY asset_class ORDER BY p DESC, break_id, label) AS rn,
             COUNT(*) OVER (PARTITION BY asset_class) AS n FROM d)
SELECT asset_class, AVG(label) AS precision_at_10pct, COUNT(*) AS k FROM t
WHERE rn <= GREATEST(FLOOR(n * CAST(0.1 AS DOUBLE)), 1) GROUP BY asset_class""", SCORED_VIEWS)
def t05_precision_at_top10pct(fx):
    """Precision among the top 10 % scores per class."""
    return MT.precision_at_top(fx["scored"])


FB_VIEWS = ["scored", "feedback"]


def _fb(body: str) -> str:
    return "WITH " + STP.feedback_cte().strip() + "\n" + body


@register("a11_feedback_counts", _fb("""
SELECT asset_class, COUNT_IF(analyst_label = 0) AS genuine, COUNT_IF(analyst_label = 1) AS false_break,
       COUNT(*) AS total FROM fb GROUP BY asset_class
UNION ALL
SELECT 'TOTAL', COUNT_IF(analyst_label = 0), COUNT_IF(analyst_label = 1), COUNT(*) FROM fb"""), FB_VIEWS)
def a11_feedback_counts(fx):
    """Genuine / false-break / total labels per class and TOTAL."""
    return FB.feedback_counts(STP.feedback(fx))


@register("m13_feedback_gate", _fb("""
SELECT break_id, analyst_label, analyst_id, model_prediction, asset_class FROM fb
WHERE asset_class IN (SELECT asset_class FROM fb GROUP BY asset_class HAVING COUNT(*) >= 200)"""), FB_VIEWS)
def m13_feedback_gate(fx):
    """Feedback of the classes that reached the 200-label gate."""
    return FB.feedback_for_retraining(STP.feedback(fx)).select(
        "break_id", "analyst_label", "analyst_id", "model_prediction", "asset_class")


@register("s12_feedback_append", _fb("""
SELECT n.break_id, n.analyst_label, n.analyst_id, n.model_prediction, n.asset_class, n.override_flag,
       o.break_id IS NOT NULL AS already_had_feedback
FROM fb n LEFT JOIN (SELECT DISTINCT break_id FROM fb WHERE pass_no = 1) o ON n.break_id = o.break_id
WHERE n.pass_no = 2"""), FB_VIEWS)
def s12_feedback_append(fx):
    """A new feedback batch in stored shape, flagged when the break already has feedback."""
    batch = FB.prepare_feedback(STP.feedback(fx, 2), "feedback_timestamp")
    flagged = FB.flag_existing(batch, STP.feedback(fx, 1))
    return flagged.select("break_id", "analyst_label", "analyst_id", "model_prediction", "asset_class",
                          "override_flag", "already_had_feedback")


@register("s16_feedback_load", _fb("""
SELECT break_id, analyst_label, analyst_id, model_prediction, asset_class, report_month, override_flag,
       feedback_timestamp FROM fb ORDER BY feedback_timestamp DESC"""), FB_VIEWS)
def s16_feedback_load(fx):
    """S16 + T04: all feedback, newest first."""
    return FB.load_feedback(STP.feedback(fx))


# ───────────────────────────── imputation, anomaly fallback, scoring ─────────────────────────────
from ..operators import anomaly as AN  # noqa: E402
from ..operators.scoring import score_breaks  # noqa: E402

# features whose source columns do not exist in the report: null in every row, so dropped by M02
_NO_SOURCE = ["time_to_coupon", "time_to_ex_div", "rate_reset_proximity", "maturity_proximity"]
_IMPUTED = [f for f in C.ALL_FEATURES if f not in _NO_SOURCE]


def _m02_sql() -> str:
    cols = ", ".join(f"CAST({('f_' + c) if c in SP._PREFIXED else c} AS DOUBLE) AS {c}" for c in _IMPUTED)
    fill = ", ".join(f"COALESCE({c}, (SELECT med FROM med WHERE feature = '{c}')) AS {c}" for c in _IMPUTED)
    return _feat(f""", m AS (SELECT break_id, {cols} FROM feat),
long AS (UNPIVOT m ON COLUMNS(* EXCLUDE (break_id)) INTO NAME feature VALUE v),
med AS (SELECT feature, (MAX(CASE WHEN rn = (n - 1) // 2 + 1 THEN v END)
                         + MAX(CASE WHEN rn = n // 2 + 1 THEN v END)) / 2.0 AS med
        FROM (SELECT feature, v, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY v) AS rn,
                     COUNT(*) OVER (PARTITION BY feature) AS n FROM long WHERE v IS NOT NULL) q
        GROUP BY feature)
SELECT break_id, {fill} FROM m""")


@register("m02_median_impute", _m02_sql(), BREAK_VIEWS)
def m02_median_impute(fx):
    """Nulls -> column median; columns without any value are dropped."""
    imputed, kept = AN.median_impute(SP.feature_matrix_view(fx), C.ALL_FEATURES)
    return imputed.select("break_id", *kept[()])


@register("m03_anomaly_fallback")
def m03_anomaly_fallback(fx):
    """Isolation-forest score per asset class scaled to [0.05, 0.95] (random: rows-only check)."""
    kept = ["break_id", "asset_class"]
    return AN.isolation_forest_fallback(SP.features(fx, keep=kept), keep=kept, stored=True)


@register("k03_score_breaks")
def k03_score_breaks(fx):
    """Per-class scoring (no published model -> fallback) and tiers; other classes Unscored."""
    kept = ["break_id", "asset_class"]
    return score_breaks(SP.features(fx, keep=kept), keep=kept, stored=True)


# ───────────────────────────── champion gate over per-class AUCs ─────────────────────────────
from ..operators import training as TRN  # noqa: E402


def _auc_sql(src: str, label: str, prob: str) -> str:
    return f"""
SELECT asset_class, CASE WHEN n_pos > 0 AND n_neg > 0 THEN CAST(s2 - CAST(n_pos * (n_pos + 1) AS DECIMAL(38,0)) AS DOUBLE)
       / (CAST(2.0 AS DOUBLE) * CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE)) ELSE 0.0 END AS auc
FROM (SELECT asset_class, MAX(np) AS n_pos, MAX(nn) AS n_neg,
             SUM(CAST(tp AS DECIMAL(38,0)) * CAST(2 * (cum_tp + cum_fp - tp - fp) + tp + fp + 1 AS DECIMAL(38,0))) AS s2
      FROM (SELECT *, SUM(tp) OVER w AS cum_tp, SUM(fp) OVER w AS cum_fp,
                   SUM(tp) OVER (PARTITION BY asset_class) AS np, SUM(fp) OVER (PARTITION BY asset_class) AS nn
            FROM (SELECT asset_class, {prob} AS p, COUNT_IF({label} = 1) AS tp, COUNT_IF({label} <> 1) AS fp
                  FROM {src} WHERE {prob} IS NOT NULL AND {label} IS NOT NULL AND asset_class IS NOT NULL
                  GROUP BY asset_class, {prob}) sc
            WINDOW w AS (PARTITION BY asset_class ORDER BY p ROWS UNBOUNDED PRECEDING)) r
      GROUP BY asset_class) a"""


@register("m15_champion_gate", _fb(f""",
new_auc AS ({_auc_sql("scored", "label", "false_break_prob")}),
prev_auc AS ({_auc_sql("fb", "analyst_label", "model_prediction")})
SELECT n.asset_class, ROUND_EVEN(p.auc, 4) AS prev_auc, ROUND_EVEN(n.auc, 4) AS new_auc,
       CASE WHEN p.auc IS NULL OR ROUND_EVEN(p.auc, 4) = 0
                 OR ROUND_EVEN(n.auc, 4) - COALESCE(ROUND_EVEN(p.auc, 4), 0.0) >= 0.02
            THEN 'accept' ELSE 'reject' END AS action
FROM new_auc n LEFT JOIN prev_auc p ON n.asset_class = p.asset_class"""), FB_VIEWS)
def m15_champion_gate(fx):
    """Accept a candidate when there is no previous AUC or it improves by >= 0.02.

    Candidates per class: the new AUC of the scored probabilities against the
    rolled-up labels, the previous AUC of the analysts' recorded predictions.
    """
    new = MT.auc_ap(fx["scored"].where(F.col("asset_class").isNotNull())).select(
        "asset_class", F.bround("auc_roc", 4).alias("new_auc"))
    fb = STP.feedback(fx).where(F.col("asset_class").isNotNull())
    prev = MT.auc_ap(fb, "analyst_label", "model_prediction").select(
        F.col("asset_class").alias("__ac"), F.bround("auc_roc", 4).alias("prev_auc"))
    j = new.join(prev, F.col("asset_class") == F.col("__ac"), "left").drop("__ac")
    return j.select("asset_class", "prev_auc", "new_auc",
                    TRN.gate_action(F.col("prev_auc"), F.col("new_auc")).alias("action"))
