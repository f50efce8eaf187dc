"""Stored ``breaks`` snapshot and ``feedback`` over the fixtures, with oracle text.

The store is the prepared report ingested with replace semantics (one row per
break id), DQ-scored, with a probability derived from the amount (a stand-in
for a model output that both engines compute identically) and tiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dq as DQ
from ..operators import tiers as TR
from ..sources import store as ST
from ..sources.fixtures import Fixtures
from ..sources.uploads import newest_prepared, prepare_for_ingest
from ..session import scratch_path

FIXTURE_HASH = "0" * 64
PROB_SQL = "CAST(((break_amount_pence % 997) + 997) % 997 AS DOUBLE) / 996.0"


def ingested(fx: Fixtures, buckets: int | None = None) -> DataFrame:
    """S07 + S11 (replace): the snapshot rows, one per break id."""
    return newest_prepared(fx["breaks"], FIXTURE_HASH, buckets)


def _first_version(fx: Fixtures, root: str) -> None:
    n = ST.bucket_count(fx["breaks"])
    ST.write_snapshot(ingested(fx, n), root, buckets=n)


def _scores(snap: DataFrame) -> DataFrame:
    """dq_score, probability and tier of the stored rows, by id."""
    prob = ((F.col("break_amount_pence") % 997 + 997) % 997).cast("double") / 996.0
    scored = DQ.compute_dq_scores(snap.drop("dq_score"), stored=True).withColumn("false_break_prob", prob)
    return TR.assign_risk_tiers(scored.select("break_id", "asset_class", "dq_score", "false_break_prob")).select(
        "break_id", "dq_score", "false_break_prob", "risk_tier")


def store(fx: Fixtures) -> DataFrame:
    """A written snapshot: ingested as its first version, scores written back as the second, read again."""
    root = scratch_path(fx.spark, "store")
    _first_version(fx, root)
    return ST.update_snapshot(fx.spark, root, _scores, ["dq_score", "false_break_prob", "risk_tier"])


def appended(fx: Fixtures) -> DataFrame:
    """S11 append: a second upload (all breaks of one class, amounts changed) over a written snapshot."""
    root = scratch_path(fx.spark, "store")
    _first_version(fx, root)
    again = prepare_for_ingest(fx["breaks"], FIXTURE_HASH).where(F.col("asset_class") == "CEQ")
    ST.append_upload(again.withColumn("break_amount_pence", F.col("break_amount_pence") + 100), root)
    return ST.load_snapshot(fx.spark, root)


def feedback(fx: Fixtures, pass_no: int | None = None) -> DataFrame:
    """Stored feedback rows (deterministic timestamp from the pass number)."""
    f = fx["feedback"]
    if pass_no is not None:
        f = f.where(F.col("pass_no") == pass_no)
    return f.select("break_id", F.col("analyst_label").cast("int").alias("analyst_label"),
                    "analyst_id", F.col("model_prediction").cast("double").alias("model_prediction"),
                    "asset_class",
                    F.lit("2026-01").alias("report_month"),
                    (F.col("pass_no") == 2).alias("override_flag"),
                    (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_interval(
                        days=F.col("pass_no").cast("int"))).alias("feedback_timestamp"))


# ───────────────────────────── oracle text ─────────────────────────────

STORE_COLS = [f.name for f in ST.BREAKS_SCHEMA.fields]


def store_ctes() -> str:
    """CTEs ``snap`` (ingested, one row per id) and ``store`` (scored + tiers)."""
    from .scoring_plan import _strip
    t = {f.name: f.dataType.simpleString() for f in ST.BREAKS_SCHEMA.fields}
    duck = {"string": "VARCHAR", "date": "DATE", "bigint": "BIGINT", "double": "DOUBLE",
            "int": "INTEGER", "boolean": "BOOLEAN"}
    present = {"break_id", "asset_class", "entity_id", "team_code", "rec_name", "source_system",
               "break_open_date", "report_date", "last_activity_date", "break_amount_pence",
               "break_direction", "owner", "approver", "status", "counterparty"}
    sel = []
    for c in STORE_COLS:
        if c in present:
            sel.append(f"CAST({c} AS {duck[t[c]]}) AS {c}")
        elif c in ("break_amount_gbp", "net_amount_gbp", "gross_amount_gbp"):
            sel.append(f"CAST({c.replace('_gbp', '_pence')} AS DOUBLE) / 100.0 AS {c}")
        elif c == "report_month":
            sel.append("strftime(CAST(report_date AS DATE), '%Y-%m') AS report_month")
        elif c == "upload_hash":
            sel.append(f"'{FIXTURE_HASH}' AS upload_hash")
        else:
            sel.append(f"CAST(NULL AS {duck[t[c]]}) AS {c}")
    order = ", ".join(f"{c} DESC NULLS LAST" for c in STORE_COLS)
    gov = " AND ".join(f"{c} IS NOT NULL AND {_strip(c)} <> ''" for c in ("owner", "approver", "status"))
    dq = (f"LEAST(GREATEST("
          f"(CASE WHEN {gov} THEN 1.0 ELSE 0.0 END)::DOUBLE * CAST(0.3 AS DOUBLE)"
          f" + (CASE WHEN date_diff('day', break_open_date, report_date) > 0 AND "
          f"date_diff('day', break_open_date, report_date) < 3650 THEN 1.0 ELSE 0.0 END)::DOUBLE * CAST(0.2 AS DOUBLE)"
          f" + (CASE WHEN ABS(COALESCE(break_amount_gbp, 0.0)) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE * CAST(0.2 AS DOUBLE)"
          f" + (CASE WHEN asset_class IN ('CEQ', 'LnD', 'MTN', 'OTC') THEN 1.0 ELSE 0.0 END)::DOUBLE"
          f" * CAST(0.15 AS DOUBLE) + CAST(1.0 AS DOUBLE) * CAST(0.15 AS DOUBLE), 0.0), 1.0)")
    others = ", ".join(c for c in STORE_COLS if c not in ("dq_score", "false_break_prob", "risk_tier"))
    return f"""
prep AS (SELECT {", ".join(sel)} FROM breaks),
uploads AS (SELECT *, 1 AS upload FROM prep UNION ALL
            SELECT * REPLACE (break_amount_pence + 100 AS break_amount_pence), 2 AS upload FROM prep
            WHERE asset_class = 'CEQ'),
merged AS (SELECT {", ".join(STORE_COLS)} FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY break_id ORDER BY upload DESC, {order}) AS __rn FROM uploads) q
           WHERE __rn = 1),
snap AS (SELECT {", ".join(STORE_COLS)} FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY break_id ORDER BY {order}) AS __rn FROM prep) q
         WHERE __rn = 1),
store AS (
  SELECT {others}, {dq} AS dq_score, {PROB_SQL} AS false_break_prob,
         CASE WHEN {PROB_SQL} > 0.8 THEN 'Suppress' WHEN {PROB_SQL} >= 0.5 THEN 'Review'
              ELSE 'Escalate' END AS risk_tier
  FROM snap)"""


def feedback_cte() -> str:
    return """
fb AS (SELECT break_id, CAST(analyst_label AS INTEGER) AS analyst_label, analyst_id,
              CAST(model_prediction AS DOUBLE) AS model_prediction, asset_class, '2026-01' AS report_month,
              pass_no = 2 AS override_flag,
              TIMESTAMP '2026-01-01' + INTERVAL (pass_no) DAY AS feedback_timestamp, pass_no
       FROM feedback)"""
