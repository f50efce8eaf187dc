"""Data-quality score per break (Q01-Q06) and its summary (A10).

Duplicate detection (W06) is a per-id count joined back - not a window over
raw rows - so a break id that holds a large share of all rows is folded
map-side and, at the join, split by AQE's skew handling instead of landing in
one task. Of kept rows only the ids move, and only those that several rows
have come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import clip, days_between, is_date, numeric, ustrip
from ..session import written
from .rowstore import ROW, is_kept, mark

COMPONENTS = ["dq_governance_ok", "dq_age_valid", "dq_amount_nonzero",
              "dq_asset_class_valid", "dq_no_duplicate"]


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def governance_ok(df: DataFrame) -> Column:
    """Q01: every present governance column non-null and non-blank."""
    present = [c for c in ("owner", "approver", "status") if c in df.columns]
    if not present:
        return F.lit(0.0)
    cond = None
    for c in present:
        e = F.col(c).isNotNull() & (ustrip(F.col(c).cast("string")) != F.lit(""))
        cond = e if cond is None else cond & e
    return _flag(F.coalesce(cond, F.lit(False)))


def report_age(df: DataFrame) -> Column:
    """Age in days: the supplied column when it has a value, else report - open."""
    dates = is_date(df, "report_date") and is_date(df, "break_open_date")
    derived = (days_between(F.col("report_date"), F.col("break_open_date"), dates)
               if {"report_date", "break_open_date"} <= set(df.columns)
               else F.lit(None).cast("int"))
    if "break_age_days" in df.columns:
        return F.coalesce(numeric(df, "break_age_days"), derived.cast("double"))
    return derived.cast("double")


def amount_for_dq(df: DataFrame) -> Column:
    if "break_amount_gbp" in df.columns:
        return numeric(df, "break_amount_gbp")
    if "break_amount_pence" in df.columns:
        return numeric(df, "break_amount_pence")
    return F.lit(None).cast("double")


def _id_terms(key: str) -> tuple[Column, Column]:
    """(text, is null) of an id: what a null-safe join by it is dealt out by."""
    return F.coalesce(F.col(key).cast("string"), F.lit("")), F.isnull(key)


def duplicate_counts(df: DataFrame, key: str = "break_id") -> DataFrame:
    """W06 helper: rows per id (aggregated, then joined back by the caller); null ids are one group."""
    same_id, no_id = _id_terms(key)
    return df.groupBy(same_id.alias("__dup_id"), no_id.alias("__dup_null")).agg(F.count(F.lit(1)).alias("__n_same_id"))


def repeated_rows(df: DataFrame, key: str = "break_id") -> DataFrame:
    """The numbers of kept rows whose id several rows have (null ids are one id)."""
    same_id, no_id = _id_terms(key)
    ids = df.select(ROW, same_id.alias("__dup_id"), no_id.alias("__dup_null"))
    # written, so that its true size decides how it is joined
    repeated = written(duplicate_counts(df, key).where("__n_same_id > 1").drop("__n_same_id"), "repeated-ids")
    return ids.join(repeated, ["__dup_id", "__dup_null"], "left_semi").select(ROW)


def compute_dq_scores(df: DataFrame, stored: bool = False) -> DataFrame:
    """Adds dq_governance_ok, dq_age_valid, dq_amount_nonzero, dq_asset_class_valid,
    dq_no_duplicate and dq_score (weighted sum clipped to [0, 1]). ``stored``: the
    rows lie in buckets by id; they are counted and joined by the id itself, within
    the buckets, and the null ids are counted by a scan of their own. Kept rows
    (:mod:`rowstore`) stay where they are."""
    out = df.withColumn("__age", report_age(df))
    age = F.col("__age")
    amt = F.coalesce(amount_for_dq(df), F.lit(0.0))
    out = out.withColumns({
        "dq_governance_ok": governance_ok(df),
        "dq_age_valid": _flag(F.coalesce((age > 0) & (age < C.DQ_MAX_AGE_DAYS), F.lit(False))),
        "dq_amount_nonzero": _flag(F.abs(amt) > 0) if (
            "break_amount_gbp" in df.columns or "break_amount_pence" in df.columns) else F.lit(0.0),
        "dq_asset_class_valid": (_flag(F.coalesce(F.col("asset_class").isin(C.VALID_ASSET_CLASSES),
                                                  F.lit(False)))
                                 if "asset_class" in df.columns else F.lit(0.0)),
    })
    if "break_id" in df.columns and stored:
        counts = df.groupBy("break_id").agg(F.count(F.lit(1)).alias("__n_same_id")).withColumnRenamed("break_id", "__dup_id")
        nulls = df.where(F.col("break_id").isNull()).agg(F.count(F.lit(1)).alias("__n_no_id"))
        out = out.join(counts, F.col("break_id") == F.col("__dup_id"), "left").crossJoin(F.broadcast(nulls))
        same = F.when(F.col("break_id").isNull(), F.col("__n_no_id")).otherwise(F.col("__n_same_id"))
        out = out.withColumn("dq_no_duplicate", _flag(same == 1)).drop("__dup_id", "__n_same_id", "__n_no_id")
    elif "break_id" in df.columns and is_kept(df):
        out = mark(out, repeated_rows(df), "__repeated", "repeated-rows")
        out = out.withColumn("dq_no_duplicate", _flag(F.col("__repeated").isNull())).drop("__repeated")
    elif "break_id" in df.columns:
        same_id, no_id = _id_terms("break_id")
        out = out.join(duplicate_counts(df), (same_id == F.col("__dup_id")) & (no_id == F.col("__dup_null")), "left") \
            .drop("__dup_id", "__dup_null")
        out = out.withColumn("dq_no_duplicate", _flag(F.col("__n_same_id") == 1)).drop("__n_same_id")
    else:
        out = out.withColumn("dq_no_duplicate", F.lit(0.0))
    w = C.DQ_WEIGHTS
    score = (F.col("dq_governance_ok") * w["governance_ok"]
             + F.col("dq_age_valid") * w["age_valid"]
             + F.col("dq_amount_nonzero") * w["amount_nonzero"]
             + F.col("dq_asset_class_valid") * w["asset_class_valid"]
             + F.col("dq_no_duplicate") * w["no_duplicate"])
    return out.withColumn("dq_score", clip(score, 0.0, 1.0)).drop("__age")


def dq_summary(df: DataFrame, digits: int = 4) -> DataFrame:
    """A10: per asset class and OVERALL - mean score, rows, component means.

    One scan: partial sums per class (null class kept as its own partial), then
    OVERALL from those few partial rows. Null classes appear only in OVERALL.
    """
    if "dq_score" not in df.columns:
        df = compute_dq_scores(df)
    comps = [c for c in COMPONENTS if c in df.columns]
    cls = F.col("asset_class") if "asset_class" in df.columns else F.lit(None).cast("string")
    parts = df.groupBy(cls.alias("__ac")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("dq_score").alias("__s_score"), F.count("dq_score").alias("__n_score"),
        *[F.sum(c).alias(f"__s_{c}") for c in comps],
        *[F.count(c).alias(f"__n_{c}") for c in comps])

    def finish(g: DataFrame, label: Column) -> DataFrame:
        return g.select(
            label.alias("asset_class"),
            F.bround(F.try_divide(F.col("__s_score"), F.col("__n_score")), digits).alias("mean_dq_score"),
            F.col("rows").cast("long").alias("rows"),
            *[F.bround(F.try_divide(F.col(f"__s_{c}"), F.col(f"__n_{c}")), digits).alias(c)
              for c in comps])

    per = finish(parts.where(F.col("__ac").isNotNull()), F.col("__ac"))
    tot = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                    F.sum("__s_score").alias("__s_score"), F.sum("__n_score").alias("__n_score"),
                    *[F.sum(f"__s_{c}").alias(f"__s_{c}") for c in comps],
                    *[F.sum(f"__n_{c}").alias(f"__n_{c}") for c in comps])
    overall = finish(tot, F.lit("OVERALL"))
    return per.unionByName(overall)
