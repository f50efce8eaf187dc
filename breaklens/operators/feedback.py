"""Analyst feedback: append (S12), load (S16), counts (A11), retraining gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import written

FEEDBACK_COLUMNS = ["break_id", "analyst_label", "analyst_id", "model_prediction", "asset_class",
                    "report_month", "override_flag"]


def prepare_feedback(batch: DataFrame, timestamp_col: str | None = None) -> DataFrame:
    """A batch of labels in the stored shape (uuid id, timestamp, override default false).

    Rows with a null break id or label are rejected (NOT NULL columns).
    """
    cols = {c: (F.col(c) if c in batch.columns else F.lit(None)) for c in FEEDBACK_COLUMNS}
    ts = F.col(timestamp_col) if timestamp_col else F.current_timestamp()
    out = batch.where(F.col("break_id").isNotNull() & F.col("analyst_label").isNotNull())
    return out.select(
        F.expr("uuid()").alias("feedback_id"),
        F.col("break_id").cast("string").alias("break_id"),
        F.col("analyst_label").cast("int").alias("analyst_label"),
        cols["analyst_id"].cast("string").alias("analyst_id"),
        ts.cast("timestamp").alias("feedback_timestamp"),
        cols["model_prediction"].cast("double").alias("model_prediction"),
        cols["asset_class"].cast("string").alias("asset_class"),
        cols["report_month"].cast("string").alias("report_month"),
        F.coalesce(cols["override_flag"].cast("boolean"), F.lit(False)).alias("override_flag"))


def flag_existing(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """S12 warning: mark batch rows whose break id already has feedback (semi-join)."""
    seen = existing.select(F.col("break_id").alias("__seen")).distinct()
    j = batch.join(seen, F.col("break_id") == F.col("__seen"), "left")
    return j.withColumn("already_had_feedback", F.col("__seen").isNotNull()).drop("__seen")


def load_feedback(feedback: DataFrame) -> DataFrame:
    """All feedback, newest first. Rows of one time are ordered by their
    other columns, so that a batch with a single timestamp is sorted by many tasks."""
    rest = [c for c in feedback.columns if c != "feedback_timestamp"]
    return feedback.orderBy(F.desc("feedback_timestamp"), *rest)


def feedback_counts(feedback: DataFrame, asset_class: str | None = None) -> DataFrame:
    """Genuine / false_break / total per class (null class is its own group)
    plus a TOTAL row (zeros on empty input). One scan; TOTAL folds the partials."""
    f = feedback if asset_class is None else feedback.where(F.col("asset_class") == asset_class)
    per = f.groupBy("asset_class").agg(
        F.count_if(F.col("analyst_label") == 0).alias("genuine"),
        F.count_if(F.col("analyst_label") == 1).alias("false_break"),
        F.count(F.lit(1)).alias("total"))
    tot = per.agg(F.lit("TOTAL").alias("asset_class"),
                  F.coalesce(F.sum("genuine"), F.lit(0)).cast("long").alias("genuine"),
                  F.coalesce(F.sum("false_break"), F.lit(0)).cast("long").alias("false_break"),
                  F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))
    return per.unionByName(tot)


def feedback_for_retraining(feedback: DataFrame, min_labels: int = C.MIN_ANALYST_LABELS,
                            by: str = "asset_class") -> DataFrame:
    """The feedback rows of every class holding at least ``min_labels`` labels."""
    ok = (feedback.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
          .where(F.col("__n") >= min_labels).select(F.col(by).alias("__ok")))
    # written, so that its size is known and the feedback isn't dealt out by class
    return feedback.join(written(ok, "feedback-gate"), F.col(by) == F.col("__ok"), "left_semi")
