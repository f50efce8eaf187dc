"""Evaluation metrics over a (label, probability) table.

Everything is computed per group (asset class by default) without collecting
scores anywhere:

* AUC-ROC - rank-sum with average ranks. Scores are folded to DISTINCT values
  with (positives, negatives) counts, one running total gives the rows below
  each score; the numerator is an exact integer (decimal) sum.
* Average precision - sum over distinct scores (descending) of
  ``tp / P * precision``, the step-wise definition.
* F1 at 0.5, FN rate, confusion matrix - one conditional aggregate.
* Precision at the top 10 % - k = max(1, floor(0.1 n)) rows by (score desc,
  id, label) through the bucketed ranking; mean label of those k.
Single-class groups report 0.0 for AUC and AP.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import nan_to_null
from .ranking import running_totals


def _scored(df: DataFrame, label: str, prob: str) -> DataFrame:
    return df.withColumn("__p", nan_to_null(F.col(prob))).where(
        F.col("__p").isNotNull() & F.col(label).isNotNull())


def auc_ap(df: DataFrame, label: str = "label", prob: str = "false_break_prob",
           group_cols: Sequence[str] = ("asset_class",)) -> DataFrame:
    """Per group: n, n_pos, n_neg, auc_roc, average_precision (unrounded)."""
    g = list(group_cols)
    d = _scored(df, label, prob)
    sc = d.groupBy(*g, "__p").agg(F.count_if(F.col(label) == 1).alias("tp"),
                                  F.count_if(F.col(label) != 1).alias("fp"))
    r = running_totals(sc, ["__p"], sums=["tp", "fp"], group_cols=g)
    c = F.col("tp") + F.col("fp")
    below = F.col("cum_tp") + F.col("cum_fp") - c
    # 2 * average rank is an integer: 2 * below + c + 1
    twice_rank_pos = (F.col("tp").cast("decimal(38,0)")
                      * (2 * below + c + 1).cast("decimal(38,0)"))
    P, N = F.col("group_tp"), F.col("group_fp")
    cum_tp_desc = P - F.col("cum_tp") + F.col("tp")
    cum_fp_desc = N - F.col("cum_fp") + F.col("fp")
    ap_term = (F.col("tp") / P.cast("double")) * (cum_tp_desc / (cum_tp_desc + cum_fp_desc).cast("double"))
    agg = r.groupBy(*g).agg(F.max("group_tp").alias("n_pos"), F.max("group_fp").alias("n_neg"),
                            F.sum(twice_rank_pos).alias("__s2"), F.sum(ap_term).alias("__ap"))
    P, N = F.col("n_pos"), F.col("n_neg")
    both = (P > 0) & (N > 0)
    num = (F.col("__s2") - (P * (P + 1)).cast("decimal(38,0)")).cast("double")
    auc = F.when(both, num / (F.lit(2.0) * P.cast("double") * N.cast("double"))).otherwise(F.lit(0.0))
    ap = F.when(both, F.col("__ap")).otherwise(F.lit(0.0))
    return agg.select(*g, (P + N).alias("n"), "n_pos", "n_neg", auc.alias("auc_roc"),
                      ap.alias("average_precision"))


def precision_at_top(df: DataFrame, label: str = "label", prob: str = "false_break_prob",
                     id_col: str = "break_id", group_cols: Sequence[str] = ("asset_class",),
                     fraction: float = C.TOP_FRACTION) -> DataFrame:
    """Mean label of the ``max(1, floor(fraction * n))`` highest scores per group.

    Rows are counted per distinct score; running totals of these counts give
    the score at which the top ends. Only rows tied there are put in order (by
    id, then label) to fill what is left of the top.
    """
    g = list(group_cols)
    d = _scored(df, label, prob).select(*g, id_col, F.col(label).cast("int").alias("__y"),
                                        (-F.col("__p")).alias("__negp"))
    per = d.groupBy(*g, "__negp").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__s"))
    r = running_totals(per, ["__negp"], sums=["__n", "__s"], group_cols=g)
    k = F.greatest(F.floor(F.col("group___n") * F.lit(fraction)), F.lit(1))
    above = F.col("cum___n") - F.col("__n")
    cut = r.where((above < k) & (F.col("cum___n") >= k)).select(
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(g)], F.col("__negp").alias("__cut"), k.alias("k"),
        (k - above).alias("__rest"), (F.col("cum___s") - F.col("__s")).alias("__above"))
    at_cut = F.col("__negp") == F.col("__cut")
    for i, c in enumerate(g):
        at_cut &= F.col(c).eqNullSafe(F.col(f"__c{i}"))
    tied = running_totals(d.join(cut, at_cut).drop(*[f"__c{i}" for i in range(len(g))]), [id_col, "__y"], group_cols=g)
    filled = tied.where(F.col("pos") <= F.col("__rest"))
    # k, rows above the cut and their labels are the same in all rows of a group
    return filled.groupBy(*g).agg(((F.max("__above") + F.sum("__y")) / F.max("k")).alias("precision_at_10pct"),
                                  F.max("k").alias("k"))


def confusion(df: DataFrame, label: str = "label", prob: str = "false_break_prob",
              group_cols: Sequence[str] = ("asset_class",), cut: float = 0.5) -> DataFrame:
    """Confusion counts at ``prob >= cut``, F1 and FN rate per group."""
    g = list(group_cols)
    d = _scored(df, label, prob)
    y, p = F.col(label) == 1, F.col("__p") >= F.lit(cut)
    a = d.groupBy(*g).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                          F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1_den = 2 * tp + fp + fn
    f1 = F.when(f1_den > 0, (2 * tp) / f1_den.cast("double")).otherwise(F.lit(0.0))
    # the 2x2 matrix exists when both classes occur among labels or predictions
    two_by_two = ((tp + fn > 0) | (tp + fp > 0)) & ((tn + fp > 0) | (tn + fn > 0))
    fnr = F.when(two_by_two, fn / F.greatest(fn + tp, F.lit(1)).cast("double")).otherwise(F.lit(0.0))
    return a.select(*g, "tn", "fp", "fn", "tp", f1.alias("f1"), fnr.alias("false_negative_rate"))


def evaluate(df: DataFrame, label: str = "label", prob: str = "false_break_prob",
             id_col: str = "break_id", group_cols: Sequence[str] = ("asset_class",),
             digits: int = 4) -> DataFrame:
    """One row per group with auc_roc, f1, average_precision,
    precision_at_10pct, false_negative_rate (rounded) and the confusion counts."""
    g = list(group_cols)
    if not g:  # one overall group, joined on a constant key (never a cross join)
        df, g = df.withColumn("__all", F.lit(1)), ["__all"]
    a = auc_ap(df, label, prob, g)
    p = precision_at_top(df, label, prob, id_col, g)
    c = confusion(df, label, prob, g)
    j = _join(_join(a, p, g), c, g)
    r = lambda x: F.bround(F.col(x), digits).alias(x)
    out = j.select(*g, "n", r("auc_roc"), r("f1"), r("average_precision"), r("precision_at_10pct"),
                   r("false_negative_rate"), "tn", "fp", "fn", "tp")
    return out.drop("__all") if "__all" in g and not group_cols else out


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    rb = b.withColumnsRenamed({k: f"__j_{k}" for k in keys})
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__j_{k}"))
        cond = e if cond is None else cond & e
    return a.join(rb, cond, "left").drop(*[f"__j_{k}" for k in keys])
