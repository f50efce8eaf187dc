"""Exact, distributed ranks and running totals.

Spark's ``Window.orderBy`` without ``partitionBy`` moves every row into ONE
task. The operators here avoid that, with one plan at every size:

1. ``repartitionByRange`` deals the rows out by their sort key (group columns
   first, then order columns); equal keys share a bucket, and a bucket is the
   number of its partition. The dealt rows are written once, so totals and
   ranks read the same buckets;
2. per-(group, bucket) totals - at most ``#groups + #buckets`` rows - give the
   exclusive offsets; the window then runs per (group, bucket).

Inputs are expected to be *aggregated first* (one row per distinct key with a
weight), which removes hot keys before anything is shuffled by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import MATERIALIZE_CONF, conf_str, ensure_checkpoint_dir, scratch_path, written

_B = "__rk_bucket"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back. Survives executor loss, and
    later readers prune columns and push filters into the scan.

    ``breaklens.rank.materialize=none`` keeps the lineage instead (recompute).
    """
    spark = df.sparkSession
    mode = conf_str(spark, MATERIALIZE_CONF, "parquet")
    if mode == "none":
        return df
    if mode == "checkpoint":
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def running_totals(df: DataFrame, order: Sequence[Column | str], sums: Sequence[str] = (),
                   group_cols: Sequence[str] = (), buckets: int | None = None,
                   prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sums`` within each group, in ascending ``order``.

    Adds ``pos`` (1-based position within the group), ``<prefix><s>`` for every
    ``s`` in ``sums``, plus ``group_rows`` / ``group_<s>`` (group totals).
    ``order`` must be unique within a group for a deterministic result (callers
    aggregate to distinct keys first; descending order = negate the value).
    ``buckets`` defaults to the session's shuffle partitions.
    """
    one = "__rk_one"
    keys = {f"__rk_o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.withColumns(keys | {one: F.lit(1).cast("long")})
             .repartitionByRange(n, *group_cols, *keys).withColumn(_B, F.spark_partition_id()))
    b = written(dealt, "rank-input")
    vals = [one] + list(sums)
    totals = b.groupBy(*group_cols, _B).agg(*[F.sum(v).alias(v) for v in vals])
    gw = Window.partitionBy(*group_cols).orderBy(_B)
    gall = Window.partitionBy(*group_cols)
    offs = totals.select(
        *group_cols, _B,
        *[F.coalesce(F.sum(v).over(gw.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"__off_{v}") for v in vals],
        *[F.sum(v).over(gall).alias(f"__tot_{v}") for v in vals],
    )
    w = (Window.partitionBy(*group_cols, _B).orderBy(*keys)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = b.select("*", *[F.sum(v).over(w).alias(f"__run_{v}") for v in vals])
    on = list(group_cols) + [_B]
    offs = offs.withColumnsRenamed({k: f"__ok_{k}" for k in on})
    cond = None
    for k in on:
        e = F.col(k).eqNullSafe(F.col(f"__ok_{k}"))
        cond = e if cond is None else cond & e
    j = ranked.join(offs, cond, "left")
    out_cols = [F.col(c) for c in df.columns]
    out_cols.append((F.col(f"__run_{one}") + F.col(f"__off_{one}")).alias("pos"))
    out_cols.append(F.col(f"__tot_{one}").alias("group_rows"))
    for s in sums:
        out_cols.append((F.col(f"__run_{s}") + F.col(f"__off_{s}")).alias(f"{prefix}{s}"))
        out_cols.append(F.col(f"__tot_{s}").alias(f"group_{s}"))
    return j.select(*out_cols)


def dense_ids(df: DataFrame, key_cols: Sequence[str], order: Sequence[Column | str] | None = None,
              group_cols: Sequence[str] = (), id_col: str = "id", base: int = 0) -> DataFrame:
    """Number the DISTINCT ``key_cols`` combinations in sorted order (0-based by default)."""
    keys = df.select(*group_cols, *key_cols).distinct()
    order = list(order) if order is not None else list(key_cols)
    r = running_totals(keys, order, group_cols=group_cols)
    return r.select(*group_cols, *key_cols, (F.col("pos") - 1 + base).cast("long").alias(id_col))


def _octave(v: Column) -> Column:
    """Whole number that never falls as ``v`` grows: sign and 1/64 octave of the size."""
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1100.0)) + 1100.0) * 64) + 1
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def middle_values(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group out of its parts (in order of ``__d``, each with count, least and
    greatest value): the middle values ``__a`` and ``__b``, null where the part that
    holds them doesn't tell, and that part's range and the rows before it."""
    group = Window.partitionBy(*keys)
    running = F.sum("__c").over(group.orderBy("__d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.withColumn("__before", F.col("__skip") + running - F.col("__c")).drop("__d", "__skip")
    if "n" not in parts.columns:
        parts = parts.withColumn("n", F.sum("__c").over(group))
    first, last = F.col("__before"), F.col("__before") + F.col("__c") - 1
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def value(at: Column) -> Column:
        told = F.when((at == first) | (F.col("__lo") == F.col("__hi")), F.col("__lo")).when(at == last, F.col("__hi"))
        return F.max(F.when(at.between(first, last), told))

    of_lower = lambda c: F.max(F.when(lower.between(first, last), F.col(c))).alias(c)
    return parts.groupBy(*keys).agg(value(lower).alias("__a"), value(upper).alias("__b"), F.max("n").alias("n"),
                                    of_lower("__lo"), of_lower("__hi"), of_lower("__before"))


def exact_quantile_pair(df: DataFrame, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact median per group, the mean of the two middle values (nulls and NaN ignored).

    Selection by digits: values are counted per (group, digit), and only the part
    that holds a group's middle is divided again - by 1/64 octaves first, then into
    4096 equal steps between the part's least and greatest value, which always
    separates the two. A group is done when its middle is an end of its part, which
    takes two rounds as a rule and five at most. One aggregate a round serves all
    groups; no value is ranked and a hot group folds map-side.

    ``df`` is read once a round. Returns ``group_cols + [median, n]``; a group
    without values has no row, a null group is a group.
    """
    keys = list(group_cols)
    v = F.col("__v")
    values = (df.select(*keys, F.col(value).cast("double").alias("__v"))
              .where(v.isNotNull() & ~F.isnan(v)))
    count = [F.count(F.lit(1)).alias("__c"), F.min(v).alias("__lo"), F.max(v).alias("__hi")]
    parts = values.groupBy(*keys, _octave(v).alias("__d")).agg(*count).withColumn("__skip", F.lit(0).cast("long"))
    told = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    found = None
    while True:
        middle = written(middle_values(parts, keys), "middle").where("n is not null")
        done = middle.where(told).select(*keys, ((F.col("__a") + F.col("__b")) / 2.0).alias("median"), "n")
        found = done if found is None else found.unionByName(done)
        open_ = middle.where(~told)
        if open_.isEmpty():
            return found
        of_part = ["n", "__from", "__to", "__skip"]
        open_ = open_.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "n", F.col("__lo").alias("__from"),
                             F.col("__hi").alias("__to"), F.col("__before").alias("__skip"))
        inside = v.between(F.col("__from"), F.col("__to"))
        if keys:
            same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
            rest = values.join(open_, [*same, inside])
        else:
            row = open_.first()
            rest = values.withColumns({c: F.lit(row[c]) for c in of_part}).where(inside)
        step = F.floor((v - F.col("__from")) / (F.col("__to") - F.col("__from")) * 4096)
        parts = rest.groupBy(*keys, *of_part, step.alias("__d")).agg(*count).drop("__from", "__to")
