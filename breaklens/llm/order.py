"""Gapless positions of the rows of a very large table in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breaklens.session import written

#: ``monotonically_increasing_id`` numbers the rows of a partition in its lower 33 bits.
_ROW_BITS = 33


def positions(rows: DataFrame, order: list[str], group: str | None = None, name: str = "order") -> DataFrame:
    """``rows`` with ``pos``, gapless from 0 in ascending ``order`` (nulls first) within each value of ``group``,
    and ``n``, the rows of the group.

    The rows are dealt out by ranges of (group, order), sorted within a
    partition and written once with their number there; a group's rows in one
    partition are a run, and the runs before (at most one a partition and
    group) give its first position. No window holds more rows than there are
    partitions, whatever the size of a group. Rows that agree in all of
    ``order`` share a partition and stand in any order among each other, so
    ``order`` should tell rows apart. ``group`` must not be null. Columns
    called pos or n are replaced. An empty table stays empty.
    """
    keys = [group] if group else []
    own = [c for c in rows.columns if c not in ("pos", "n")]
    by = [F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]]
    dealt = written(rows.select(*(f"`{c}`" for c in own)).repartitionByRange(*by).sortWithinPartitions(*by)
                    .withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", _ROW_BITS).alias("_part")
    runs = (dealt.groupBy(part, *(F.col(f"`{k}`").alias("_run") for k in keys))
            .agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    whole = Window.partitionBy(*("_run" for _ in keys))
    starts = runs.select("_part", *("_run" for _ in keys), F.sum("_n").over(whole).alias("_all"),
                         (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    same = F.shiftright("_at", _ROW_BITS) == F.col("_part")
    for k in keys:
        same &= F.col(f"`{k}`") == F.col("_run")
    return dealt.join(starts, same).select(*(F.col(f"`{c}`") for c in own),
                                           (F.col("_at") + F.col("_shift")).alias("pos"), F.col("_all").alias("n"))
