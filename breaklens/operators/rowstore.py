"""Rows written once and numbered, so that what is looked up for them comes back without moving them.

A wide row that is joined by one high-cardinality key after the other is
shuffled whole each time. Here the rows are written once as a bucketed table
(in the session's catalog, files in the shared scratch folder): each task
writes its rows to one bucket, nothing is exchanged for it. A look-up moves
only row numbers and keys; its results are dealt out to the same buckets and
joined bucket with bucket, in which no stored row moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, scratch_table
from ..sources.store import bucket_count

#: Number of a row (unique, fixed once written) and the key of the bucket that holds it.
ROW, PART = "__row", "__part"
#: More buckets don't come from more input; each then holds more rows, which are sorted for a join and may spill.
MOST_BUCKETS = 4096
#: Rows of a task that go to one bucket together.
CHUNK = 1 << 18
GOLDEN = (5 ** 0.5 - 1) / 2


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings ``spark.sql.<name>`` for the tables written inside; those before are put back."""
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(f"spark.sql.{k}", v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


@cache
def _one_key_a_bucket(n: int) -> tuple[int, ...]:
    """Numbers that fall into the buckets 0 to n-1, one each (a bucket that none is found for stays empty)."""
    key = F.col("id").cast("int")
    told = SparkSession.active().range(32 * n).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("bucket")).agg(F.min(key).alias("key"))
    of = {r["bucket"]: r["key"] for r in told.collect()}
    return tuple(of.get(b, b) for b in range(n))


def is_kept(df: DataFrame) -> bool:
    return {ROW, PART} <= set(df.columns)


def _buckets(rows: DataFrame) -> int:
    return rows.schema[PART].metadata["buckets"]


def _part(n: int) -> Column:
    """``PART`` of a ``ROW``. The number holds the task that wrote the row and the row's place there; ``CHUNK``
    rows in a row share a bucket, the chunks of tasks next to each other begin far apart."""
    task, place = F.shiftright(ROW, 33), F.col(ROW).bitwiseAND(F.lit((1 << 33) - 1))
    slot = F.floor(task * F.lit(GOLDEN * n)) + F.floor(place / F.lit(CHUNK))
    return F.get(F.lit(list(_one_key_a_bucket(n))), F.pmod(slot, F.lit(n)).cast("int"))


def _in_buckets(df: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` written into ``n`` buckets by its ``PART``. A task has few of them and opens a file for each instead of
    sorting its rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _settings(spark, maxConcurrentOutputFileWriters="64"):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, PART) \
            .saveAsTable(scratch_table(path))
    back = spark.table(scratch_table(path))
    back._scratch = path
    return back


def keep_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` written where it lies, its rows numbered. The number is fixed by the written
    file: a task that runs again replaces its files whole."""
    n = min(bucket_count(df), MOST_BUCKETS)
    rows = df.select("*", F.monotonically_increasing_id().alias(ROW))
    return _in_buckets(rows.select("*", _part(n).alias(PART, metadata={"buckets": n})), n, name)


def _dealt(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
    """What was ``found`` by ``ROW`` in the buckets of ``rows``, and the condition under which a row is the same."""
    n = _buckets(rows)
    other = found.withColumn(PART, _part(n)).repartition(n, PART).withColumnsRenamed({ROW: "__jr_row", PART: "__jr_part"})
    return other, (F.col(ROW) == F.col("__jr_row")) & (F.col(PART) == F.col("__jr_part"))


def mark(rows: DataFrame, some: DataFrame, flag: str, name: str) -> DataFrame:
    """The kept ``rows`` with a ``flag``: true for the row numbers of ``some``, else null. Only these are written.
    Readers that don't ask for the flag don't join them (the numbers are told to be distinct)."""
    n = _buckets(rows)
    own = _in_buckets(some.select(ROW, _part(n).alias(PART)).repartition(n, PART), n, name).distinct()
    other = own.select(F.col(ROW).alias("__jr_row"), F.col(PART).alias("__jr_part"), F.lit(True).alias(flag))
    same = (F.col(ROW) == F.col("__jr_row")) & (F.col(PART) == F.col("__jr_part"))
    return rows.join(other, same, "left").drop("__jr_row", "__jr_part")


def attach(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The kept ``rows`` written again, without their numbers but with the columns that ``found`` has by row number
    (at most once each), null for the rows that it lacks."""
    spark = rows.sparkSession
    other, same = _dealt(rows, found)
    out = rows.join(other, same, "left").drop(ROW, PART, "__jr_row", "__jr_part")
    path = scratch_path(spark, name)
    # rows that lie in buckets by PART alone meet by (ROW, PART) without an exchange
    with _settings(spark, requireAllClusterKeysForCoPartition="false"):
        out.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    back._scratch = path
    return back
