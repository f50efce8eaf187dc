"""Persistent tables as Parquet snapshots.

* ``breaks`` - versioned snapshots: every ingest / write-back writes a NEW
  version folder (``v=<n>``), the newest one is current. A writer that dies
  mid-way leaves no half-written current version. An appended upload is a
  small delta folder (``d=<n>-<k>``) beside its version: the base is neither
  rewritten nor shuffled, readers merge, ``compact`` folds the deltas in.
  A version written with ``buckets`` is bucketed by id: a write-back joins
  bucket with bucket and moves no stored row.
* ``feedback`` / ``upload_log`` - append-only Parquet.

Upsert keeps the newest row per key: one aggregate of ``max(struct(ordinal,
row))`` per key - a declarative aggregate with map-side partial aggregation,
so a key repeated a million times is folded before the shuffle. That fold sorts
whole rows; an upload for a bucketed version is dealt out by id first and
sorted once, a key's rows then meet in one task (they stream, and may spill).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists

BREAKS_SCHEMA = T.StructType([
    T.StructField("break_id", T.StringType()),
    T.StructField("asset_class", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("team_code", T.StringType()),
    T.StructField("rec_name", T.StringType()),
    T.StructField("source_system", T.StringType()),
    T.StructField("break_open_date", T.DateType()),
    T.StructField("break_date", T.DateType()),
    T.StructField("report_date", T.DateType()),
    T.StructField("last_activity_date", T.DateType()),
    T.StructField("break_amount_pence", T.LongType()),
    T.StructField("break_amount_gbp", T.DoubleType()),
    T.StructField("net_amount_gbp", T.DoubleType()),
    T.StructField("gross_amount_gbp", T.DoubleType()),
    T.StructField("break_direction", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("approver", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("sla_days", T.IntegerType()),
    T.StructField("dq_score", T.DoubleType()),
    T.StructField("break_age_days", T.IntegerType()),
    T.StructField("days_since_last_move", T.IntegerType()),
    T.StructField("governance_completeness_score", T.DoubleType()),
    T.StructField("mad_score", T.DoubleType()),
    T.StructField("segment_median_age", T.DoubleType()),
    T.StructField("is_statistical_outlier", T.BooleanType()),
    T.StructField("offsetting_break_exists", T.BooleanType()),
    T.StructField("rolling_7d_autoclose_rate", T.DoubleType()),
    T.StructField("false_break_prob", T.DoubleType()),
    T.StructField("risk_tier", T.StringType()),
    T.StructField("pseudo_label", T.IntegerType()),
    T.StructField("label_confidence", T.DoubleType()),
    T.StructField("upload_hash", T.StringType()),
    T.StructField("report_month", T.StringType()),
])

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("feedback_id", T.StringType(), False),
    T.StructField("break_id", T.StringType(), False),
    T.StructField("analyst_label", T.IntegerType(), False),
    T.StructField("analyst_id", T.StringType()),
    T.StructField("feedback_timestamp", T.TimestampType()),
    T.StructField("model_prediction", T.DoubleType()),
    T.StructField("asset_class", T.StringType()),
    T.StructField("report_month", T.StringType()),
    T.StructField("override_flag", T.BooleanType()),
])

UPLOAD_LOG_SCHEMA = T.StructType([
    T.StructField("upload_id", T.StringType(), False),
    T.StructField("upload_hash", T.StringType(), False),
    T.StructField("filename", T.StringType()),
    T.StructField("row_count", T.IntegerType()),
    T.StructField("uploaded_at", T.TimestampType()),
])


def conform(df: DataFrame, schema: T.StructType = BREAKS_SCHEMA) -> DataFrame:
    """Project BY NAME onto a fixed schema (missing -> typed null, coercing casts)."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            src = df.schema[f.name].dataType
            c = F.col(f.name)
            if isinstance(f.dataType, T.BooleanType) and not isinstance(src, T.BooleanType):
                c = F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(
                    c.cast("string").try_cast("double") != 0)
            elif isinstance(f.dataType, T.DateType):
                c = c.try_cast("date") if isinstance(src, T.StringType) else c.cast("date")
            elif isinstance(f.dataType, (T.IntegerType, T.LongType)) and isinstance(src, (T.DoubleType,
                                                                                        T.FloatType)):
                c = F.when(F.isnan(c), None).otherwise(F.floor(c)).cast(f.dataType)
            else:
                c = c.try_cast(f.dataType) if not isinstance(src, type(f.dataType)) else c
            cols.append(c.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def newest_per_key(df: DataFrame, key: str = "break_id", ordinal: str | None = None,
                   parts: int | None = None) -> DataFrame:
    """One row per key - highest ``ordinal``; ties broken by the row itself
    (columns in schema order, nulls lowest), so identical keys resolve the same
    way on every run. ``parts``: rows are dealt out by key into so many parts
    first, instead of being folded (and sorted for it) where they are."""
    if parts is not None:
        df = df.repartition(parts, key)
    cols = [c for c in df.columns if c != ordinal]
    sort = ([F.col(ordinal)] if ordinal else []) + [F.col(c) for c in cols if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*sort)).alias("__best"))
    return best.select(*[F.col(key) if c == key else F.col("__best")[c].alias(c) for c in cols])


def newest_rows(new: DataFrame, key: str = "break_id", ordinal: Column | None = None) -> DataFrame:
    """The upload on the fixed schema, one row per key: the one with the greatest
    ``ordinal`` (a whole number over the columns of ``new``, such as the row's
    place in its file); equal or absent ordinals are decided by the row itself."""
    place = F.lit(0) if ordinal is None else F.coalesce(ordinal, F.lit(-1))
    typed = T.StructType([*BREAKS_SCHEMA.fields, T.StructField("__ord", T.LongType())])
    return newest_per_key(conform(new.withColumn("__ord", place.cast("bigint")), typed), key, "__ord")


def ingest(old: DataFrame | None, new: DataFrame, mode: str = "replace", key: str = "break_id",
           schema: T.StructType = BREAKS_SCHEMA, parts: int | None = None) -> DataFrame:
    """``replace`` = the new rows only; ``append`` = upsert (new wins per key).
    ``schema``: the columns that may differ between two rows of a key; ``parts`` as in :func:`newest_per_key`."""
    n = conform(new, schema)
    if mode == "replace" or old is None:
        return newest_per_key(n, key, parts=parts)
    o = conform(old, schema).withColumn("__ord", F.lit(0))
    return newest_per_key(o.unionByName(n.withColumn("__ord", F.lit(1))), key, "__ord", parts)


def write_back(table: DataFrame, updates: DataFrame, columns: Sequence[str],
               key: str = "break_id", bucketed: bool = False) -> DataFrame:
    """``UPDATE table SET cols FROM updates WHERE key = key``.

    Left join on the key; a matched row takes the new value, unmatched rows
    keep theirs. ``updates`` must be unique per key. ``bucketed``: the table lies
    in buckets by the key itself, and the updates of one bucket fit a task's memory.
    """
    u = updates.select(F.col(key).alias("__wk"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    if bucketed:  # the few columns of the updates are hashed, the stored rows stream past unsorted
        j = table.join(u.hint("shuffle_hash"), F.col(key) == F.col("__wk"), "left")
    else:
        # as an equality, in the form that updates joined null-safely by the same key are dealt out by already
        j = table.join(u, F.col(key).eqNullSafe(F.col("__wk")) & F.col(key).isNotNull(), "left")
    repl = {c: F.when(F.col("__wk").isNotNull(), F.col(f"__new_{c}")).otherwise(F.col(c))
            for c in columns}
    return j.withColumns(repl).select(*table.columns)


# ───────────────────────────── snapshot folders ─────────────────────────────

def _complete(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Names (without ``prefix``) of the finished folders of ``root``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    names = [(st.getPath().getName(), st.getPath()) for st in fs.listStatus(path)]
    return [n[len(prefix):] for n, p in names
            if n.startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in _complete(spark, root, "v="))


def _deltas(spark: SparkSession, root: str, version: int) -> list[int]:
    """Numbers of the deltas of a version, oldest first."""
    pairs = (n.split("-") for n in _complete(spark, root, "d="))
    return sorted(int(k) for v, k in pairs if int(v) == version)


# Input file bytes behind one bucket of a version
BUCKET_BYTES = 4 << 20


def _parquet_writer(df: DataFrame, key: str) -> DataFrameWriter:
    """Files with a bloom filter on the key: where rows are sorted by it, a point
    lookup opens the row groups that may hold it and no others. The filter is sized by
    the keys of its row group: the best of 11 sizes from 1 MB down to 1 KB (of 5, the least has 64 KB)."""
    return (df.write.format("parquet").mode("errorifexists").option("compression", "zstd")
            .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
            .option(f"parquet.bloom.filter.candidates.number#{key}", "11"))


def _table_name(path: str) -> str:
    """Name under which this session's catalog knows the buckets of a version."""
    return "breaklens_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def bucket_count(df: DataFrame) -> int:
    """Buckets for a version made of ``df``: one for each 4 MB of the files that it
    reads, so that they grow in number and not in size (a task sorts a bucket in
    memory); without files, as many as a shuffle has partitions."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return min(max(size // BUCKET_BYTES + 1, 2), 100_000)  # Spark takes no more; a single part isn't kept as a bucket


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    """Buckets of the version at ``path``; None if it has none, or another session wrote it."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        return None
    told = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
    return int(told["data_type"])


def write_snapshot(df: DataFrame, root: str, partition_by: str | None = "report_month", key: str = "break_id",
                   buckets: int | None = None) -> str:
    """Write a new immutable version; returns its path.

    With ``buckets`` the rows are dealt out by key into so many (rows that are already,
    aren't moved), and this session's catalog knows it; others read the same files plainly.
    """
    spark = df.sparkSession
    vs = _versions(spark, root)
    path = os.path.join(root, f"v={(vs[-1] + 1) if vs else 1}")
    parts = [partition_by] if partition_by and partition_by in df.columns else []
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")  # of a folder that was here before and is gone
    if buckets is None:
        w = _parquet_writer(df.sortWithinPartitions(*parts, key), key)
        (w.partitionBy(*parts) if parts else w).save(path)
    else:
        w = _parquet_writer(df.repartition(buckets, key), key).bucketBy(buckets, key).sortBy(key).option("path", path)
        (w.partitionBy(*parts) if parts else w).saveAsTable(_table_name(path))
    return path


def append_upload(new: DataFrame, root: str, ordinal: Column | None = None, key: str = "break_id") -> str:
    """S11 append + U02: the upload becomes a delta of the current version.

    Only the upload is deduplicated and written; rows of the snapshot with the
    same key are replaced when it is read. Without a snapshot the upload is its
    first version. Returns the path written.
    """
    spark = new.sparkSession
    rows = newest_rows(new, key, ordinal)
    vs = _versions(spark, root)
    if not vs:
        return write_snapshot(rows, root, key=key)
    ks = _deltas(spark, root, vs[-1])
    path = os.path.join(root, f"d={vs[-1]}-{(ks[-1] + 1) if ks else 1}")
    _parquet_writer(rows.sortWithinPartitions(key), key).save(path)
    return path


def load_snapshot(spark: SparkSession, root: str, schema: T.StructType = BREAKS_SCHEMA,
                  key: str = "break_id") -> DataFrame:
    """The current (newest complete) version with its deltas; filters push into the scans.

    Of several deltas with a key the newest one counts. Rows of the base stay
    where they are: they are only probed against the deltas' keys.
    """
    vs = _versions(spark, root)
    if not vs:
        return spark.createDataFrame([], schema)
    path = os.path.join(root, f"v={vs[-1]}")
    if _stored_buckets(spark, path) is not None:
        base = spark.table(_table_name(path)).select(*[F.col(f.name) for f in schema.fields])
    else:  # the fixed schema also types the partition column (an all-null one would read as VOID)
        base = spark.read.schema(schema).parquet(path)
    later = None
    for k in _deltas(spark, root, vs[-1]):
        one = spark.read.schema(schema).parquet(os.path.join(root, f"d={vs[-1]}-{k}")).select(base.columns)
        later = one if later is None else _replaced(later, one, key)
    return base if later is None else _replaced(base, later, key)


def _replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` with other keys (a null key is a key)."""
    keys = new.select(F.col(key).alias("__nk"))
    return old.join(keys, F.col(key).eqNullSafe(F.col("__nk")), "left_anti").unionByName(new)


def compact(spark: SparkSession, root: str) -> str | None:
    """A new version without deltas; returns its path (None if there is nothing to fold)."""
    vs = _versions(spark, root)
    if not vs or not _deltas(spark, root, vs[-1]):
        return None
    return write_snapshot(load_snapshot(spark, root), root)


def update_snapshot(spark: SparkSession, root: str, updates: Callable[[DataFrame], DataFrame],
                    columns: Sequence[str], key: str = "break_id") -> DataFrame:
    """S13 / S14 as one operation: ``updates`` of the stored rows (key and
    ``columns``) are written back as a new version, which is returned. A bucketed
    version without deltas gives one with the same buckets, and no stored row moves."""
    current = load_snapshot(spark, root, key=key)
    vs = _versions(spark, root)
    n = _stored_buckets(spark, os.path.join(root, f"v={vs[-1]}")) if vs and not _deltas(spark, root, vs[-1]) else None
    write_snapshot(write_back(current, updates(current), columns, key, n is not None), root, key=key, buckets=n)
    return load_snapshot(spark, root, key=key)


# ───────────────────────────── lookups ─────────────────────────────

def query_breaks(snapshot: DataFrame, asset_classes: Sequence[str] | None = None,
                 risk_tiers: Sequence[str] | None = None, limit: int | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """rows of the given classes and tiers. None or an empty list is no
    filter; unknown columns are an error; ``limit`` takes any so many rows."""
    rows = snapshot
    if asset_classes:
        rows = rows.where(F.col("asset_class").isin(*asset_classes))
    if risk_tiers:
        rows = rows.where(F.col("risk_tier").isin(*risk_tiers))
    if columns:
        unknown = [c for c in columns if c not in snapshot.columns]
        if unknown:
            raise ValueError(f"no such columns: {unknown}")
        rows = rows.select(*columns)
    return rows if limit is None else rows.limit(limit)


def break_by_id(snapshot: DataFrame, break_id: str) -> DataFrame:
    """the break with that id (0 or 1 row)."""
    return snapshot.where(F.col("break_id") == F.lit(break_id))


def append_table(df: DataFrame, path: str) -> None:
    """S09 / S12 sink: append-only Parquet."""
    df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An absent table reads as empty; any other failure is raised."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def csv_export(df: DataFrame, path: str) -> None:
    """Header CSV export."""
    df.write.mode("overwrite").option("header", True).csv(path)

