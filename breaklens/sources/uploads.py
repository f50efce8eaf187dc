"""Upload handling: content hash (S05), Parquet cache (S06), ingest prep (S07),
upload log (S09).

A directory of uploaded CSV files is hashed with ``binaryFile`` + ``sha2`` (one
task per file, bytes never reach the driver). Only files whose hash is not in
the upload log are parsed (``left_anti``); each new file is cached as Parquet
under ``<cache>/<hash>``, so a re-upload is a no-op.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..session import path_exists
from .csv import convert_pence, load_mi_report
from .store import BREAKS_SCHEMA, UPLOAD_LOG_SCHEMA, append_table, conform, ingest, read_table

PLACEHOLDER_TYPES = {
    "dq_score": "double", "false_break_prob": "double", "risk_tier": "string",
    "pseudo_label": "int", "label_confidence": "double", "break_age_days": "int",
    "days_since_last_move": "int", "governance_completeness_score": "double",
    "mad_score": "double", "segment_median_age": "double", "is_statistical_outlier": "boolean",
    "offsetting_break_exists": "boolean", "rolling_7d_autoclose_rate": "double",
}


def content_hashes(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, filename, upload_hash, length) for every file under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"),
                        F.sha2(F.col("content"), 256).alias("upload_hash"), "length")


def unseen_uploads(hashes: DataFrame, upload_log: DataFrame) -> DataFrame:
    """S06 (decision): uploads whose content hash is not logged yet."""
    seen = upload_log.select("upload_hash").distinct()
    return hashes.join(seen, "upload_hash", "left_anti")


def load_or_cache(spark: SparkSession, file_path: str, upload_hash: str, cache_dir: str) -> DataFrame:
    """Read ``<cache>/<hash>`` when it is complete, else parse the CSV and write it there.

    A folder without ``_SUCCESS`` is what a writer left that died; it is written anew.
    """
    target = f"{cache_dir.rstrip('/')}/{upload_hash}"
    if not path_exists(spark, f"{target}/_SUCCESS"):
        load_mi_report(spark, file_path).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def prepare_for_ingest(df: DataFrame, upload_hash: str | None) -> DataFrame:
    """Pence -> GBP, report_month, upload_hash and typed null placeholders."""
    out = convert_pence(df, C.PENCE_COLUMNS)
    if "report_date" in out.columns:
        month = F.date_format(F.col("report_date").cast("date"), "yyyy-MM")
    else:
        month = F.date_format(F.current_date(), "yyyy-MM")
    h = (F.lit(upload_hash).cast("string") if upload_hash is not None
         else F.col("upload_hash") if "upload_hash" in out.columns else F.lit(None).cast("string"))
    out = out.withColumns({"report_month": month, "upload_hash": h})
    missing = {c: F.lit(None).cast(t) for c, t in PLACEHOLDER_TYPES.items() if c not in out.columns}
    return out.withColumns(missing) if missing else out


def newest_prepared(df: DataFrame, upload_hash: str | None, parts: int | None = None) -> DataFrame:
    """S07 + S11 (replace): the prepared upload on the fixed schema, one row per break id.

    Columns that are the same in all rows or follow from an earlier one (hash,
    placeholders, month, GBP of the break's pence) can't decide between two rows of an id:
    they are added to the rows that stay, and aren't moved and sorted with all of them.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    sources = [c for c in ("report_date", "break_amount_pence") if c in types]
    if any(types[c] != BREAKS_SCHEMA[c].dataType for c in sources):  # the typed ones may give other months and amounts
        return ingest(None, prepare_for_ingest(df, upload_hash), "replace", parts=parts)
    later = {"report_month", *(["break_amount_gbp"] if "break_amount_pence" in types else []),
             *(["upload_hash"] if upload_hash is not None else [])}
    given = convert_pence(df, C.PENCE_COLUMNS)
    schema = T.StructType([f for f in BREAKS_SCHEMA.fields if f.name in given.columns and f.name not in later])
    return conform(prepare_for_ingest(ingest(None, given, "replace", schema=schema, parts=parts), upload_hash))


def log_uploads(new_uploads: DataFrame, row_counts: DataFrame | None, log_path: str) -> None:
    """Append (uuid, hash, filename, rows, now) for each newly ingested file."""
    rows = new_uploads
    if row_counts is not None:
        rows = rows.join(row_counts, "upload_hash", "left")
    else:
        rows = rows.withColumn("row_count", F.lit(None).cast("int"))
    out = rows.select(F.expr("uuid()").alias("upload_id"), "upload_hash", "filename",
                      F.col("row_count").cast("int").alias("row_count"),
                      F.current_timestamp().alias("uploaded_at"))
    append_table(out, log_path)


def read_upload_log(spark: SparkSession, log_path: str) -> DataFrame:
    return read_table(spark, log_path, UPLOAD_LOG_SCHEMA)


def ingest_directory(spark: SparkSession, upload_dir: str, cache_dir: str, log_path: str,
                     glob: str = "*.csv") -> DataFrame | None:
    """S05 -> S06 -> S07 -> S09 over a folder of uploads; returns the new rows (or None).

    The file list is bounded by the number of uploads, not by their size; the
    per-file loop only builds a plan per new upload.
    """
    hashes = content_hashes(spark, upload_dir, glob)
    # of files with the same content, one is loaded and logged
    new = (unseen_uploads(hashes, read_upload_log(spark, log_path)).groupBy("upload_hash")
           .agg(F.min(F.struct("path", "filename")).alias("file"))
           .select("file.path", "file.filename", "upload_hash"))
    files = new.collect()  # one small row per new file
    frames = []
    for f in files:
        df = load_or_cache(spark, f["path"], f["upload_hash"], cache_dir)
        frames.append(prepare_for_ingest(df, f["upload_hash"]))
    if not frames:
        return None
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr, allowMissingColumns=True)
    counts = out.groupBy("upload_hash").agg(F.count(F.lit(1)).alias("row_count"))
    log_uploads(new.select("upload_hash", "filename"), counts, log_path)
    return out

