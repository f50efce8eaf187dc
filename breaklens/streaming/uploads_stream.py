"""Incremental ingestion of uploaded MI reports with Structured Streaming.

The reference ingests each uploaded file once (content-hash cache; a re-upload
is a no-op). On Spark the same contract is a file-source stream: the source's
checkpoint records every file already processed (exactly once per file, also
across restarts and executor loss), and each micro-batch goes through the
batch operators in ``foreachBatch``:

    new CSV files -> header aliases / dates -> pence->GBP, report_month,
    upload_hash (SHA-256 of each file's bytes) -> a delta of the ``breaks``
    snapshot -> append the upload log.

The log is written after the data and read before it: content that it names is
not ingested again, under whatever file name. A batch that ran before its log
was written runs again to the same rows; one that ran whole does nothing.

Nothing here is a new operator; it schedules S01-S11 incrementally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release, written
from ..sources import store as ST
from ..sources.csv import normalise_columns, normalise_na, parse_dates
from ..sources.uploads import prepare_for_ingest, read_upload_log


def upload_stream(spark: SparkSession, upload_dir: str, columns: list[str]) -> DataFrame:
    """Streaming frame of new CSV rows (all-string schema) with their source file."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    raw = (spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 16)
           .csv(upload_dir))
    # the name is an encoded URI; a plus sign in it is one
    return raw.withColumn("__file", F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))))


def _norm(path):
    """One spelling per file: ``file:///x`` and ``file:/x`` both become ``/x``."""
    return F.regexp_replace(path, "^file:/+", "/")


def _ingest_batch(batch: DataFrame, batch_id: int, snapshot_root: str, log_path: str) -> None:
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    # one small row per file of this micro-batch (bounded by maxFilesPerTrigger)
    paths = [r["__file"] for r in batch.select("__file").distinct().collect()]
    hashes = (spark.read.format("binaryFile").load(paths)
              .select(_norm(F.col("path")).alias("__fk"), F.sha2("content", 256).alias("upload_hash")))
    rows = parse_dates(normalise_columns(normalise_na(batch))).withColumn("__fk", _norm(F.col("__file")))
    known = read_upload_log(spark, log_path).select("upload_hash")
    # of files with the same content in this batch, the first by name counts
    new = (hashes.join(known, "upload_hash", "left_anti").groupBy("upload_hash").agg(F.min("__fk").alias("__fk")))
    rows = rows.join(F.broadcast(new), "__fk").drop("__fk", "__file")
    prepared = written(prepare_for_ingest(rows, None), "upload-batch")
    if prepared.isEmpty():
        release(prepared)
        return
    ST.append_upload(prepared, snapshot_root)
    log = (prepared.groupBy("upload_hash").agg(F.count(F.lit(1)).cast("int").alias("row_count"))
           .select(F.expr("uuid()").alias("upload_id"), "upload_hash",
                   F.lit(None).cast("string").alias("filename"), "row_count",
                   F.current_timestamp().alias("uploaded_at")))
    ST.append_table(log, log_path)
    release(prepared)


def start_upload_ingest(spark: SparkSession, upload_dir: str, snapshot_root: str, log_path: str,
                        checkpoint: str, columns: list[str], once: bool = True):
    """Start (or resume) the ingest stream; ``once`` processes what is there and stops."""
    stream = upload_stream(spark, upload_dir, columns)
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: _ingest_batch(b, i, snapshot_root, log_path)))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()

