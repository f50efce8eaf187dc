"""Corpus pipeline: stages over ``documents``, each written and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All stages but the last return the columns of ``documents``; the last
returns the pieces of packed training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breaklens.llm.decontaminate import decontaminate
from breaklens.llm.near_dup import near_duplicates
from breaklens.llm.packing import pack_texts
from breaklens.llm.pii import redact_pii
from breaklens.llm.quality import keep_quality
from breaklens.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weakly supervised quality rejects go."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least id.

    Rows that share an id are one document, of which one row stays (the
    greatest text); rows without id are linked with nothing and all stay.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = (docs.join(kept, "doc_id", "left_semi").groupBy("doc_id")
           .agg(F.max(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*").select(*docs.columns))
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim window of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    clean = redact_pii(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024; one row per piece, with its ids."""
    pieces = pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("packing", packing),
]

#: The suffix arrays, MinHash classes, fitted models and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
