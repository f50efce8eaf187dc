"""Flat binary token files: unsigned ids, 64-bit document offsets, and a manifest of prefix sums.

A data set is a folder with, per part, ``<name>.ids`` (little-endian unsigned
ids, 16 bits where the vocabulary allows it, else 32), ``<name>.off`` (64-bit
offsets into it, one more than documents) and ``<name>.doc`` (64-bit ids of
the documents, ascending; those without id first). ``manifest.json`` lists the
parts in order with the numbers of documents and ids before each.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breaklens.llm.tokens import encoder
from breaklens.llm.words import small_batches
from breaklens.session import ship_package

MANIFEST = "manifest.json"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[len("file:"):]
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        fs = pafs.LocalFileSystem(use_mmap=True)
    return fs, path


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes every row's whole text, appends ``end_id`` and writes the data set; returns its manifest.

    ``folder`` is a URI that the driver and all executors reach. Rows are
    dealt to parts by ranges of ``id_col`` (a whole number) and sorted within
    a part, equal ids by text. Each attempt of a task writes files of its own
    name, and the manifest names those of the attempts that succeeded, so a
    lost executor or a second attempt leaves no broken part. A null text is
    ``end_id`` alone; a null id sorts first. An empty table has no parts.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        fs, path = _filesystem(folder)
        enc = encoder(tokenizer_path)
        dtype = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        n_docs = n_null = n_ids = 0
        files = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                fs.create_dir(path, recursive=True)
                files = [fs.open_output_stream(f"{path}/{name}.{x}") for x in ("ids", "off", "doc")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            texts = (x.as_py() for x in pc.fill_null(batch.column(1), ""))
            lengths = []
            for ids in enc.encode(texts):
                found = np.frombuffer(ids + tail, "<u4")
                files[0].write(found.astype(dtype).tobytes())
                lengths.append(len(found))
            files[1].write((n_ids + np.cumsum(lengths)).astype("<i8").tobytes())
            files[2].write(pc.fill_null(batch.column(0), 0).to_numpy().astype("<i8").tobytes())
            n_docs, n_null = n_docs + len(lengths), n_null + batch.column(0).null_count
            n_ids += sum(lengths)
        if files is None:
            return
        for f in files:
            f.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "dtype": [dtype], "n_docs": [n_docs],
                                          "n_null": [n_null], "n_ids": [n_ids]})

    parts = sorted(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
                   .repartitionByRange("id").sortWithinPartitions("id", "text")
                   .mapInArrow(run, "part bigint, name string, dtype string, n_docs bigint, n_null bigint, n_ids bigint")
                   .collect())  # one short row per part
    docs_before = ids_before = 0
    listed = []
    for p in parts:
        listed.append(p.asDict() | {"docs_before": docs_before, "ids_before": ids_before})
        docs_before, ids_before = docs_before + p["n_docs"], ids_before + p["n_ids"]
    manifest = {"end_id": end_id, "n_docs": docs_before, "n_ids": ids_before, "parts": listed}
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{MANIFEST}") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, path = _filesystem(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, folder: str, batch_ids: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary, little-endian unsigned 32-bit).

    Every part is mapped into memory where the file system allows it, and read
    ``batch_ids`` ids at a time.
    """
    ship_package(spark)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    parts = [(p["part"], p["name"], p["dtype"], p["n_docs"], p["n_null"], p["ids_before"])
             for p in read_manifest(folder)["parts"]]
    listed = "part bigint, name string, dtype string, n_docs bigint, n_null bigint, ids_before bigint"
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches):
        fs, path = _filesystem(folder)
        for batch in batches:
            for p in batch.to_pylist():
                ids, off, doc = (fs.open_input_file(f"{path}/{p['name']}.{x}") for x in ("ids", "off", "doc"))
                width = np.dtype(p["dtype"]).itemsize
                offsets = np.frombuffer(off.read_at(8 * (p["n_docs"] + 1), 0), "<i8")
                keys = np.frombuffer(doc.read_at(8 * p["n_docs"], 0), "<i8")
                lo = 0
                while lo < p["n_docs"]:
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + batch_ids, "right")) - 1)
                    at, end = int(offsets[lo]), int(offsets[hi])
                    got = np.frombuffer(ids.read_at(width * (end - at), width * at), p["dtype"]).astype("<u4")
                    here = offsets[lo:hi + 1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[lo:hi], pa.int64(), mask=np.arange(lo, hi) < p["n_null"]),
                        pa.array(p["ids_before"] + here[:-1]), pa.array(np.diff(here)),
                        pa.array([got[a:b].tobytes() for a, b in zip(here[:-1] - at, here[1:] - at, strict=True)],
                                 pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    lo = hi

    return spark.createDataFrame(parts, listed).repartition(len(parts), "part").mapInArrow(run, schema)

