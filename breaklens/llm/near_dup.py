"""Near-duplicate documents: one-permutation MinHash, bands, star-shaped candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.llm.graph import components
from breaklens.llm.oph import OnePermutation, band_keys, distinct
from breaklens.llm.words import SPACED, mix, slices, small_batches, windows, words
from breaklens.session import release, ship_package, written

SHINGLE_WORDS = 5
SIMILARITY = (75, 100)
N_BINS = 128
BAND_ROWS = 4
#: Members of one block of a bucket, when a bucket's components are compared in full.
BLOCK = 384
#: Documents of one file of the tables in between, and files of small ones: a file for every shuffle
#: partition makes executors spend their time, and processes, on files.
FILE_ROWS, LEAST_FILES = 1 << 13, 16
#: A class of this share of all rows or more (so there are at most so many) is joined by broadcast.
HOT_SHARE = 1000


def _list_array(flat: np.ndarray, base: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(base, pa.int32()), pa.array(flat, kind))


def _shingle_sets(text: pa.Array, k: int):
    """(first row, sorted distinct shingle hashes of each row) slice by slice."""
    for lo, hi, data, off in slices(text):
        w = words(data, off, SPACED)
        s, _, base = windows(w.hash, w.base, k, short=True)
        yield lo, [distinct(s[base[i]:base[i + 1]]) for i in range(hi - lo)]


def shingle_features(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE_WORDS,
                     n_bins: int = N_BINS, band_rows: int = BAND_ROWS) -> DataFrame:
    """id, n_shingles, a 128-bit set fingerprint (f1, f2) and the band keys of every row."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    opener = OnePermutation(n_bins)

    def run(batches):
        for batch in batches:
            n, f1, f2, keys, base = [], [], [], [], [0]
            for _, sets in _shingle_sets(batch.column(1), k):
                filled = [s for s in sets if len(s)]
                if filled:
                    keys.append(band_keys(np.stack([opener.signature(s) for s in filled]), band_rows).ravel())
                for s in sets:
                    n.append(len(s))
                    f1.append(int(s.sum(dtype=np.uint64)))
                    f2.append(int(mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    base.append(base[-1] + (n_bins // band_rows if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()),
                pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)),
                _list_array(flat.view(np.int64), np.array(base), pa.int64())],
                names=["id", "n_shingles", "f1", "f2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE_WORDS) -> DataFrame:
    """id and the sorted distinct 64-bit shingle hashes of every row's whole text."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, sets in _shingle_sets(batch.column(1), k):
                base = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(sets)),
                    _list_array(np.concatenate(sets).view(np.int64), base, pa.int64())], names=["id", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, shingles array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, by exact counts."""
    num, den = similarity
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    na, nb = F.size("sa"), F.size("sb")
    return (both.where((F.least(na, nb) * den >= F.greatest(na, nb) * num))
            .withColumn("common", F.size(F.array_intersect("sa", "sb")))
            .where(F.col("common") * (den + num) >= (na + nb) * num).select("a", "b"))


def _block_links(similarity: tuple[int, int]):
    """Links across components inside two blocks of one bucket, by counts over 31 bits
    of each shingle hash: no link is missed, and :func:`confirm` drops a chance one."""
    num, den = similarity

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        comp = t.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        ids, sets = t.column("id").combine_chunks(), t.column("s32").combine_chunks()
        base = sets.offsets.to_numpy()
        size = np.diff(base)
        _, code = np.unique(sets.values.to_numpy()[base[0]:base[-1]], return_inverse=True)
        who = np.repeat(np.arange(len(size)), size)
        order = np.argsort(code, kind="stable")
        holders, first = who[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
        base, a, b = base - base[0], [], []
        for i in range(len(size) - 1):
            if (comp[i + 1:] == comp[i]).all():
                continue
            own = code[base[i]:base[i + 1]]
            lo, n = first[own], first[own + 1] - first[own]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(holders[at], minlength=len(size))
            hit = np.flatnonzero((common * (den + num) >= (size[i] + size) * num) & (comp != comp[i]))
            hit = hit[hit > i]
            a.append(np.full(len(hit), i))
            b.append(hit)
        a, b = (pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b))
        return pa.table({"a": ids.take(a), "b": ids.take(b)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                    similarity: tuple[int, int] = SIMILARITY, n_bins: int = N_BINS,
                    band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, kept.

    Two documents are linked if their sets of distinct ``k``-word shingles have
    a Jaccard similarity of at least ``similarity`` (a fraction, compared in
    whole numbers); component_id is the least id reachable over links, kept is
    ``id = component_id``.

    Equal sets count once, as the class of their least id. Classes that agree
    on a whole band of the signature share a bucket. A bucket proposes two
    stars: its least and its greatest id against every member, so the pairs
    grow with its members and not with their square. Links are confirmed on
    full sets. Buckets that still hold several components have their other
    members compared across components in blocks, so that no link between
    members of a bucket is lost; a block pair is one task's bounded work.

    Null, empty and white-space texts have an empty set and are linked with
    nothing. Rows that share an id are one document, linked if any of its
    texts is. A row without id is its own component (null) and kept. Other
    columns of ``docs``, whatever their names, are not looked at.
    """
    docs = docs.select(id_col, text_col)
    files = max(LEAST_FILES, -(-docs.count() // FILE_ROWS))
    docs = docs.coalesce(files)  # only ever fewer
    feats = written(shingle_features(docs, id_col, text_col, k, n_bins, band_rows), "oph")
    classes = (feats.where("n_shingles > 0 and id is not null").groupBy("f1", "f2")
               .agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    reps = feats.join(classes.select(F.col("rep").alias("id"), "f1", "f2"), ["id", "f1", "f2"], "left_semi")
    members = written(reps.select("id", F.explode("bands").alias("bucket")).distinct()
                      .join(reps.select(F.explode("bands").alias("bucket")).groupBy("bucket")
                            .agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "bucket").coalesce(files), "buckets")
    hubs = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    held = members.join(hubs, "bucket")
    stars = (held.select(F.explode(F.array("lo", "hi")).alias("hub"), "id").where("hub <> id")
             .select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct())
    wanted = members.select("id").distinct()
    sets = written(shingle_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                                .join(wanted, "id", "left_semi").coalesce(files), "id", "text", k), "sets")
    links = written(confirm(stars, sets, similarity).coalesce(files), "links")

    roots = components(links, "a", "b")
    rest = (held.where("id <> lo and id <> hi").select("bucket", "id")
            .join(roots.withColumnRenamed("node", "id"), "id", "left")
            .select("bucket", "id", F.coalesce("root", "id").alias("root")))
    mixed = (rest.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"))
             .where("r0 < r1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    rest = written(rest.join(mixed, "bucket").coalesce(files), "rest")
    short = sets.join(rest.select("id").distinct(), "id", "left_semi").select(
        "id", F.transform("shingles", lambda s: (s % 2147483647).cast("int")).alias("s32"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    crossed = (rest.withColumn("mine", mine)
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("bucket", F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"),
                       "id", "root").join(short, "id"))
    kind = docs.schema[id_col].dataType.simpleString()
    more = (crossed.groupBy("bucket", "b0", "b1").applyInArrow(_block_links(similarity), f"a {kind}, b {kind}")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = written(confirm(more, sets, similarity).coalesce(files), "links")

    roots = components(links.unionByName(more), "a", "b")
    release(members, sets, rest, links, more)
    found = (classes.join(roots, F.col("rep") == F.col("node"), "left")
             .select("f1", "f2", F.coalesce("root", "rep").alias("found"), "n"))
    rows = feats.select("id", "n_shingles", "f1", "f2")
    large = F.col("n") * HOT_SHARE >= feats.count()  # so at most HOT_SHARE classes
    hot = F.broadcast(found.where(large).drop("n"))
    found = (rows.join(hot, ["f1", "f2"])
             .unionByName(rows.join(hot, ["f1", "f2"], "left_anti")
                          .join(found.where(~large).drop("n"), ["f1", "f2"], "left")))
    return (found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("id")))
            .withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
            .select(F.col("id").alias(id_col), "n_shingles", "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
