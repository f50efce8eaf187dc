"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breaklens.session import written

#: Rows of one source block, at about this many; also of one piece of a shard.
BLOCK_ROWS = 1 << 16
#: Source blocks and pieces of a shard there are at least.
MIN_BLOCKS = 1024
MIN_PIECES = 64


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _hypergeometric(rng: random.Random, marked: int, other: int, draws: int) -> int:
    """Marked items among ``draws`` without replacement, by inversion from the mode outwards."""
    total = marked + other
    lo, hi = max(0, draws - other), min(draws, marked)
    if lo == hi:
        return lo
    mode = min(max((draws + 1) * (marked + 1) // (total + 2), lo), hi)
    lg = math.lgamma
    at_mode = math.exp(
        lg(marked + 1) - lg(mode + 1) - lg(marked - mode + 1) + lg(other + 1) - lg(draws - mode + 1)
        - lg(other - draws + mode + 1) - lg(total + 1) + lg(draws + 1) + lg(total - draws + 1))
    u = rng.random() - at_mode
    if u < 0:
        return mode
    up = down = mode
    p_up = p_down = at_mode
    while up < hi or down > lo:
        if up < hi:
            p_up *= (marked - up) * (draws - up) / ((up + 1) * (other - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > lo:
            p_down *= down * (other - draws + down) / ((marked - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode


def communication_matrix(block_rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows each block sends to each shard, as a uniform permutation would.

    Rows sum to the blocks' rows, columns to the shards' sizes. Block by block
    a multivariate hypergeometric draw, as a chain of univariate ones, takes
    the block's rows out of what the shards still lack.
    """
    rng = random.Random(seed)
    lacking, matrix = list(sizes), []
    for n in block_rows:
        row, left, rest = [], n, sum(lacking)
        for s, want in enumerate(lacking):
            rest -= want
            take = left if s == len(lacking) - 1 else _hypergeometric(rng, want, rest, left)
            row.append(take)
            left -= take
        lacking = [a - b for a, b in zip(lacking, row, strict=True)]
        matrix.append(row)
    return matrix


def uniform_shards(rows: DataFrame, shards: int, key_cols: list[str], seed: int = 7,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), uniformly shuffled.

    Shard sizes are exact: at most one apart. Rows are dealt into blocks of
    about ``block_rows`` by a hash of ``key_cols``; how many rows each block
    sends to each shard is drawn exactly, on the driver, out of the blocks'
    counts (one number per block). Each block is permuted by itself and cut by
    those numbers, the rows are exchanged, and each shard is permuted again, in
    pieces of a bounded size whose places in the shard are sums of the counts
    before. All ranks follow hashes of the keys, then all columns (maps as
    JSON), so a task that runs again places its rows as before.

    Nulls hash like values; rows that agree in all of ``key_cols`` share a
    block, and the counts stay exact, so ``key_cols`` should tell rows apart.
    An empty table stays empty. Columns called shard or slot are replaced, all
    others are kept.
    """
    rows = rows.drop("shard", "slot")
    own = [F.col(f"`{c}`") for c in rows.columns]
    key = [F.col(f"`{c}`") for c in key_cols]
    blocks = MIN_BLOCKS
    block = lambda: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(blocks))
    total = rows.count()
    blocks = max(MIN_BLOCKS, -(-total // block_rows))
    counts = {r["b"]: r["count"] for r in rows.groupBy(block().alias("b")).count().collect()}
    sizes = shard_sizes(total, shards)
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    ends = _table(rows.sparkSession, [list(accumulate(row)) for row in matrix])

    # every column decides among rows of one key, so that a task that runs again can't swap them
    tied = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c
            for c, f in zip(own, rows.schema.fields, strict=True)]
    in_block = Window.partitionBy("_block").orderBy("_order", *tied)
    placed = (rows.select(*own, block().alias("_block"), F.xxhash64(F.lit(seed + 1), *key).alias("_order"))
              .withColumn("_rank", F.row_number().over(in_block)).join(ends, "_block")
              .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
              .withColumn("_order", F.xxhash64(F.lit(seed + 2), "shard", *key)))
    pieces = max(MIN_PIECES, -(-max(sizes) // block_rows))
    placed = placed.select(*own, "shard", "_order",
                           F.pmod(F.xxhash64(F.lit(seed + 3), "shard", *key), F.lit(pieces)).alias("_piece"))
    before = Window.partitionBy("shard").orderBy("_piece")
    bases = (placed.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
             .select("shard", "_piece", (F.sum("_n").over(before) - F.col("_n")).alias("_base")))
    in_piece = Window.partitionBy("shard", "_piece").orderBy("_order", *tied)
    return (placed.withColumn("_at", F.row_number().over(in_piece) - 1).join(bases, ["shard", "_piece"])
            .select(*own, F.col("shard").cast("int").alias("shard"), (F.col("_base") + F.col("_at")).alias("slot")))


def _table(spark: SparkSession, ends: list[list[int]], step: int = 4096) -> DataFrame:
    """(_block, _ends) as a written table, out of JSON literals of ``step`` blocks each."""
    parts = [spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends[lo:lo + step])),
                                                            "array<array<bigint>>")).alias("_at", "_ends"))
             .select((F.col("_at") + lo).cast("bigint").alias("_block"), "_ends") for lo in range(0, len(ends), step)]
    return written(reduce(DataFrame.unionAll, parts), "matrix")
