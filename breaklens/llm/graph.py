"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.session import release, written

#: Edges of one file of a round, and files of small rounds: with a file for every shuffle partition,
#: rounds of few edges are mostly spent on files.
FILE_EDGES, LEAST_FILES = 1 << 17, 16


def _large_star(e: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Link every node and its lesser neighbours to the least of them (``v < u`` in every edge)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges`` that isn't its component's least node.

    A node's neighbours are never gathered: the least of them is a partial
    aggregate, and it is joined back. Every round is written to the shared
    folder, in files sized by the number of edges (``edges`` is read twice).
    Loops, repeated edges and null ends are ignored.
    """
    files = max(LEAST_FILES, -(-edges.count() // FILE_EDGES))
    e = written(edges.where(F.col(a) != F.col(b))
                .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().coalesce(files), "edges")
    before = None
    while True:
        after = written(_small_star(_large_star(e)).coalesce(files), "edges")  # no round makes edges
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(e)
        e = after
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
