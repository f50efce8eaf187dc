"""Merkle manifest of a data set: a ternary tree a source, and one over the sources.

A tree is built in stages. A stage cuts the nodes of a group into aligned
blocks of ``3 ** STAGE_LEVELS``; a block keeps each of its levels as ONE string
of hex digests, 64 characters a node. A parent is the hash of a fixed-width
substring (three nodes) of the level below, and a node's siblings are the
substrings left and right of it in its run. The roots of the blocks are the
nodes of the next stage, until every group has one node left. No task sees
more than a block, however many documents a source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.llm.order import positions
from breaklens.session import written

#: Levels that one stage climbs; a block has 3 ** STAGE_LEVELS nodes.
STAGE_LEVELS = 5
#: Nodes of one run, and characters of a digest.
FAN, HEX = 3, 64
#: More levels than any table of 64-bit positions has.
_MOST_LEVELS = 40


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: `-` if null, else byte count, colon, value (integers decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Digest of a row: of its fields, each written so that no two rows read alike."""
    return digest(F.concat(*(field(f) for f in fields)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _parents(level: Column) -> Column:
    """The level above: every three digests of a level's string, hashed, joined."""
    def up(s: Column) -> Column:
        raw = s.cast("binary")
        runs = F.sequence(F.lit(0), F.ceil(F.length(s) / F.lit(FAN * HEX)).cast("int") - 1)
        return F.array_join(F.transform(
            runs, lambda i: F.sha2(F.substring(raw, i * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "")
    return _let(level, up)


def _levels(leaves: Column, climbs: Column) -> Column:
    """Strings of all levels of a block, lowest first, ``climbs`` of them above the leaves."""
    steps = F.when(climbs > 0, F.sequence(F.lit(1), climbs)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(leaves), lambda levels, _: F.array_append(
        levels, _parents(F.element_at(levels, -1))))


def _flanks(levels: Column, index: Column, climbs: Column) -> Column:
    """Siblings left and right of a node and of its ancestors, one pair a level."""
    def at(k: Column) -> Column:
        node = F.floor(index / F.element_at(F.array(*(F.lit(FAN**j) for j in range(STAGE_LEVELS))), k + 1))
        start = (F.floor(node / FAN) * (FAN * HEX)).cast("int")
        own = (node % FAN * HEX).cast("int")
        run = F.substring(F.element_at(levels, k + 1).cast("binary"), start + 1, F.lit(FAN * HEX))
        return _let(run, lambda r: F.struct(
            F.substring(r, F.lit(1), own).cast("string").alias("left"),
            F.substring(r, own + HEX + 1, F.lit(FAN * HEX)).cast("string").alias("right")))
    steps = F.when(climbs > 0, F.sequence(F.lit(0), climbs - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, at)


def build(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The stages of a forest, lowest first, each a written table of one row a block.

    ``nodes`` has group (string, not null), pos (gapless from 0 within its
    group), n (nodes of the group) and digest; further columns stay with the
    lowest stage. A block has its group, number, ``levels`` (one string a
    level), ``climbs`` (levels above its nodes) and ``items``, the rows of its
    nodes in order. Every group of the highest stage is one block, whose last
    level is what remains of the group.
    """
    width = FAN**STAGE_LEVELS
    stages: list[DataFrame] = []
    while True:
        # levels above these nodes: the least L with 3 ** L nodes or more, less those of the stages below
        height = F.size(F.filter(F.array(*(F.lit(FAN**k) for k in range(_MOST_LEVELS - 1))), lambda p: p < F.col("n")))
        climbs = F.least(F.greatest(height - len(stages) * STAGE_LEVELS, F.lit(0)), F.lit(STAGE_LEVELS))
        rest = [c for c in nodes.columns if c not in ("group", "pos", "n", "digest")]
        blocks = written(
            nodes.groupBy("group", F.floor(F.col("pos") / width).alias("block"), "n")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *rest))).alias("items"))
            .withColumn("climbs", climbs)
            .withColumn("levels", _levels(F.array_join(F.col("items.digest"), ""), F.col("climbs"))),
            f"{name}-{len(stages)}")
        stages.append(blocks)
        if not blocks.where("block > 0").take(1):
            return stages
        nodes = blocks.select("group", F.col("block").alias("pos"), "n", F.element_at("levels", -1).alias("digest"))


def tops(stages: list[DataFrame]) -> DataFrame:
    """(group, digest): what remains of each group; a lone node remains itself."""
    return stages[-1].select("group", F.element_at("levels", -1).alias("digest"))


def descend(stages: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """The rows of the lowest stage, each with its ``path`` and the columns of its group's row in ``crowns``.

    A path is an array of left and right siblings, a pair a level, lowest
    first, and ends with ``rest`` of the crown. Blocks are joined to what
    stands above them before they are unfolded, so paths are never moved row
    by row.
    """
    told = [c for c in crowns.columns if c not in ("group", "rest")]
    above = crowns.select("group", F.lit(0).cast("bigint").alias("block"), "rest", *told)
    for blocks in reversed(stages):
        member = F.transform("items", lambda x, i: F.struct(
            x.alias("item"), _flanks(F.col("levels"), i, F.col("climbs")).alias("path")))
        rows = (blocks.join(above, ["group", "block"])
                .select("group", "rest", *told, F.explode(member).alias("member"))
                .select("group", "member.item.*", F.concat("member.path", "rest").alias("path"), *told))
        above = rows.select("group", F.col("pos").alias("block"), F.col("path").alias("rest"), *told)
    return rows


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(
        F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def merkle_manifest(rows: DataFrame, leaf_col: Column, source: str, key: str, carry: dict[str, Column]) -> DataFrame:
    """The manifest of ``rows``: per row leaf, subroot, root and its whole ``path`` to the root.

    ``leaf_col`` is the digest of a row, ``source`` (a string column) names its
    tree, ``key`` orders the leaves of a tree; ``carry`` are further columns to
    keep, by name, which shouldn't repeat long texts since they are moved with
    the leaves. Only digests and these columns are moved, texts never.

    A null source is a tree of its own, before all others. Leaves ascend by
    ``key``, null first, rows of one key by their digests, so equal rows are
    leaves of their own that stand side by side. An empty table gives an empty
    manifest. Other columns of ``rows`` aren't looked at.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit(""))
    leaves = positions(rows.select(
        tree.alias("group"), F.col(f"`{key}`").alias("_key"), leaf_col.alias("digest"),
        *(c.alias(f"c{i}") for i, c in enumerate(carry.values()))), ["_key", "digest"], "group", "leaves")
    trees = build(leaves.drop("_key"), "trees")
    subroots = positions(tops(trees), ["group"], None, "subroots").withColumnsRenamed({"group": "tree"})
    crown = build(subroots.withColumn("group", F.lit("")), "crown")
    roots = tops(crown).select("group", F.array().cast("array<struct<left:string,right:string>>").alias("rest"),
                               F.col("digest").alias("root"))
    crowns = descend(crown, roots).select(F.col("tree").alias("group"), F.col("path").alias("rest"),
                                          F.col("digest").alias("subroot"), "root")
    return descend(trees, crowns).select(
        F.col("digest").alias("leaf"), "subroot", "root", "path",
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))
