import hashlib
import zlib

from pyspark.sql import functions as F

from breaklens.llm import merkle
from breaklens.llm.merkle import build, descend, digest, fold, leaf, merkle_manifest, siblings, tops
from breaklens.llm.order import positions

SCHEMA = "doc_id bigint, source string, text string, path int, n string"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 3 * 3
        out.append(("".join(level[lo:i]), "".join(level[i + 1:lo + 3])))
        i //= 3
    return out


def brute(rows, tamper):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row, plainly."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H("".join(map(field, r))), r))
    names = sorted(by, key=lambda s: b"" if s is None else b"s" + s.encode())
    trees = {s: (sorted(by[s], key=lambda x: x[:3]), climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])])) for s in names}
    crown = climb([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, h, r) in enumerate(trees[s][0]):
            steps = path(trees[s][1], i) + path(crown, k)
            got = tamper(r) or h
            for a, b in steps:
                got = H(a + got + b)
            out.append((r[0], h, trees[s][1][-1][0], crown[-1][0], H("".join(a + b for a, b in steps)), got))
    return sorted(out, key=str)


def run(docs):
    cols = [F.col(c) for c in ("doc_id", "source", "text")]
    odd = F.when(F.col("doc_id") % 3 == 0, leaf(*cols[:2], F.lit("forged")))
    m = merkle_manifest(docs, leaf(*cols), "source", "doc_id", {"doc_id": F.col("doc_id"), "odd": odd})
    return m.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))),
                    fold(F.coalesce("odd", "leaf"), F.col("path")))


def forged(r):
    return None if r[0] is None or r[0] % 3 else H(field(r[0]) + field(r[1]) + field("forged"))


def test_manifest_equals_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STAGE_LEVELS", 2)  # several stages on small trees
    rows = [(i, "hot", f"text {i}") for i in range(200)]
    rows += [(1000 + i, f"s{i % 11}", None if i % 5 == 0 else "é" * (i % 7)) for i in range(40)]
    rows += [(i, "exact", "x" * i) for i in range(81)] + [(5, "lone", "")]
    rows += [(None, None, None), (None, None, "null id"), (7, None, "tie"), (7, None, "tie"), (7, None, "other")]
    rows += [(3, "", "empty source"), (4, "é", "accent"), (4, "z", "last")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(7)
    assert sorted((tuple(r) for r in run(docs).collect()), key=str) == brute(rows, forged)


def test_whole_stages_and_one_tree(spark):
    rows = [(i, "one", "t" * (i % 13)) for i in range(250)]  # more than one block of 243
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in run(docs).collect()), key=str) == brute(rows, forged)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(empty).collect() == []
    (one,) = run(spark.createDataFrame([(1, "a", "b", 1, "x")], SCHEMA)).collect()
    assert one[1] == one[2] == one[3] and one[4] == H("")


def test_forest_keeps_columns_and_lone_roots(spark):
    nodes = spark.createDataFrame([("a", i, 4, H(str(i)), i * 10) for i in range(4)] + [("b", 0, 1, "d", 7)],
                                  "group string, pos bigint, n bigint, digest string, mine int")
    stages = build(nodes, "test")
    got = {r["group"]: r["digest"] for r in tops(stages).collect()}
    assert got == {"a": climb([H(str(i)) for i in range(4)])[-1][0], "b": "d"}
    crowns = tops(stages).select("group", F.array().cast("array<struct<left:string,right:string>>").alias("rest"))
    rows = descend(stages, crowns).collect()
    assert sorted((r["group"], r.pos, r.mine, len(r.path)) for r in rows) == [
        *(("a", i, i * 10, 2) for i in range(4)), ("b", 0, 7, 0)]


def test_positions_are_gapless_a_group(spark):
    rows = [(f"g{i % 3}", None if i % 10 == 0 else i % 50, i) for i in range(300)]
    got = positions(spark.createDataFrame(rows, "g string, k int, id int").repartition(5), ["k", "id"], "g").collect()
    for g in ("g0", "g1", "g2"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(100)) and {r.n for r in mine} == {100}
        assert [r.id for r in mine] == [x[2] for x in sorted((x for x in rows if x[0] == g),
                                                             key=lambda x: (x[1] is not None, x[1] or 0, x[2]))]


def test_query_crc_rule(spark, tmp_path):
    from breaklens.llm.queries import op13_merkle
    rows = [(i, f"line\n{i}" if i % 4 else None, "en", f"s{i % 2}", 5) for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_merkle(spark, str(tmp_path)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or r.doc_id % 4 == 0)
