import random
import zlib

from breaklens.llm.sharding import _hypergeometric, communication_matrix, shard_sizes, uniform_shards


def test_matrix_keeps_both_margins():
    blocks, sizes = [0, 5, 1000, 17, 3], shard_sizes(1025, 4)
    for seed in range(20):
        m = communication_matrix(blocks, sizes, seed)
        assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m)] == sizes


def test_draws_follow_the_hypergeometric_law():
    rng = random.Random(1)
    draws = [_hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    mean = sum(draws) / len(draws)
    var = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - 6) < 0.05 and abs(var - 20 * 0.3 * 0.7 * 80 / 99) < 0.1
    assert _hypergeometric(rng, 10**9, 10**10, 10**7) > 0


def test_shards_are_exact_and_gapless(spark, make, edges, write_prose):
    rows = [(i, write_prose(3)) for i in range(500)] + edges + [(7, "same")] * 40
    got = uniform_shards(make(rows, extra=True).withColumnRenamed("score", "shard"), 7, ["doc_id", "text"]).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, rows))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, by.values()), reverse=True) == shard_sizes(len(rows), 7)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shuffle_is_uniform(spark, make):
    hits = [0] * 4
    first = 0
    for seed in range(30):
        for r in uniform_shards(make([(i, None) for i in range(40)]), 4, ["doc_id"], seed=seed).collect():
            if r.doc_id == 3:
                hits[r.shard] += 1
                first += r.slot
    assert max(hits) < 18 and 2.5 < first / 30 < 6.5


def test_same_seed_same_places_and_empty_table(spark, make):
    docs = make([(i, str(i)) for i in range(100)])
    runs = [sorted((r.doc_id, r.shard, r.slot) for r in uniform_shards(d, 3, ["doc_id"]).collect())
            for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1]
    assert uniform_shards(make([]), 3, ["doc_id"]).count() == 0
    assert zlib.crc32(b"") == 0


def test_rows_of_one_key_have_fixed_places(spark):
    """Rows that agree in the key only are told apart by the other columns, maps included."""
    docs = spark.range(0, 400).selectExpr("1L as doc_id", "id as n", "map('a', id % 7) as m", "id % 5 as `a.b`")
    runs = [sorted((r.n, r.shard, r.slot) for r in uniform_shards(d, 3, ["doc_id"]).collect())
            for d in (docs, docs.orderBy("n", ascending=False).repartition(5))]
    assert runs[0] == runs[1] and len({(s, t) for _, s, t in runs[0]}) == 400
