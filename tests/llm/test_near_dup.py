import random
import re

import numpy as np

from breaklens.llm.graph import components
from breaklens.llm.near_dup import near_duplicates
from breaklens.llm.oph import OnePermutation, distinct
from breaklens.session import written


def brute(rows, k=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or (a and b and 100 * len(a & b) >= 75 * len(a | b) and rows[i][0] is not None and rows[j][0] is not None):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def corpus(write_prose, seed=1):
    rng, rows = random.Random(seed), []
    for g in range(12):
        base = write_prose(60).split()
        for c in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.random():.6f}"
            rows.append((g * 20 + c, " ".join(w)))
    return rows


def test_components_equal_brute_force(spark, make, edges, write_prose):
    rows = corpus(write_prose) + edges
    got = near_duplicates(make(rows, extra=True), block=2).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id)
                  for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_find_links_that_both_stars_miss(spark, make):
    # least and greatest id are far from all; the members between are linked only to one another
    words = [f"w{i}" for i in range(80)]
    rows = [(0, " ".join(words[:40] + [f"p{i}" for i in range(14)])), (99, " ".join(words[:40] + [f"q{i}" for i in range(14)]))]
    rows += [(10 + i, " ".join(words[:40] + [f"r{j}" for j in range(13)] + [f"z{i}"])) for i in range(6)]
    got = near_duplicates(make(rows), n_bins=64, band_rows=1, block=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_empty_table(make):
    assert near_duplicates(make([])).count() == 0


def test_densified_bins_agree_about_as_often_as_sets():
    rng = np.random.Generator(np.random.PCG64(1))
    one = OnePermutation(128)
    for n in (4, 40, 4000):
        agree = []
        for _ in range(60):
            h = rng.integers(0, 2**64, n + n // 4, dtype=np.uint64)
            agree.append((one.signature(distinct(h[:n])) == one.signature(distinct(h))).mean())
        assert abs(np.mean(agree) - n / (n + n // 4)) < 0.06


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5), (100, 101)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    assert {r.node: r.root for r in got.collect()} == {i: 0 for i in range(1, 31)} | {101: 100, 102: 100}


def test_small_tables_are_few_files(spark, make, write_prose, monkeypatch):
    from breaklens.llm import graph, near_dup

    files = []

    def counted(df, name):
        out = written(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "written", counted)
    monkeypatch.setattr(near_dup, "written", counted)
    texts = [write_prose(40) for _ in range(40)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = make([(i, texts[i % 40]) for i in range(400)]).repartition(64)
        rows = near_duplicates(docs).collect()
        roots = components(spark.range(2000).selectExpr("id as a", "id - id % 10 as b"), "a", "b").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in rows} == {i: i % 40 for i in range(400)}
    assert {r.node: r.root for r in roots} == {i: i - i % 10 for i in range(2000) if i % 10}
    assert files and max(files) <= 16
