import re

import numpy as np
import pytest

from breaklens.llm import decontaminate as D


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window):
    wins = {}
    for i, t in items:
        w = tokens(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[j:j + k]), set()).add(i)
    out = []
    for d, t in rows:
        w = tokens(t)
        hit, found = set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in wins:
                    hit.update(range(j, j + k))
                    found |= {str(i) for i in wins[tuple(w[j:j + k])] if i is not None}
        longest = 0
        for _, t2 in items:
            q = tokens(t2)
            k = min(window, len(q))
            for a in range(len(w)):
                for b in range(len(q)):
                    n = 0
                    while a + n < len(w) and b + n < len(q) and w[a + n] == q[b + n]:
                        n += 1
                    if k and n >= k:
                        longest = max(longest, n)
        out.append((d, len(w), len(hit), sorted(found), longest))
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 20), (37, 20)])
def test_equals_brute_force(spark, make, edges, write_prose, rng, monkeypatch, shard, block):
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    items = [(i, write_prose(rng.randint(3, 30))) for i in range(8)]
    items += [(20, None), (21, "..."), (22, "Two Words"), (None, write_prose(12)), (23, items[0][1]), (20, "two words")]
    rows = list(edges)
    for i in range(25):
        w = write_prose(50).split()
        pick = tokens(rng.choice(items)[1])
        if pick:
            a = rng.randrange(len(pick))
            w[10:10] = pick[a:a + rng.randint(1, 25)]
        rows.append((i, " ".join(w)))
    rows += [(300, " ".join(["two words"] * 30)), (301, "a " * 500)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    # worker processes read the module's default, so the function's own search is held to it here as well
    got = D.contamination(make(rows, extra=True), bench, window=6, block_words=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.longest) for r in got), key=str) == brute(rows, items, 6)


def test_shards_cut_long_sequences(monkeypatch, rng):
    monkeypatch.setattr(D, "SHARD_WORDS", 16)
    seq = np.array([rng.randrange(1, 4) for _ in range(200)], np.uint64)
    block = D.QueryBlock([("a", seq[30:44]), ("b", seq[60:63])], 5)

    class Held:
        value = block
    hit, found = D._search(seq, [Held], 5)
    want = np.zeros(200, bool)
    for q, k in ((seq[30:44], 5), (seq[60:63], 3)):
        for j in range(len(q) - k + 1):
            for p in range(200 - k + 1):
                if np.array_equal(seq[p:p + k], q[j:j + k]):
                    want[p:p + k] = True
    assert np.array_equal(hit, want)


def test_clean_documents_stay_with_all_columns(spark, make, write_prose):
    item = write_prose(15)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = make([(1, "before " + item + " after"), (2, write_prose(40)), (3, None)], extra=True)
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert D.decontaminate(docs, bench.where("false")).count() == 3
    assert D.contamination(make([]), bench).count() == 0


def test_longest_match_goes_on_across_cuts(monkeypatch, write_prose):
    from breaklens.llm.words import ALNUM, words
    monkeypatch.setattr(D, "SHARD_WORDS", 16)
    item, texts = write_prose(60), [write_prose(11), "", write_prose(5)]
    before = write_prose(3)
    texts[1] = before + " " + " ".join(tokens(item)[4:54]) + " " + write_prose(9)
    raw = item.encode()
    block = D.QueryBlock([("a", words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM).hash)], 10)

    class Held:
        value = block
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    _, hit, items, longest, at = D._slice_matches(np.frombuffer(b"".join(data), np.uint8), off, [Held], 10)
    assert hit.to_pylist() == [0, 50, 0] and items.to_pylist() == [[], ["a"], []]
    assert longest.to_pylist() == [0, 50, 0] and at.to_pylist() == [None, len(tokens(before)), None]
