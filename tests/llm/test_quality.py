import collections
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from breaklens.llm.quality import LabelModel, _slice_counts, keep_quality, quality
from breaklens.llm.words import slices


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if times[tuple(w[i:i + 5])] > 1:
            again.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again),
            len(w) < 10 or 100 * len(again) > 20 * len(w))


def corpus(write_prose, rng):
    rows = [(i, write_prose(rng.randint(40, 120))) for i in range(60)]
    rows += [(100 + i, " ".join(w + rng.choice(["###", "%%%", "***"]) for w in write_prose(50).split())) for i in range(8)]
    rows += [(200 + i, (write_prose(6).upper() + "!! ") * 6) for i in range(8)]
    rows += [(300, "line one\nline two\nline one\nline one \n\n\nline two\nlast"), (301, "a a a a a a a b c d e f g h"),
             (302, "\n".join(["x y z"] * 5)), (303, "ä　ö é\x0bx\ry " * 20)]
    return rows


def test_counts_equal_brute_force(spark, make, edges, write_prose, rng):
    rows = corpus(write_prose, rng) + edges
    got = quality(make(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(60)) <= kept and not kept & set(range(100, 108)) and not kept & set(range(200, 208))


def test_filter_keeps_columns_and_judges_rows(spark, make, edges, write_prose, rng):
    rows = corpus(write_prose, rng) + edges
    docs = make(rows, extra=True)
    kept = keep_quality(docs)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in quality(docs).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert quality(make([])).count() == 0 and keep_quality(make([])).count() == 0


def planted(n, rates, share_good, seed=3):
    """Graded votes of ``len(rates)`` independent rules: (bad documents', good documents') vote probabilities."""
    rng = np.random.Generator(np.random.PCG64(seed))
    good = rng.random(n) < share_good
    votes = np.zeros((n, len(rates)), int)
    for j, (bad_p, good_p) in enumerate(rates):
        cuts = np.where(good[:, None], np.cumsum(good_p), np.cumsum(bad_p))
        votes[:, j] = (rng.random(n)[:, None] > cuts[:, :3]).sum(axis=1)
    return good, votes


RATES = [((0.5 - 0.03 * j, 0.2, 0.1, 0.2 + 0.03 * j), (0.01, 0.05 + 0.01 * j, 0.14, 0.8 - 0.01 * j)) for j in range(7)]


def test_em_recovers_accuracies():
    """At production settings the tables lie between the planted ones and the prior that a tenth of the rows weighs."""
    good, votes = planted(40_000, RATES, 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel(patterns, counts.astype(float))
    free = LabelModel(patterns, counts.astype(float), prior_share=1e-6)
    assert abs(free.good - 0.8) < 0.01 and abs(model.good - 0.8) < 0.02
    for j, (bad_p, good_p) in enumerate(RATES):
        assert np.allclose(free.table[j, 0], bad_p, atol=0.02) and np.allclose(free.table[j, 1], good_p, atol=0.01)
        assert np.allclose(model.table[j, 0], bad_p, atol=0.06) and np.allclose(model.table[j, 1], good_p, atol=0.02)


def brute_em(votes, prior_good=0.85, share=0.1, rounds=300):
    """The same mode, row by row in plain loops."""
    n, m = len(votes), len(votes[0])
    start = LabelModel.START.tolist()
    table, balance = [[row[:] for row in start] for _ in range(m)], prior_good
    for _ in range(rounds):
        post = []
        for v in votes:
            bad, good = 1 - balance, balance
            for j in range(m):
                bad, good = bad * table[j][0][v[j]], good * table[j][1][v[j]]
            post.append(good / (bad + good))
        balance = (sum(post) + share * n * prior_good) / (n + share * n)
        for j in range(m):
            for y, prior in ((0, 1 - prior_good), (1, prior_good)):
                mass = [share * n * prior * start[y][k] for k in range(4)]
                for v, g in zip(votes, post, strict=True):
                    mass[v[j]] += g if y else 1 - g
                table[j][y] = [x / sum(mass) for x in mass]
    return balance, table


def test_fit_equals_rows_one_by_one():
    votes = planted(300, RATES[:4], 0.75, seed=5)[1]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel(patterns, counts.astype(float), tolerance=0.0)
    balance, table = brute_em(votes.tolist())
    assert abs(model.good - balance) < 1e-9 and np.allclose(model.table, table, atol=1e-9)


def test_posterior_outweighs_single_votes():
    """Not all-must-pass: a doubt beside good votes is outweighed, doubts of several rules add up."""
    good, votes = planted(40_000, RATES, 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel(patterns, counts.astype(float))
    gain = model.evidence()
    kept = gain[np.arange(7)[None, :], votes].sum(axis=1) + np.log(model.good / (1 - model.good)) >= 0
    bad_votes = (votes < 2).sum(axis=1)
    assert kept[(bad_votes == 1) & good].mean() > 0.9 and not kept[bad_votes >= 5].any()
    assert (kept == good).mean() > 0.95 > ((bad_votes == 0) == good).mean()


def test_no_rows():
    model = LabelModel(np.zeros((0, 7), int), np.zeros(0))
    assert model.good == 0.85 and np.allclose(model.table, LabelModel.START)


def test_counting_takes_little_memory(write_prose):
    texts = pa.array([write_prose(150)] * 3000)
    assert texts.nbytes > 3 << 20
    tracemalloc.start()
    try:
        rows = sum(len(_slice_counts(data, off)[0]) for _, _, data, off in slices(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 3000
    assert peak < 40 << 20, peak
