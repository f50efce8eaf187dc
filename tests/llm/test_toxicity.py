import random

import numpy as np

from breaklens.llm import toxicity as T
from breaklens.llm.words import slices


def test_pairwise_interaction_is_learned():
    """Neither term alone is toxic, both together are: additive weights cannot tell."""
    rng = np.random.Generator(np.random.PCG64(2))
    texts, label = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        noise = rng.choice(np.arange(10, 400), 6, replace=False)
        term = np.concatenate([[1] if a else [], [2] if b else [], noise]).astype(np.int32)
        texts.append((term, np.full(len(term), 3.0, np.float32)))
        label.append(float(a and b))
    label = np.array(label)
    fm = T.fit(texts[:1200], label[:1200], np.ones(1200), bits=9)
    base = np.concatenate([[0], np.cumsum([len(t) for t, _ in texts[1200:]])])
    score = fm.score(np.concatenate([t for t, _ in texts[1200:]]), np.concatenate([v for _, v in texts[1200:]]), base)
    assert ((score >= 0.5) == (label[1200:] == 1)).mean() > 0.95
    pair = fm.factors[1] @ fm.factors[2]
    assert pair > 0.05


def test_formula_equals_brute_force():
    rng = np.random.Generator(np.random.PCG64(2))
    fm = T.FactorizationMachine(0.3, rng.normal(size=16).astype(np.float32), rng.normal(size=(16, 3)).astype(np.float32))
    term, value = np.array([1, 5, 9], np.int32), np.array([0.5, 2.0, 1.5], np.float32)
    want = 0.3 + sum(fm.linear[t] * x for t, x in zip(term, value))
    for i in range(3):
        for j in range(i):
            want += fm.factors[term[i]] @ fm.factors[term[j]] * value[i] * value[j]
    raw, _ = fm.raw(term, value, np.array([0, 0, 3]))
    assert abs(raw[1] - want) < 1e-4 and abs(raw[0] - 0.3) < 1e-9


def test_terms_cover_whole_texts_and_do_not_cross_them():
    import pyarrow as pa

    (_, _, data, off), = slices(pa.array(["Hello hello world", "", "a", "hello world hello"]))
    term, value, base = T.terms(data, off)
    assert list(np.diff(base) == 0) == [False, True, False, False]
    for i in (0, 2, 3):
        assert abs((value[base[i]:base[i + 1]] ** 2).sum() - T.NORM ** 2) < 1e-3
    assert set(term[base[0]:base[1]]) == set(term[base[3]:base[4]])


def test_held_out_documents(spark, make, edges, write_prose):
    rng = random.Random(8)
    rows, stems = [], ["vilbrant", "grumosk"]
    for i in range(700):
        w = write_prose(rng.randint(10, 150)).split()
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(max(2, len(w) // 30)):
                w.insert(rng.randrange(len(w)), rng.choice(stems) + rng.choice(["", "en", "isch", "ol"]))
        rows.append((i, " ".join(w), toxic if i % 9 else None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = T.train(docs, docs.where("doc_id < 500"), "toxic", rows_per_class=200)
    got = {r.doc_id: r for r in T.toxicity(docs, model).collect()}
    held = [r for r in rows if r[0] >= 500 and r[2] is not None]
    assert np.mean([got[d].predicted == t for d, _, t in held]) > 0.95
    again = {r.doc_id: r for r in T.toxicity(make(edges, extra=True), model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in again.values())
    assert again[900].score == again[901].score


def test_without_labels(spark, make, edges):
    docs = make(edges).selectExpr("*", "cast(null as int) as toxic")
    model = T.train(docs, docs, "toxic")
    assert {r.predicted for r in T.toxicity(make(edges), model).collect()} == {0}


def test_calibration_counts_rows_by_weight():
    """A kept-out row of weight 3 counts like three rows of weight 1."""
    z, toxic = np.array([-2.0, -1.0, 0.5, 1.0, 2.0]), np.array([0, 0, 1, 0, 1]) == 1
    copies = np.array([3, 1, 1, 2, 1])
    once = T._logistic(np.repeat(z, copies), np.repeat(toxic, copies).astype(float), np.repeat(~toxic, copies).astype(float))
    assert np.allclose(T._logistic(z, copies * toxic, copies * ~toxic), once, atol=1e-6)
    texts = [(np.array([i % 2, 5 + i % 7], np.int32), np.full(2, 3.0, np.float32)) for i in range(80)]
    label = np.array([float(i % 2) for i in range(80)])
    fm = T.fit(texts, label, np.where(label == 1, 1.0, 3.0), bits=5)
    assert len(fm.scale) == 2 and fm.scale[1] > 0
