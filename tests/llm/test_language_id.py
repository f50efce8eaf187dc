import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from breaklens.llm import langid
from breaklens.llm.words import slices

PARTS = {"aa": "ba be bi bo bu", "bb": "kra kre stri stro", "cc": "ñu ño öl ül"}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    parts = PARTS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def labelled(spark, n=30):
    rows = [(i * 3 + k, text(lang, 40, i), lang) for i in range(n) for k, lang in enumerate(PARTS)]
    rows += [(1000, None, "aa"), (1001, "ba be", None), (1002, "", "bb"), (1003, "123 --", "cc")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def fold(s, order):
    out = []
    for c in s:
        c = c.lower() if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out.append(c)
    return [" "] * (order - 1) + out


def reference_kn(texts, order):
    """Interpolated Kneser-Ney over dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        s = fold(t, order)
        counts[order].update("".join(s[i:i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d, total, kinds = {}, defaultdict(int), defaultdict(int)
    for n, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[n] = min(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.95)
        for g, v in c.items():
            total[n, g[:-1]] += v
            kinds[n, g[:-1]] += 1

    def p(gram, n, uniform):
        if n == 0:
            return uniform
        ctx = gram[:-1]
        below = p(gram[1:], n - 1, uniform)
        if not total[n, ctx]:
            return below
        return max(counts[n][gram] - d[n], 0) / total[n, ctx] + d[n] * kinds[n, ctx] / total[n, ctx] * below
    return p, counts


def test_cross_entropy_is_kneser_ney(spark):
    docs = labelled(spark, 4)
    models = langid.train(docs, bits=24)
    rows = docs.collect()
    by = {lang: [r.text for r in rows if r.lang == lang and r.text] for lang in PARTS}
    fits = {lang: reference_kn(t, 4) for lang, t in by.items()}
    uniform = 1 / (len(set().union(*(f[1][1] for f in fits.values()))) + 1)
    probes = ["babe krestri", "ñuñu xyz", text("bb", 20, "new"), "Ba"]
    col = pa.array(probes)
    (_, _, data, off), = slices(col)
    ce, n, _ = models.cross_entropy(data, off)
    for i, t in enumerate(probes):
        s = fold(t, 4)
        for lang, (p, _) in fits.items():
            want = -sum(math.log(p("".join(s[j:j + 4]), 4, uniform)) for j in range(len(s) - 3)) / (len(s) - 3)
            assert abs(ce[i, models.languages.index(lang)] - want) < 1e-3, (t, lang)
        assert n[i] == len(s) - 3


def test_held_out_accuracy_edges_and_rejection(spark, make, edges):
    docs = labelled(spark)
    models = langid.calibrated(langid.train(docs), docs, "doc_id", "lang", "text")
    probes = [(5000 + i * 3 + k, text(lang, 12, f"held{i}")) for i in range(20) for k, lang in enumerate(PARTS)]
    got = {r.doc_id: r for r in langid.identify(make(probes + edges, extra=True), models).collect()}
    assert all(got[d].lang_pred == list(PARTS)[(d - 5000) % 3] for d, _ in probes)
    assert all(0 <= r.score <= 1 for r in got.values())
    for d in (900, 901, 902):
        assert (got[d].lang_pred, got[d].score, got[d].cross_entropy, got[d].accepted) == ("und", 0.0, None, False)
    assert not got[906].accepted and got[906].lang_pred in PARTS
    assert sum(got[d].accepted for d, _ in probes) > 40


def test_nothing_learned(spark, make, edges):
    none = langid.train(labelled(spark).where("false"))
    assert {r.lang_pred for r in langid.identify(make(edges), none).collect()} == {"und"}


def test_counts_cover_all_rows(spark):
    docs = labelled(spark)
    counts = {(r.lang, r.gram): r.n for r in langid.gram_counts(docs.repartition(7), "lang", "text").collect()}
    want = Counter()
    for r in docs.collect():
        if r.lang and r.text:
            s = fold(r.text, 4)
            want.update((r.lang, "".join(s[i:i + 4])) for i in range(len(s) - 3))
    assert counts == dict(want)
    assert np.sum(list(counts.values())) == sum(want.values())


def test_tables_hold_every_gram(spark):
    rng = random.Random(8)
    rows = [(i, "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(300)), "ab"[i % 2]) for i in range(60)]
    models = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    grams = set()
    for _, t, _ in rows:
        s = fold(t, langid.ORDER)
        grams |= {tuple(s[i:i + langid.ORDER]) for i in range(len(s) - langid.ORDER + 1)}
    assert len(models.slots[langid.ORDER - 1]) == len(grams)


def test_calibration_counts_every_labelled_text(spark):
    rows = [(i, text(lang, 3, f"w{i}"), lang) for i in range(2000) for lang in PARTS]  # ids repeat
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = langid.calibrated(langid.train(docs), docs, "doc_id", "lang", "text")
    got = langid.measured(docs, models, "doc_id", "text", "lang").where("best = own").collect()
    for k in range(len(models.languages)):
        mine = [r.cross_entropy for r in got if r.own == k]
        assert abs(models.limit[k] - np.quantile(mine, 1 - langid.REFUSED)) <= 2 / langid.CE_STEPS
    cuts = [(m, b == r.own) for r in langid.measured(docs, models, "doc_id", "text", "lang").collect()
            for b, m in zip(r.cut_best, r.cut_margin, strict=True) if b >= 0]
    assert len(cuts) > 4 * 4096
    a, b = models.scale
    mean = sum(1 / (1 + math.exp(-(a + b * m))) for m, _ in cuts) / len(cuts)  # the logistic keeps the rate of right ones
    assert abs(mean - sum(y for _, y in cuts) / len(cuts)) < 0.01


def test_grams_are_found_by_their_leading_bits(monkeypatch):
    rng = np.random.default_rng(3)
    near = np.uint64(0xABCDEF) << np.uint64(40)  # many hashes that agree in their leading bits
    for bits in (64, 20):
        known = np.unique(np.concatenate([rng.integers(0, 2**64, 500, dtype=np.uint64), near + np.arange(300, dtype=np.uint64),
                                          np.array([0, 2**64 - 1], np.uint64)]) >> np.uint64(64 - bits))
        for slots in (known, known[:1], known[-1:], known[:0]):
            m = langid.LanguageModels(["a"], 1, bits, [slots], [np.zeros((len(slots), 1))], [np.zeros((len(slots), 1))], np.zeros(1))
            asked = np.concatenate([known, known + np.uint64(1), np.maximum(known, 1) - np.uint64(1)]) & np.uint64(2**bits - 1)
            m._find(1, asked[:1])
            with monkeypatch.context() as only:  # no binary search a gram
                only.setattr(np, "searchsorted", lambda *a, **b: 1 / 0)
                at, found = m._find(1, asked)
            assert (found == np.isin(asked, slots)).all()
            assert (slots[at[found]] == asked[found]).all()
