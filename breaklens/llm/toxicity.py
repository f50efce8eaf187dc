"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.llm.langid import _logistic
from breaklens.llm.words import _BASE, _BASE_INV, _BYTE, _LOWER, ALNUM, _powers, mix, slices, words
from breaklens.session import ship_package

#: Hashed terms: the model has 2**TERM_BITS * (FACTORS + 1) weights, whatever the corpus.
TERM_BITS = 18
FACTORS = 8
#: Bytes of the pieces of words that are terms besides the words themselves.
PIECES = (4, 6)
#: Labelled rows of each class that the model is fitted to, those of the least id hash.
ROWS_PER_CLASS = 3000
#: Length of a text's vector of terms.
NORM = 8.0
_SLICE = 1 << 20


def terms(data: np.ndarray, off: np.ndarray, bits: int = TERM_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, weight, base per text): hashed words and pieces of words of whole texts.

    A text's weights are the square roots of the terms' shares, so they don't
    depend on its length; their squares sum to ``NORM`` squared.
    """
    n = len(off) - 1
    w = words(data, off, ALNUM)
    low = _LOWER[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[low] * _powers(_BASE, len(data)), out=sums[1:])
    inv = _powers(_BASE_INV, len(data) + 1)
    size, rows = w.end - w.start, w.rows()
    all_h, all_r = [w.hash], [rows]
    for k in PIECES:
        count = np.maximum(size - k + 1, 0)
        first = np.repeat(w.start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        h = (sums[first + k] - sums[first]) * inv[first]
        leads = first == np.repeat(w.start, count)
        all_h.append(mix(h + np.uint64(k << 8) + leads.astype(np.uint64)))
        all_r.append(np.repeat(rows, count))
    key = (np.concatenate(all_r) << bits) | (np.concatenate(all_h) >> np.uint64(64 - bits)).astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    row = key >> bits
    total = np.bincount(row, weights=tf, minlength=n)
    value = (NORM * np.sqrt(tf / total[row])).astype(np.float32) if len(row) else np.zeros(0, np.float32)
    return (key & ((1 << bits) - 1)).astype(np.int32), value, np.searchsorted(row, np.arange(n + 1))


def _segment_sums(values: np.ndarray, base: np.ndarray) -> np.ndarray:
    out = np.zeros((len(base) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(base))
    if len(some):
        out[some] = np.add.reduceat(values, base[some], axis=0, dtype=np.float64)
    return out


@dataclass
class FactorizationMachine:
    """bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, as a log odds."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    scale: tuple[float, float] = (0.0, 1.0)

    def raw(self, term: np.ndarray, value: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, sums of the factors) of every text."""
        vx = self.factors[term] * value[:, None]
        each = self.linear[term] * value - 0.5 * (vx * vx).sum(axis=1)
        mixed = _segment_sums(vx, base)
        return self.bias + _segment_sums(each, base) + 0.5 * (mixed * mixed).sum(axis=1), mixed

    def score(self, term: np.ndarray, value: np.ndarray, base: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a + b * self.raw(term, value, base)[0], -30, 30)))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, bits: int = TERM_BITS,
        factors: int = FACTORS, steps: int = 600, batch: int = 64, rate: float = 0.1, decay: float = 2e-4,
        seed: int = 5) -> FactorizationMachine:
    """Fits by AdaGrad on the weighted log loss; a fifth of the rows, kept out, calibrates the score."""
    rng = np.random.Generator(np.random.PCG64(seed))
    fm = FactorizationMachine(0.0, np.zeros(1 << bits, np.float32),
                              rng.normal(0, 0.01, (1 << bits, factors)).astype(np.float32))
    if not len(texts) or len(np.unique(label)) < 2:
        share = (weight * label).sum() / weight.sum() if len(texts) else 0.0
        fm.factors[:] = 0
        fm.bias = float(np.log((share * len(texts) + 0.5) / ((1 - share) * len(texts) + 1.5)))
        return fm
    order = rng.permutation(len(texts))
    kept_out, train = order[: len(order) // 5], order[len(order) // 5:]
    g_bias, g_lin, g_fac = 1.0, np.full(1 << bits, 1e-2, np.float32), np.full((1 << bits, factors), 1e-2, np.float32)
    mean = weight.mean()

    def gather(rows):
        base = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in rows])])
        return (np.concatenate([texts[i][0] for i in rows]), np.concatenate([texts[i][1] for i in rows]), base)

    done = 0
    while done < steps:
        train = rng.permutation(train)
        for lo in range(0, len(train), batch):
            done += 1
            rows = train[lo:lo + batch]
            term, value, base = gather(rows)
            z, mixed = fm.raw(term, value, base)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) * (weight[rows] / mean)
            who = np.repeat(np.arange(len(rows)), np.diff(base))
            # sums over equal terms: sorted by term, one segment each
            order = np.argsort(term, kind="stable")
            sorted_term = term[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_term[1:] != sorted_term[:-1]]))
            used, who = sorted_term[first], who[order]
            x = value[order][:, None]
            e = (err[who] / len(rows)).astype(np.float32)[:, None] * x
            inner = mixed.astype(np.float32)[who] - fm.factors[sorted_term] * x
            step = np.add.reduceat(e[:, 0], first) + decay * fm.linear[used]
            g_lin[used] += step * step
            fm.linear[used] -= rate * step / np.sqrt(g_lin[used])
            step = np.add.reduceat(e * inner, first, axis=0) + decay * fm.factors[used]
            g_fac[used] += step * step
            fm.factors[used] -= 0.3 * rate * step / np.sqrt(g_fac[used])
            step = float(err.mean())
            g_bias += step * step
            fm.bias -= rate * step / np.sqrt(g_bias)
    if len(kept_out) and len(np.unique(label[kept_out])) == 2:
        z = fm.raw(*gather(kept_out))[0]
        copies = np.maximum(np.rint(weight[kept_out] / weight.min()), 1)
        fm.scale = _logistic(z, copies * (label[kept_out] == 1), copies * (label[kept_out] != 1))
    return fm


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          rows_per_class: int = ROWS_PER_CLASS, **options) -> FactorizationMachine:
    """Fits to the texts of at most ``rows_per_class`` ids of each class of ``labels`` (label 0 or 1;
    others, ids without a document and null ids are left out).

    The ids are those of the least hash, so a larger table gives no larger
    sample; each class is weighted to its share of all labelled ids. Only the
    sampled texts are looked up, by a broadcast of their ids; their terms are
    hashed on the executors, and only these come to the driver.
    """
    ship_package(docs.sparkSession)
    labelled = (labels.where(F.col(label_col).isin(0, 1))
                .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
                .join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"))
    shares = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    chosen = [labelled.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(rows_per_class) for k in (0, 1)]
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
              .join(F.broadcast(chosen[0].union(chosen[1])), "id").select("id", "label", "text"))

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(2), _SLICE):
                term, value, base = terms(data, off, options.get("bits", TERM_BITS))
                at = pa.array(base, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(at, pa.array(term)), pa.ListArray.from_arrays(at, pa.array(value))],
                    names=["id", "label", "term", "value"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInArrow(run, f"id {kind}, label int, term array<int>, value array<float>").toArrow().combine_chunks()
    got = got.sort_by([("id", "ascending"), ("label", "ascending")])
    label = got.column("label").to_numpy()
    weight = np.array([shares[k] / max((label == k).sum(), 1) for k in label.tolist()], float)
    texts = [(t.values.to_numpy(), v.values.to_numpy()) for t, v in
             zip(got.column("term"), got.column("value"), strict=True)]
    return fit(texts, label.astype(float), weight, **options)


def toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text",
             bits: int = TERM_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, score (0 to 1) and predicted (score >= 0.5) of the whole text.

    A null or empty text has no terms and the score of the bias alone; repeated
    rows have equal scores. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**bits * (factors + 1) weights

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1), _SLICE):
                score = shared.value.score(*terms(data, off, bits))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col))
