"""Language identification by interpolated Kneser-Ney character models, one per language."""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.llm.words import mix, run_windows, slices, windows
from breaklens.session import ship_package, written

ORDER = 4
#: Bits of a stored gram's hash: whole hashes, so that the tables grow with the corpus.
HASH_BITS = 64
#: Steps of a nat, and of a margin's unit, in which the calibration counts.
CE_STEPS, MARGIN_STEPS = 4096, 1024
#: Share of a language's own texts that the rejection may refuse.
REFUSED = 0.005
#: Characters of the cuts on which the score is calibrated (whole texts are hardly ever mistaken).
CUTS = (4, 8, 16, 32)
UNKNOWN = "und"
_SLICE = 1 << 20
#: Bytes of text that are measured at a time: their arrays stay in a core's cache.
_MEASURED_SLICE = 1 << 17
_BLANK = 0x20


@functools.cache
def _fold_table() -> np.ndarray:
    """Lower case of every letter of the basic plane; everything else is a blank."""
    out = np.full(1 << 16, _BLANK, np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


def symbols(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of every text and where each text's begin.

    Letters are lower-cased, each run of anything else is one blank, and every
    text starts with ``order - 1`` blanks.
    """
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[off]
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    folded = _fold_table()[np.minimum(code, 0xFFFF)]
    for c in np.unique(code[code > 0xFFFF]):
        folded[code == c] = c if chr(c).isalpha() else _BLANK
    blank = folded == _BLANK
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = ~blank[first]  # the blanks before a text stand for this one
    n = np.diff(np.concatenate([[0], np.cumsum(keep)])[at])
    base = np.concatenate([[0], np.cumsum(n + order - 1)])
    out = np.full(base[-1], _BLANK, np.uint32)
    out[np.arange(n.sum()) + np.repeat(np.arange(1, len(n) + 1) * (order - 1), n)] = folded[keep]
    return out, base


def _gram_hash(code: np.ndarray, base: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, _, wbase = windows(mix(code.astype(np.uint64) + np.uint64(1)), base, n)
    return h, wbase


@dataclass
class LanguageModels:
    """Models of all languages over one union of grams, in sorted hash arrays.

    For each order, ``slots`` holds the sorted hashes, ``logp`` the
    interpolated log probability of the gram's last symbol in each language,
    and ``logb`` the log weight that the language leaves to shorter contexts
    after the gram (0 where it never saw the gram as a context).
    """

    languages: list[str]
    order: int
    bits: int
    slots: list[np.ndarray]
    logp: list[np.ndarray]
    logb: list[np.ndarray]
    floor: np.ndarray  # log probability, per language, of a symbol that no language has
    limit: np.ndarray | None = None  # greatest accepted cross-entropy per language
    scale: tuple[float, float] = (0.0, 1.0)  # of the score's logistic

    def __post_init__(self) -> None:
        self._starts: dict[int, tuple[np.ndarray, np.uint64]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_starts": {}}  # made anew where it is used

    def _index(self, n: int) -> tuple[np.ndarray, np.uint64]:
        """Where the hashes with each value of their leading bits begin (about a quarter of a hash for each value)."""
        if n not in self._starts:
            known = self.slots[n - 1]
            lead = min(self.bits, (4 * len(known)).bit_length())
            shift = np.uint64(self.bits - lead)
            at = np.searchsorted(known, np.arange(1 << lead, dtype=np.uint64) << shift)
            self._starts[n] = at.astype(np.int32 if len(known) < 1 << 31 else np.int64), shift
        return self._starts[n]

    def _find(self, n: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.slots[n - 1]
        if not len(known):
            return np.zeros(len(slot), np.int64), np.zeros(len(slot), bool)
        starts, shift = self._index(n)
        last = len(known) - 1
        at = np.minimum(starts[(slot >> shift).view(np.int64)], last)
        have = known[at]
        low = np.flatnonzero((have < slot) & (at < last))
        while len(low):
            at[low] += 1
            have[low] = known[at[low]]
            low = low[(have[low] < slot[low]) & (at[low] < last)]
        return at, have == slot

    def cross_entropy(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per symbol in each language, symbols, letters) of every text."""
        code, base = symbols(data, off, self.order)
        n_text, n_lang = len(off) - 1, len(self.languages)
        shift = np.uint64(64 - self.bits)
        mixed = mix(code.astype(np.uint64) + np.uint64(1))

        def slots(n, at):
            """Of the grams of n symbols that end at ``at``."""
            return run_windows(mixed, at - (n - 1), n) >> shift

        n_sym = np.diff(base) - (self.order - 1)
        last = np.arange(n_sym.sum()) + np.repeat(np.arange(1, n_text + 1) * (self.order - 1), n_sym)
        at, found = self._find(self.order, slots(self.order, last))
        value = self.logp[self.order - 1].astype(np.float32, copy=False)[at] if len(self.slots[-1]) else np.zeros(
            (len(last), n_lang), np.float32)
        open_ = np.flatnonzero(~found)
        value[open_] = 0
        for n in range(self.order, 0, -1):
            if n < self.order:
                at, found = self._find(n, slots(n, last[open_]))
                value[open_[found]] += self.logp[n - 1][at[found]]
                open_ = open_[~found]
            if not len(open_):
                break
            if n > 1:
                at, found = self._find(n - 1, slots(n - 1, last[open_] - 1))
                value[open_[found]] += self.logb[n - 2][at[found]]
            else:
                value[open_] += self.floor
        sums = np.zeros((n_text, n_lang))
        some = np.flatnonzero(n_sym)
        if len(some):
            sums[some] = np.add.reduceat(value, (np.cumsum(n_sym) - n_sym)[some], axis=0, dtype=np.float64)
        letters = np.bincount(np.repeat(np.arange(n_text), n_sym)[code[last] != _BLANK], minlength=n_text)
        return -sums / np.maximum(n_sym, 1)[:, None], n_sym, letters

    def margin(self, ce: np.ndarray, n_sym: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of the best language to the next, as far as a logistic tells ratios apart."""
        if ce.shape[1] < 2:
            return np.minimum(n_sym, 60.0)
        two = np.partition(ce, 1, axis=1)
        return np.minimum((two[:, 1] - two[:, 0]) * n_sym, 60.0)


def _logistic(x: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with smoothed targets; the slope isn't negative.

    ``x`` are the mean margins of the counted bins, ``right`` and ``wrong`` their outcomes.
    """
    n, up, down = right + wrong, right.sum(), wrong.sum()
    t = (right * (up + 1) / (up + 2) + wrong / (down + 2)) / n
    mean = (x * n).sum() / n.sum()
    spread = np.sqrt(((x - mean) ** 2 * n).sum() / n.sum()) or 1.0
    z, w = (x - mean) / spread, np.zeros(2)
    design = np.stack([np.ones_like(z), z], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (n * (t - p)) - 1e-3 * w)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    slope = max(w[1] / spread, 0.0)
    return float(w[0] - slope * mean), float(slope)


def gram_counts(docs: DataFrame, lang_col: str, text_col: str, order: int = ORDER) -> DataFrame:
    """lang, gram (``order`` symbols), n over the whole texts of all rows."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            total: dict[str, Counter] = {}
            langs = batch.column(0).to_pylist()
            for lo, hi, data, off in slices(batch.column(1), _SLICE):
                code, base = symbols(data, off, order)
                h, wbase = _gram_hash(code, base, order)
                first = np.arange(wbase[-1]) + np.repeat(base[:-1] - wbase[:-1], np.diff(wbase))
                names = sorted(set(langs[lo:hi]))
                which = np.repeat(np.array([names.index(x) for x in langs[lo:hi]], np.int64), np.diff(wbase))
                for k, name in enumerate(names):
                    mine = np.flatnonzero(which == k)
                    _, at, times = np.unique(h[mine], return_index=True, return_counts=True)
                    rows = code[first[mine[at]][:, None] + np.arange(order)]
                    grams = np.ascontiguousarray(rows).view(f"<U{order}").ravel().tolist() if len(rows) else []
                    have = total.setdefault(name, Counter())
                    for g, n in zip(grams, times.tolist(), strict=True):
                        have[g] += n
            for name, have in total.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(have), pa.string()),
                                                  "gram": pa.array(list(have), pa.string()),
                                                  "n": pa.array(list(have.values()), pa.int64())})

    pairs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    return pairs.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER,
          bits: int = HASH_BITS) -> LanguageModels:
    """Kneser-Ney models from every row of ``docs`` with a language and a text.

    Spark counts the grams of the highest order; lower orders count distinct
    preceding symbols. Each order has one absolute discount per language, and
    its probabilities are interpolated with the next lower order down to a
    uniform one. What comes back to the driver grows with the corpus: per order
    one row for each distinct gram and language, 8 bytes a gram and 8 a gram and
    language in the arrays. With fewer ``bits``, grams that share a slot get the
    greatest of their probabilities.
    """
    top = written(gram_counts(docs, lang_col, text_col, order), "grams")
    languages = [r.lang for r in top.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return LanguageModels([], order, bits, [np.zeros(0, np.uint64)] * order, [np.zeros((0, 0))] * order,
                              [np.zeros((0, 0))] * order, np.zeros(0))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        longer = counts[n + 1]
        counts[n] = longer.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
    uniform = 1.0 / (counts[1].select("gram").distinct().count() + 1)
    every = F.explode(F.array(*map(F.lit, languages)))
    lower, tables, after = None, {}, {}
    for n in range(1, order + 1):
        of = counts[n].groupBy("lang").agg(
            F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2"))
        rate = of.select("lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
                         .otherwise(0.5).alias("discount"))
        rate = rate.withColumn("discount", F.least(F.col("discount"), F.lit(0.95)))
        context = (counts[n].groupBy("lang", F.substring("gram", 1, n - 1).alias("context"))
                   .agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(rate, "lang")
                   .withColumn("left", F.col("discount") * F.col("kinds") / F.col("total")))
        after[n - 1] = context
        grams = counts[n].select("gram").distinct().select("gram", every.alias("lang"))
        full = (grams.withColumn("context", F.substring("gram", 1, n - 1))
                .join(counts[n], ["lang", "gram"], "left").join(context, ["lang", "context"], "left"))
        if lower is None:
            full = full.withColumn("below", F.lit(uniform))
        else:
            full = full.withColumn("suffix", F.substring("gram", 2, n - 1)).join(
                lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"], "left")
        seen = F.coalesce(F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total"), F.lit(0.0))
        lower = written(full.select("lang", "gram", (seen + F.coalesce("left", F.lit(1.0)) * F.col("below")).alias("p")),
                        "kn")
        tables[n] = lower
    slots, logp, logb = [], [], []
    index = {lang: i for i, lang in enumerate(languages)}
    for n in range(1, order + 1):
        weight = after.get(n)
        rows = tables[n]
        if weight is not None:
            rows = rows.join(weight.select("lang", F.col("context").alias("gram"), "left"), ["lang", "gram"], "left")
        else:
            rows = rows.withColumn("left", F.lit(None).cast("double"))
        per_slot = (_with_slot(rows, bits).groupBy("slot", "lang")
                    .agg(F.max("p").alias("p"), F.max("left").alias("left")))
        got = per_slot.toArrow()
        slot = got.column("slot").to_numpy().astype(np.uint64)
        keys, row = np.unique(slot, return_inverse=True)
        col = np.array([index[x] for x in got.column("lang").to_pylist()], np.int64)
        p = np.full((len(keys), len(languages)), uniform)
        left = np.ones((len(keys), len(languages)))
        p[row, col] = got.column("p").to_numpy()
        left[row, col] = np.nan_to_num(got.column("left").to_numpy().astype(float), nan=1.0)
        slots.append(keys)
        logp.append(np.log(p).astype(np.float32))
        logb.append(np.log(np.maximum(left, 1e-9)).astype(np.float32))
    unseen = {r.lang: r.left for r in after[0].select("lang", "left").collect()}  # one row per language
    floor = np.log([uniform * unseen[lang] for lang in languages]).astype(np.float32)
    return LanguageModels(languages, order, bits, slots, logp, logb, floor)


def _with_slot(rows: DataFrame, bits: int) -> DataFrame:
    """The leading ``bits`` of the hashes of grams of one length (as signed numbers)."""

    def run(batches):
        for batch in batches:
            grams = batch.column(0).to_pylist()
            n = len(grams[0]) if grams else 1
            code = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
            slot = (_gram_hash(code, np.arange(len(grams) + 1) * n, n)[0] >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), *batch.columns[1:]],
                                             names=["slot", "lang", "p", "left"])

    return rows.select("gram", "lang", "p", "left").mapInArrow(run, "slot bigint, lang string, p double, left double")


def measured(docs: DataFrame, models: LanguageModels, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, best (number of the language, -1: none), cross_entropy, margin,
    and of a row with a learned language in ``lang_col`` and a text: own (that language's number) and
    the best and margin of its cuts (null where a cut has no letter)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(models)  # grows with the distinct grams and languages

    def of(m, col):
        for lo, hi, data, off in slices(col, _MEASURED_SLICE):
            if m.languages:
                ce, n_sym, letters = m.cross_entropy(data, off)
                yield lo, hi, ce.argmin(axis=1), ce.min(axis=1), m.margin(ce, n_sym), letters == 0
            else:
                yield lo, hi, np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)

    def run(batches):
        m = shared.value
        index = {lang: i for i, lang in enumerate(m.languages)}
        for batch in batches:
            for lo, hi, best, least, margin, none in of(m, batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                langs = batch.column(2).slice(lo, hi - lo).to_pylist()
                own = [index.get(x) if ok else None for x, ok in zip(langs, texts.is_valid().to_pylist(), strict=True)]
                at = [i for i, x in enumerate(own) if x is not None]
                cuts = [text[len(text) // 3:][:n] for text in texts.take(pa.array(at, pa.int64())).to_pylist() for n in CUTS]
                cut_best, cut_margin = np.full((hi - lo, len(CUTS)), -1), np.zeros((hi - lo, len(CUTS)))
                if cuts:
                    parts = [(np.where(bare, -1, top), far) for _, _, top, _, far, bare in of(m, pa.array(cuts, pa.string()))]
                    cut_best[at] = np.concatenate([x for x, _ in parts]).reshape(-1, len(CUTS))
                    cut_margin[at] = np.concatenate([x for _, x in parts]).reshape(-1, len(CUTS))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.where(none, -1, best), pa.int32()),
                    pa.array(least, pa.float64(), mask=none), pa.array(margin, pa.float64()), pa.array(own, pa.int32()),
                    pa.array(cut_best.tolist(), pa.list_(pa.int32())), pa.array(cut_margin.tolist(), pa.list_(pa.float64()))],
                    names=["id", "best", "cross_entropy", "margin", "own", "cut_best", "cut_margin"])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col)
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
            .mapInArrow(run, f"id {kind}, best int, cross_entropy double, margin double, own int, "
                             "cut_best array<int>, cut_margin array<double>")
            .withColumnRenamed("id", id_col))


def calibrated_on(models: LanguageModels, rows: DataFrame) -> LanguageModels:
    """Calibrates on every labelled row of :func:`measured`: each language's rejection limit on its own texts
    that were told right (exact where a step of 1/4096 nat holds up to two texts, else within it), the score's logistic on all cuts. Counted by Spark: what comes
    back are the used steps of the two scales, however many texts there are."""
    own = rows.where("own is not null")
    step = F.floor(F.col("cross_entropy") * CE_STEPS)
    limits = (own.where("best = own").groupBy(F.col("own").alias("i"), step.alias("step"))
              .agg(F.count("*").alias("n"), F.min("cross_entropy").alias("least"), F.max("cross_entropy").alias("most"))
              .orderBy("i", "step").collect())  # languages x used steps
    models.limit = np.full(len(models.languages), np.inf)
    for i in {r.i for r in limits}:
        of = [r for r in limits if r.i == i]
        end = np.cumsum([r.n for r in of])

        def ranked(k, of=of, end=end):
            b = of[j := int(np.searchsorted(end, k, "right"))]
            return b.least + (b.most - b.least) * (k - (end[j] - b.n)) / max(b.n - 1, 1)

        at = (1 - REFUSED) * (end[-1] - 1)
        low = ranked(int(at))
        models.limit[i] = low + (ranked(min(int(at) + 1, end[-1] - 1)) - low) * (at - int(at))
    cuts = (own.select("own", F.explode(F.arrays_zip("cut_best", "cut_margin")).alias("c")).select("own", "c.*")
            .where("cut_best >= 0"))
    right = F.col("cut_best") == F.col("own")
    bins = (cuts.groupBy(F.floor(F.col("cut_margin") * MARGIN_STEPS).alias("bin"))
            .agg(F.avg("cut_margin").alias("x"), F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"))
            .orderBy("bin").collect())  # at most 60 x 1024 + 1 (symbols without a second language: 60) rows
    if bins:
        models.scale = _logistic(*(np.array([r[c] for r in bins], float) for c in ("x", "right", "wrong")))
    return models


def calibrated(models: LanguageModels, docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> LanguageModels:
    """Calibrates on all labelled texts of ``docs``."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return calibrated_on(models, written(measured(known, models, id_col, text_col, lang_col), "measured"))


def decided(rows: DataFrame, models: LanguageModels, id_col: str = "doc_id") -> DataFrame:
    """The rows of :func:`measured` as :func:`identify` returns them."""
    a, b = models.scale
    names = F.array(*map(F.lit, [*models.languages, UNKNOWN]))
    limits = F.array(*(F.lit(float(x)) for x in (models.limit if models.limit is not None else
                                                 [np.inf] * len(models.languages))), F.lit(0.0))
    some = F.col("best") >= 0
    at = F.when(some, F.col("best")).otherwise(len(models.languages))
    logit = F.least(F.greatest(F.lit(a) + F.lit(b) * F.col("margin"), F.lit(-30.0)), F.lit(30.0))
    return rows.select(id_col, F.get(names, at).alias("lang_pred"),
                       F.when(some, 1 / (1 + F.exp(-logit))).otherwise(0.0).alias("score"), "cross_entropy",
                       F.coalesce(some & (F.col("cross_entropy") <= F.get(limits, at)), F.lit(False)).alias("accepted"))


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, lang_pred, score, cross_entropy, accepted.

    lang_pred is the language of the least cross-entropy per symbol over the
    whole text (the first in alphabetical order of equals); ``und`` with score
    0, without cross-entropy and not accepted, if the text is null or has no
    letter, or nothing was learned. score is the calibrated probability that
    the prediction is right; accepted tells whether the cross-entropy lies
    within the limit that the language's own texts keep. Other columns are
    not looked at.
    """
    return decided(measured(docs, models, id_col, text_col), models, id_col)
