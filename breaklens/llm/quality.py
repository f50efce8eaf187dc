"""Quality by weak supervision: rules vote or abstain, EM weighs the votes, a posterior decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.llm.words import SPACED, beside, byte_class, mix, slices, windows, words
from breaklens.session import ship_package, written

REPEAT_WORDS = 5
_SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>")
_UPPER = byte_class(lambda b: 0x41 <= b <= 0x5A)
_LETTER = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_DIGIT = byte_class(lambda b: 0x30 <= b <= 0x39)
_LOUD = byte_class(lambda b: chr(b) in "!?")
_STOP = byte_class(lambda b: chr(b) in ".!?:;\"')")

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_full_lines",
           "n_distinct_words", "n_letters", "n_upper", "n_digits", "n_loud", "n_letter_words")


def _total(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def _slice_counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    w = words(data, off, SPACED, lower=False)
    rows, n_words = w.rows(), np.diff(w.base)
    in_word = SPACED[data]
    salt = lambda r: mix(r.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))
    # words in windows that a text holds at least twice
    h, first, wbase = windows(w.hash, w.base, REPEAT_WORDS)
    wrow = np.repeat(np.arange(n), np.diff(wbase))
    _, which, times = np.unique(h ^ salt(wrow), return_inverse=True, return_counts=True)
    again = first[times[which] > 1]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.subtract.at(edge, again + REPEAT_WORDS, 1)
    repeated = np.cumsum(edge[:-1]) > 0
    # lines with a word, and which of them a text has had before
    line = np.zeros(len(data) + 1, bool)
    line[1:] = data == 0x0A
    line[off] = True
    start = np.flatnonzero(line[:-1]) if len(data) else np.zeros(0, np.int64)
    end = np.concatenate([start[1:], [len(data)]]).astype(np.int64) if len(start) else start
    in_line = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    lrow = np.searchsorted(off, start, "right") - 1
    full = in_line[end] > in_line[start]
    start, end, lrow = start[full], end[full], lrow[full]
    end = end - ((end > start) & (data[end - 1] == 0x0A)) if len(end) else end
    lines = _spans_hash(data, start, end)
    distinct = np.unique(lines ^ salt(lrow), return_index=True)[1]
    n_lines = np.bincount(lrow, minlength=n)
    last_word = w.end[np.searchsorted(w.start, end) - 1] - 1 if len(end) else end
    stops = np.bincount(lrow[_STOP[data[last_word]]], minlength=n) if len(end) else np.zeros(n, np.int64)
    seen = np.unique(w.hash ^ salt(rows), return_index=True)[1]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    return [n_words, _total(in_word & (data & 0xC0 != 0x80), off), _total(_SYMBOL[data], off),
            n_lines - np.bincount(lrow[distinct], minlength=n), np.bincount(rows[repeated], minlength=n),
            n_lines, stops, np.bincount(rows[seen], minlength=n),
            _total(_LETTER[data] & (data & 0xC0 != 0x80), off), _total(_UPPER[data], off), _total(_DIGIT[data], off),
            _total(_LOUD[data], off), np.bincount(rows[letters[w.end] > letters[w.start]], minlength=n)]


def _spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap."""
    cuts = np.unique(np.concatenate([[0, len(data)], start, end]))
    own = words(data, cuts, np.ones(256, bool), lower=False)
    return own.hash[np.searchsorted(own.start, start)]


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the counts behind the rules for every row's whole text (null: empty).

    Words are runs without ASCII white space. n_symbols counts
    ``# * $ % & | < >``; n_dup_lines the lines with a word that equal an
    earlier line of the text; n_repeat_words the words inside five-word
    windows that the text holds twice or more. All others are counts of words,
    lines or characters of the kind named.
    """
    ship_package(docs.sparkSession)
    out, names = _counted(docs, [id_col], text_col)
    return out.withColumnRenamed(names[0], id_col)


def _counted(docs: DataFrame, cols: list[str], text_col: str) -> tuple[DataFrame, list[str]]:
    def run(text):
        for _, _, data, off in slices(text):
            yield [pa.array(c, pa.int64()) for c in _slice_counts(data, off)]

    return beside(docs, cols, text_col, run, ", ".join(f"{c} bigint" for c in _COUNTS))


#: Votes: a rule finds its defect (BAD), finds traces of it (DOUBT), abstains or finds none (GOOD).
BAD, DOUBT, ABSTAIN, GOOD = range(4)


def _vote(bad: Column, doubt: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(doubt, DOUBT).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Graded votes over the counts. Measures of one defect share a rule, so that
    given the class the rules depend little on one another."""
    n, lines, letters, chars = (F.col(c) for c in ("n_words", "n_lines", "n_letters", "word_chars"))
    share = lambda part, of, limit: F.col(part) * 100 > of * limit
    plain = (letters + F.col("n_digits")) * 100
    poor = lambda limit: (n >= 50) & (F.col("n_distinct_words") * 100 < n * limit)
    full_lines = F.col("n_full_lines") * 100
    return {
        "length": _vote(n < 10, n < 20, n >= 40),
        "repetition": _vote(share("n_repeat_words", n, 20) | share("n_dup_lines", lines, 50) | poor(20),
                            share("n_repeat_words", n, 8) | share("n_dup_lines", lines, 25) | poor(30),
                            ~share("n_repeat_words", n, 3) & ~share("n_dup_lines", lines, 5)),
        "characters": _vote(share("n_symbols", n, 15) | (plain < chars * 88), share("n_symbols", n, 5) | (plain < chars * 92),
                            ~share("n_symbols", n, 2) & (plain >= chars * 93)),
        "shouting": _vote(share("n_upper", letters, 35) | share("n_loud", n, 15),
                          share("n_upper", letters, 15) | share("n_loud", n, 6),
                          ~share("n_upper", letters, 10) & ~share("n_loud", n, 4)),
        "words": _vote((chars > n * 13) | (chars * 2 < n * 5), (chars > n * 10) | (chars < n * 3),
                       (chars * 2 >= n * 7) & (chars <= n * 9)),
        "figures": _vote((F.col("n_letter_words") * 100 < n * 70) | share("n_digits", letters, 30),
                         (F.col("n_letter_words") * 100 < n * 85) | share("n_digits", letters, 12),
                         (F.col("n_letter_words") * 100 >= n * 90) & ~share("n_digits", letters, 6)),
        "lines": _vote((lines >= 3) & (full_lines < lines * 20), (lines >= 3) & (full_lines < lines * 50),
                       full_lines >= lines * 80),
    }


class LabelModel:
    """Votes given the hidden class, independent of one another, fitted by EM to vote patterns.

    ``table[j, y, v]`` is the probability that rule j votes v on a document of
    class y (0 bad, 1 good). The fit is a posterior mode: what is known of rules
    beforehand (``START``: a defect is found in an eighth of the bad documents
    and in two of a thousand good ones, traces in an eighth and in three of a hundred) and
    of the class balance (``prior_good``) weighs like ``prior_share`` of the
    rows, the same at every size. It keeps EM from taking the commonest single
    defect for the bad class; nothing bounds what a vote may say. Patterns carry
    their counts, so the fit covers every document and costs as much as there
    are patterns (at most 4 to the number of rules).
    """

    START = np.array([[0.12, 0.12, 0.20, 0.56], [0.002, 0.030, 0.200, 0.768]])

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior_good: float = 0.85, prior_share: float = 0.1,
                 rounds: int = 300, tolerance: float = 1e-7) -> None:
        self.good, self.table = prior_good, np.tile(self.START, (patterns.shape[1], 1, 1))
        if not len(counts):
            return
        seen = np.stack([patterns == v for v in range(4)], axis=2).astype(float)  # pattern, rule, vote
        rows = counts.sum()
        known = prior_share * rows * np.array([1 - prior_good, prior_good])
        for _ in range(rounds):
            odds = np.einsum("pjv,jv->p", seen, self.evidence()) + math.log(self.good / (1 - self.good))
            good = 1 / (1 + np.exp(-odds))
            post = np.stack([1 - good, good], axis=1) * counts[:, None]
            self.good = float((post[:, 1].sum() + known[1]) / (rows + known.sum()))
            before = self.table
            self.table = np.einsum("pjv,py->jyv", seen, post) + known[None, :, None] * self.START
            self.table /= self.table.sum(axis=2, keepdims=True)
            if abs(self.table - before).max() < tolerance:
                break

    def evidence(self) -> np.ndarray:
        """Log likelihood ratio, good to bad, of each rule's votes."""
        return np.log(self.table[:, 1]) - np.log(self.table[:, 0])

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a document is good, from its votes."""
        odds = F.lit(math.log(self.good) - math.log(1 - self.good))
        for vote, gain in zip(votes, self.evidence(), strict=True):
            odds = odds + F.element_at(F.array(*(F.lit(float(g)) for g in gain)), vote + 1)
        return 1 / (1 + F.exp(-odds))


def _votes() -> dict[str, Column]:
    return {f"vote_{name}": rule for name, rule in rules().items()}


def fit_rules(counts: DataFrame) -> LabelModel:
    """The label model of all rows of :func:`quality_counts`."""
    votes = _votes()
    patterns = counts.withColumns(votes).groupBy(*votes).count().collect()  # at most 4 ** len(votes) rows
    patterns.sort()
    return LabelModel(np.array([r[:-1] for r in patterns], int).reshape(-1, len(votes)), np.array([r[-1] for r in patterns], float))


def _decided(counts: DataFrame, model: LabelModel, threshold: float) -> DataFrame:
    votes = _votes()
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return (counts.withColumns(votes).withColumn("base_failed", failed)
            .withColumn("quality", model.posterior([F.col(v) for v in votes]))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the counts, base_failed, the votes
    (``vote_<rule>``), quality (posterior probability) and kept.

    base_failed: fewer than ten words, or more than a fifth of them in repeated
    five-word windows; such a document isn't kept, any other if quality is at
    least ``threshold``. The model is fitted without labels to the vote
    patterns of all rows. Null and empty texts have no words and fail; repeated
    rows count as often as they occur; an empty table gives an empty result.
    Other columns are not looked at.
    """
    counts = written(quality_counts(docs, id_col, text_col), "quality")
    return _decided(counts, fit_rules(counts), threshold)


def keep_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, each judged by its own text, with all their columns."""
    first = docs.columns[0]
    counts = written(quality_counts(docs, first, text_col).select(*_COUNTS), "quality")
    model = fit_rules(counts)
    out, names = _counted(docs, docs.columns, text_col)
    return (_decided(out, model, threshold).where("kept")
            .select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True))))
