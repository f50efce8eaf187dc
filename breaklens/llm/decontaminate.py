"""Benchmark decontamination by suffix arrays over the training words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.llm.words import ALNUM, beside, slices, windows, words
from breaklens.session import ship_package

WINDOW_WORDS = 10
#: Bytes of text that are searched at a time: every slice is searched for the whole benchmark.
SLICE_BYTES = 1 << 20
#: Words of one suffix array; a longer stretch is cut into overlapping ones.
SHARD_WORDS = 1 << 20
#: Benchmark words of one broadcast block (8 bytes each, and as much again for the index).
BLOCK_WORDS = 1 << 20


class SuffixArray:
    """Suffixes of a word sequence in the order of their first ``depth`` words or more."""

    def __init__(self, seq: np.ndarray, depth: int) -> None:
        self.vocab, code = np.unique(seq, return_inverse=True)
        n = len(seq)
        self.code = np.concatenate([code.astype(np.int64) + 1, np.zeros(depth, np.int64)])
        rank, most, step = code.astype(np.int64) + 1, len(self.vocab), 1
        while step < depth:
            triple = (most + 1) ** 3 < 1 << 62
            shifted = [np.concatenate([rank[k * step:], np.zeros(min(n, k * step), np.int64)])
                       for k in range(1, 3 if triple else 2)]
            key = rank
            for s in shifted:
                key = key * (most + 1) + s
            distinct, rank = np.unique(key, return_inverse=True)
            rank, most, step = rank.astype(np.int64) + 1, len(distinct), step * (3 if triple else 2)
        self.order = np.argsort(rank, kind="stable")

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``order`` the suffixes begin that start with each query (a row of words)."""
        at = np.minimum(np.searchsorted(self.vocab, queries), len(self.vocab) - 1)
        known = (self.vocab[at] == queries).all(axis=1)
        wanted = at[known].astype(np.int64) + 1
        ends = []
        for upper in (False, True):
            lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.order))
            while (lo < hi).any():
                mid = (lo + hi) >> 1
                pos = self.order[np.minimum(mid, len(self.order) - 1)]
                less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
                for j in range(wanted.shape[1]):
                    here = self.code[pos + j]
                    less |= same & (here < wanted[:, j])
                    same &= here == wanted[:, j]
                right = (less | same if upper else less) & (lo < hi)
                lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
            ends.append(lo)
        first, last = (np.zeros(len(queries), np.int64) for _ in range(2))
        first[known], last[known] = ends
        return first, last


class QueryBlock:
    """Windows of a bounded block of benchmark items, grouped by their length."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int) -> None:
        self.names = [name for name, _ in items]
        self.window = window
        size = np.array([len(h) for _, h in items], np.int64)
        seq = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        h, first, wbase = windows(seq, np.concatenate([[0], np.cumsum(size)]), window, short=True)
        item = np.repeat(np.arange(len(items)), np.diff(wbase))
        length = np.minimum(size[item], window)
        self.groups = []
        for w in np.unique(length):
            mine = np.flatnonzero(length == w)
            _, one, which = np.unique(h[mine], return_index=True, return_inverse=True)
            by = np.argsort(which, kind="stable")
            queries = seq[first[mine[one]][:, None] + np.arange(w)[None, :]]
            self.groups.append((int(w), queries, np.concatenate([[0], np.cumsum(np.bincount(which))]),
                                item[mine[by]], first[mine[by]]))


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i] + 1, ... lo[i] + n[i] - 1 for every i."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _search(seq: np.ndarray, blocks, depth: int):
    """Hit flags, and for each group of windows (positions, items, places in the item, words, names) of its matches.

    Matches of all parts stay together, so a run goes on across their cuts."""
    hit = np.zeros(len(seq) + 1, np.int64)
    found: dict[tuple[int, int], list] = {}
    for lo in range(0, len(seq), SHARD_WORDS):
        part = seq[lo:lo + SHARD_WORDS + depth - 1]
        suffixes = SuffixArray(part, depth)
        for b, block in enumerate(blocks):
            for g, (w, queries, qbase, item, q_at) in enumerate(block.value.groups):
                first, last = suffixes.find(queries)
                n = last - first
                pos = suffixes.order[_expand(first, n)]
                which = np.repeat(np.arange(len(n)), n)
                own = pos < SHARD_WORDS  # the rest begins in the next part
                pos, which = pos[own] + lo, which[own]
                np.add.at(hit, pos, 1)
                np.subtract.at(hit, pos + w, 1)
                k = qbase[which + 1] - qbase[which]
                pos, at = np.repeat(pos, k), _expand(qbase[which], k)
                if len(pos):
                    found.setdefault((b, g), []).append((pos, item[at], q_at[at]))
    return np.cumsum(hit[:-1]) > 0, [
        (*(np.concatenate(x) for x in zip(*parts, strict=True)), blocks[b].value.groups[g][0], blocks[b].value.names)
        for (b, g), parts in found.items()]


def _longest_runs(pos: np.ndarray, item: np.ndarray, q_at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, words) of the maximal verbatim matches behind window matches."""
    order = np.lexsort((pos, pos - q_at, item))
    p, d, i = pos[order], (pos - q_at)[order], item[order]
    new = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(d) != 0) | (np.diff(i) != 0)])
    at = np.flatnonzero(new)
    return p[at], np.diff(np.concatenate([at, [len(p)]])) + w - 1


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int):
    """Broadcast blocks of the benchmark's windows, and the longest window's words."""
    context = benchmark.sparkSession.sparkContext
    blocks, held, size, depth = [], [], 0, 1
    queries = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col)).where(
        F.col(item_text_col).isNotNull())
    for name, text in queries.toLocalIterator():
        data = np.frombuffer(text.encode(), np.uint8)
        h = words(data, np.array([0, len(data)]), ALNUM).hash
        if not len(h):
            continue
        held.append((name, h))
        size, depth = size + len(h), max(depth, min(window, len(h)))
        if size >= block_words:
            blocks.append(context.broadcast(QueryBlock(held, window)))
            held, size = [], 0
    if held:
        blocks.append(context.broadcast(QueryBlock(held, window)))
    return blocks, depth


def _slice_matches(data: np.ndarray, off: np.ndarray, blocks, depth: int) -> list[pa.Array]:
    texts = len(off) - 1
    w = words(data, off, ALNUM)
    n, rows = np.diff(w.base), w.rows()
    seq = np.zeros(len(w.hash) + texts, np.uint64)  # a 0 after each text
    seq[np.arange(len(w.hash)) + rows] = w.hash
    row_of = np.repeat(np.arange(texts), n + 1)
    hit, found = _search(seq, blocks, depth) if blocks else (np.zeros(len(seq), bool), [])
    items: list[set] = [set() for _ in range(texts)]
    longest = np.zeros(texts, np.int64)
    longest_at = np.full(texts, np.iinfo(np.int64).max)
    for pos, item, q_at, width, names in found:
        pair = np.unique(row_of[pos] * np.int64(len(names)) + item)
        for r, i in zip((pair // len(names)).tolist(), (pair % len(names)).tolist(), strict=True):
            if names[i] is not None:
                items[r].add(names[i])
        p, length = _longest_runs(pos, item, q_at, width)
        first = p - (w.base[:-1] + np.arange(texts))[row_of[p]]
        order = np.lexsort((first, -length, row_of[p]))
        r = row_of[p][order]
        best = order[np.concatenate([[True], r[1:] != r[:-1]])]
        r = row_of[p][best]
        better = (length[best] > longest[r]) | ((length[best] == longest[r]) & (first[best] < longest_at[r]))
        longest[r[better]], longest_at[r[better]] = length[best][better], first[best][better]
    return [pa.array(n, pa.int64()), pa.array(np.bincount(row_of[hit], minlength=texts), pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.array(longest), pa.array(longest_at, mask=longest == 0)]


def _matched(docs: DataFrame, benchmark: DataFrame, cols: list[str], text_col: str, item_col: str,
             item_text_col: str, window: int, block_words: int) -> tuple[DataFrame, list[str]]:
    ship_package(docs.sparkSession)
    blocks, depth = _blocks(benchmark, item_col, item_text_col, window, block_words)

    def run(text):
        for _, _, data, off in slices(text, SLICE_BYTES):
            yield _slice_matches(data, off, blocks, depth)

    return beside(docs, cols, text_col, run,
                  "n_words bigint, n_hit bigint, items array<string>, longest bigint, longest_at bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_hit, items, longest, longest_at.

    Words are lower-cased runs of ASCII letters, digits and everything beyond
    ASCII. A window is ``window`` consecutive words of an item, or a whole
    shorter item. The words of a task's documents are sorted into suffix arrays
    of bounded size, in which every benchmark suffix's window is found by
    binary search; consecutive hits make up the verbatim matches. n_hit counts
    the words inside any occurrence, items lists the ids of the items with
    occurring windows (as strings, sorted), longest is the longest match in
    words and longest_at its first word (the first of equals; 0 and null
    without any).

    The benchmark is the stated query set: it is read block by block, at most
    ``block_words`` words (or one single longer item) each, and every block is
    searched in every suffix array. Null and wordless texts have no words and
    no windows; an item without id hits words but is not listed; items or
    documents may repeat. Other columns are not looked at.
    """
    out, names = _matched(docs, benchmark, [id_col], text_col, item_col, item_text_col, window, block_words)
    return out.withColumnRenamed(names[0], id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW_WORDS,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, each judged by its own text, with all their columns."""
    out, names = _matched(docs, benchmark, docs.columns, text_col, item_col, item_text_col, window, block_words)
    return out.where("n_hit = 0").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
