"""Word tables of whole text columns, vectorised over UTF-8 bytes.

Everything here works on one Arrow column at a time, in slices of bounded
size, so a task's memory depends on the longest single text and not on the
partition. Word hashes are 64-bit: a polynomial over a word's bytes, read off
a running sum, then mixed; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
#: Greatest power of the hashes' base that a worker keeps.
KEPT_POWERS = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LANES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size > KEPT_POWERS + 1:  # of one very long text: not kept
            return have
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(keep) -> np.ndarray:
    """A 256-entry table: is this byte part of a word?"""
    return np.array([bool(keep(b)) for b in range(256)])


#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null is empty.

    A slice holds at most ``max_bytes``, or one single longer text.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    """Words of consecutive texts: byte spans, 64-bit hashes, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    base: np.ndarray  # len(texts) + 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.base) - 1), np.diff(self.base))


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts ``data[off[i]:off[i+1]]``; none crosses a text's end."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(_BASE_INV, n + 1)[start]
    return Words(start, end, mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, off))


def windows(h: np.ndarray, base: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows: (hash, first word, window base per text).

    With ``short``, a text of fewer words but not none is one window.
    """
    counts = np.diff(base)
    n_win = np.where(counts >= k, counts - k + 1, (counts > 0) & short)
    wbase = np.concatenate([[0], np.cumsum(n_win)])
    first = np.arange(wbase[-1]) + np.repeat(base[:-1] - wbase[:-1], n_win)
    left = np.minimum(np.repeat(counts, n_win), k)
    out = left.astype(np.uint64) * _LANES[-1]
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    whole = bool((left == k).all())
    for j in range(k):
        term = padded[first + j] * _LANES[j]
        out += term if whole else np.where(j < left, term, np.uint64(0))
    return mix(out), first, wbase


def run_windows(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The hashes of :func:`windows` for the k-word windows that begin at ``first``."""
    out = np.full(len(first), k, np.uint64) * _LANES[-1]
    for j in range(k):
        out += h[first + j] * _LANES[j]
    return mix(out)


#: Bytes of text that travel to a Python worker at a time, where the session doesn't say otherwise.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark) -> None:
    """Arrow batches of at most :data:`BATCH_BYTES`, if the session has Spark's default of 64 MB:
    a batch is held in the JVM and in the worker, by every task at once."""
    if spark.conf.get(_BATCH_CONF) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def beside(docs, cols: list[str], text_col: str, run, fields: str):
    """``cols`` of every row, then the new columns that ``run`` makes of Arrow text columns.

    ``run(text)`` yields lists of arrays for consecutive slices of the column.
    Columns travel under positions, so no name clashes; the text travels once.
    """
    from pyspark.sql import functions as F

    small_batches(docs.sparkSession)
    sent = list(cols) if text_col in cols else [*cols, text_col]
    own = [docs.schema[c] for c in cols]
    names = [f"c{i}" for i in range(len(own))]
    new = [f.split()[0] for f in fields.split(", ")]
    text_at, n_own = sent.index(text_col), len(own)

    def mapped(batches):
        for batch in batches:
            lo = 0
            for arrays in run(batch.column(text_at)):
                n = len(arrays[0])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in batch.columns[:n_own]), *arrays],
                                                 names=[*names, *new])
                lo += n

    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, own, strict=True)]
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent))).mapInArrow(
        mapped, ", ".join([*kinds, fields]))
    return out, names
