"""One-permutation MinHash with optimal densification, over sorted hash sets."""

from __future__ import annotations

import numpy as np

from breaklens.llm.words import mix


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


class OnePermutation:
    """Signatures of ``n_bins`` bins: each holds the least hash that falls into it.

    An empty bin takes the value of the first filled bin in an order of all
    bins drawn for that bin alone (optimal densification), so two sets with
    few elements agree per bin about as often as their similarity says.
    """

    def __init__(self, n_bins: int, seed: int = 11) -> None:
        if n_bins & (n_bins - 1):
            raise ValueError("n_bins must be a power of two")
        self.n_bins = n_bins
        self._shift = np.uint64(64 - n_bins.bit_length() + 1)
        self._edges = np.arange(n_bins, dtype=np.uint64) << self._shift
        rng = np.random.Generator(np.random.PCG64(seed))
        self._order = rng.permuted(np.tile(np.arange(n_bins, dtype=np.int16), (n_bins, 1)), axis=1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Of one non-empty sorted set of 64-bit hashes."""
        at = np.searchsorted(hashes, self._edges)
        nearest = hashes[np.minimum(at, len(hashes) - 1)]
        filled = (at < len(hashes)) & (nearest >> self._shift == np.arange(self.n_bins, dtype=np.uint64))
        if not filled.all():
            have, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
            nearest[empty] = nearest[have[self._order[np.ix_(empty, have)].argmin(axis=1)]]
        return nearest


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` bins; equal only where all rows of the band agree."""
    n, bins = signatures.shape
    bands = signatures.reshape(n, bins // rows, rows)
    key = np.arange(1, bins // rows + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        key = mix(key ^ bands[:, :, j]) + key
    return key
