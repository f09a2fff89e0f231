"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(2014)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word; words are runs of anything but ASCII white space, and A-Z count as a-z."""
    raw = np.frombuffer((text or "").encode().lower() + b" ", np.uint8)
    blank = _BLANK[raw]
    ends = np.flatnonzero(blank)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts
    real = lengths > 0
    starts, ends, lengths = starts[real], ends[real], lengths[real]
    if not len(starts):
        return np.zeros(0, np.uint64)
    kept = np.flatnonzero(~blank)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_BYTE[raw[kept]] * powers[place], first)
    return mixed(sums + lengths.astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of so many words; of the whole sequence if it is shorter; none without words."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    size = min(words, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += mixed(h[k : n - size + 1 + k] * _STEPS[k % 64] + np.uint64(k))
    return np.unique(mixed(total + np.uint64(size)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
