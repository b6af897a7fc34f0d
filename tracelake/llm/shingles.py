"""Words and five-word shingles of whole texts, as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import numpy as np

from tracelake.llm.common import LOWER, SPACES, mix, slice_hashes


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every word: maximal runs of bytes other than ASCII white space."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~SPACES[data]
    # A word also ends where its text does.
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    hashes = slice_hashes(LOWER[data] if lower else data, starts, ends)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows, hashes


def rolled(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each of ``first`` on."""
    out = np.zeros(len(first), np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[first + i] + np.uint64(i + 1))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of distinct n-word shingles, sorted, end to end; and the sets' offsets.

    A text of 1 to n-1 words has its whole word sequence as one shingle; without words: none.
    """
    _, _, rows, hashes = words(data, offsets)
    texts = len(offsets) - 1
    count = np.bincount(rows, minlength=texts)
    begin = np.cumsum(count) - count
    at = np.arange(len(hashes))
    full = np.flatnonzero(at - begin[rows] <= count[rows] - n)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    bounds = np.r_[0, np.cumsum(size)]
    values = np.empty(bounds[-1], np.uint64)
    values[bounds[rows[full]] + at[full] - begin[rows[full]]] = rolled(hashes, full, n)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        values[bounds[short]] = mix(rolled(hashes, begin[short], k) + np.uint64(k))
    keep = np.ones(len(values), dtype=bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            part = values[a:b]
            part.sort()
            keep[a + 1 : b] = part[1:] != part[:-1]
    return values[keep], np.r_[0, np.cumsum(keep)][bounds]


def set_hashes(values: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each set (the order of its members doesn't count); of an empty set 0."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + np.uint64(salt)), out=sums[1:])
    size = np.diff(offsets)
    return np.where(size > 0, mix(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(np.uint64) * np.uint64(salt | 1)), 0)


def sketches(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """How many members of each set fall into each of 2**k buckets (k by the set's size), a byte each; 255: that or more."""
    mixed = mix(values + np.uint64(77))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        k = min(max((b - a).bit_length() - 1, 5), 11)
        count = np.bincount((mixed[a:b] >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
        out.append(np.minimum(count, 255).astype("u1").tobytes())
    return out


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches with fewer buckets."""
    whole = sketch.reshape(len(sketch), width, -1)
    return np.where((whole == 255).any(axis=2), 255, np.minimum(whole.sum(axis=2, dtype=np.int64), 255)).astype("u1")


def most_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most members that two sets can share, by their sketches (rows of equal width)."""
    least = np.minimum(a, b).astype(np.int64)
    return np.where(least == 255, 1 << 40, least).sum(axis=-1)
