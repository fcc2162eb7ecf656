"""Hashes of words and word shingles for whole columns of texts, in numpy.

A word is a maximal run of bytes but ASCII blanks, A-Z read as a-z. Its hash is
a polynomial in its bytes modulo 2**64, taken as a difference of running sums,
so that no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Values of the bytes: never zero, so that no byte vanishes at a word's end.
VALUES = np.arange(1, 257, dtype=np.uint64)
VALUES[65:91] += np.uint64(32)
PIECE = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


UP, DOWN = powers(BASE, PIECE), powers(pow(BASE, -1, 1 << 64), PIECE)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of the column in order, and the number of words of each row; null rows have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # A place before each byte and one after the last; rows part words like blanks do.
    full = ~BLANK[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~full[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(full & edge[:-1])
    edge[:-1] |= ~full
    ends = np.flatnonzero(full & edge[1:]) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        begin, n = int(starts[at]), int(ends[to - 1] - starts[at])
        up, down = (UP, DOWN) if n <= PIECE else (powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n))
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(VALUES[data[begin : begin + n]] * up[:n], out=sums[1:])
            s, e = starts[at:to] - begin, ends[at:to] - begin
            out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mixed(out), np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``width`` neighbouring words, by row; rows of fewer words are one shingle, rows without words none."""
    begins = np.cumsum(sizes) - sizes
    counts = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    out, padded = np.zeros(len(at), np.uint64), np.r_[hashes, np.zeros(width, np.uint64)]
    short = np.repeat(sizes < width, counts)
    ends = np.repeat(begins + sizes, counts)
    with np.errstate(over="ignore"):
        for k in range(width):
            more = out * np.uint64(BASE) + padded[at + k]
            out = np.where(short & (at + k >= ends), out, more) if short.any() else more
    return mixed(out), counts
