"""Runs of chosen characters of whole columns of texts, cut out in numpy as one Arrow column of lower-cased strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are cut at once; a segment ends where a run does, so a longer run is one segment.
SEGMENT = 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column, and where each row begins and the last one ends; null rows are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(texts: pa.Array, inside: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For each segment of the column, the maximal runs of bytes that are ``inside``, A-Z lower-cased, and the row of each.

    ``inside`` tells of each byte whether its character belongs to runs. Rows part runs.
    """
    data, offsets = bytes_of(texts)
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        own = inside(data[at:end])
        while end < len(data) and own[-1]:
            # The run at the end goes on: the segment grows until one ends or a row does.
            end = min(len(data), end + SEGMENT)
            own = inside(data[at:end])
            past = np.flatnonzero(~own[SEGMENT - 1 :])
            if len(past):
                end = at + SEGMENT - 1 + int(past[0])
                own = own[: end - at]
                break
        begins = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")] - at
        first = own.copy()
        first[1:] &= ~own[:-1]
        rows = begins[begins < len(own)]
        first[rows] = own[rows]
        starts = np.flatnonzero(first)
        if len(starts):
            # Runs that touch (a row ends and the next begins) still have their own starts.
            sizes = np.add.reduceat(own.astype(np.int64), starts)
            ends = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(sizes, out=ends[1:])
            found = LOWER[data[at:end][own]]
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(found))
            yield words, np.searchsorted(offsets, starts + at, "right") - 1
        at = end
