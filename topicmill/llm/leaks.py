"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A benchmark item and a text become sequences of five-word shingles. An item is
stood for by a piece from its middle, as long as the largest window size that
fits; windows of that size slide over every whole text. Sizes grow by a factor
of 1.15, and a window moves by an eighth of its size at most, so an item's copy
has a window that holds at least 15/16 of the piece. Items over the largest size
get several pieces, the last at their end. A text that is shorter than an item's
piece has no window of that size: it is compared with every such item whose
shared shingles weigh enough, and none is missed.

Window fingerprints come from running sums: eight words of eight one-byte lanes
hold the 64 bit counts, and a window's counts are a difference of two sums.

Pieces are found within ``RADIUS`` bits by multi-index hashing: of four blocks of
16 bits, one differs in RADIUS // 4 bits or fewer, and tables list the pieces of
every such block value, which guarantees all pieces within the radius. Each
candidate is then compared with the item itself: weighted Jaccard similarity of
the shingles, best over the starts that the window allows. An item's shingle
weighs 1 / (number of different items that hold it), counted over the whole
benchmark; a shingle that the item lacks weighs as the item's do on average.

The benchmark is the query set, the documents are searched in blocks of it. Its
shingles are counted by Spark; a block of ``ITEM_BLOCK`` items or ``BLOCK_BYTES``
is broadcast; one scan of the documents serves ``ROUND`` blocks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .hashing import shingle_hashes, word_hashes

SHINGLE, THRESHOLD, RADIUS, LARGEST = 5, 0.8, 15, 200
ITEM_BLOCK, BLOCK_BYTES, ROUND = 2048, 4 << 20, 16
CHUNK = 40_000
ONES = np.uint64(0x0101010101010101)
#: Bits that the hash table of known shingles is addressed by.
TABLE_BITS = 20
Item = tuple[object, np.ndarray, np.ndarray]  # id, shingles in order, weight of each


def window_sizes(largest: int = LARGEST) -> list[int]:
    sizes = list(range(1, 11))
    while sizes[-1] < largest:
        sizes.append(min(largest, max(sizes[-1] + 1, round(sizes[-1] * 1.15))))
    return sizes


def shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all rows, and their number in each row.

    A text of fewer words is one shingle, a null text or one without words none.
    """
    return shingle_hashes(*word_hashes(texts), SHINGLE)


def running_sums(shingles: np.ndarray) -> np.ndarray:
    """Row i: the sums over the first i shingles, bit 8 j + k counted in byte j of word k, modulo 2**64."""
    sums = np.zeros((len(shingles) + 1, 8), np.uint64)
    for k in range(8):
        np.cumsum((shingles >> np.uint64(k)) & ONES, out=sums[1:, k])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Of the windows of ``size`` shingles: a bit is 1 if over half of them have it."""
    lanes = sums[starts + size] - sums[starts]
    lanes += ONES * np.uint64(127 - size // 2)
    lanes >>= np.uint64(7)
    lanes &= ONES
    out = lanes[:, 0].copy()
    for k in range(1, 8):
        out |= lanes[:, k] << np.uint64(k)
    return out


class Benchmark:
    """A block of items, their pieces by window size, and the block tables (built where they are used)."""

    def __init__(self, items: list[Item], threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        self.items = [(i, s) for i, s, _ in items]
        self.weights = [dict(zip(s.tolist(), w.tolist(), strict=True)) for _, s, w in items]
        self.bags = [Counter(s.tolist()) for _, s, _ in items]
        self.total = np.array([w.sum() for _, _, w in items])
        self.foreign = np.array([w.mean() for _, _, w in items])
        self.longest = max((len(s) for _, s in self.items), default=0)
        sizes, pieces = window_sizes(), defaultdict(list)
        self.piece = np.array([max(w for w in sizes if w <= len(s)) for _, s in self.items], np.int64)
        for at, (_, s) in enumerate(self.items):
            size = int(self.piece[at])
            offsets = [(len(s) - size) // 2] if len(s) <= LARGEST * 1.15 else sorted({*range(0, len(s) - size + 1, size), len(s) - size})
            sums = running_sums(s)
            for offset in offsets:
                pieces[size].append((at, offset, fingerprints(sums, np.array([offset]), size)[0]))
        rows = sorted((h, at, n) for at, bag in enumerate(self.bags) for h, n in bag.items())
        self.known = np.array([h for h, _, _ in rows], np.uint64)
        self.holder = np.array([at for _, at, _ in rows], np.int64)
        self.held = np.array([n for _, _, n in rows], np.int64)
        self.weight = np.array([self.weights[at][h] for h, at, _ in rows])
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.known >> np.uint64(64 - TABLE_BITS)] = True
        self.groups = [self._index(size, own[k : k + 64]) for size, own in sorted(pieces.items()) for k in range(0, len(own), 64)]

    def _index(self, size: int, own: list) -> tuple:
        near = [0, *(sum(1 << b for b in bits) for n in range(1, self.radius // 4 + 1) for bits in combinations(range(16), n))]
        near = np.array(near, np.uint16)
        tables = np.zeros((4, 1 << 16), np.uint64)
        for k, (_, _, code) in enumerate(own):
            for b in range(4):
                tables[b, near ^ np.uint16(int(code) >> 16 * b & 0xFFFF)] |= np.uint64(1 << k)
        return size, own, tables, np.array([c for _, _, c in own], np.uint64)

    def best(self, at: int, region: list[int], width: int) -> tuple[float, int]:
        """The best similarity of the item to ``width`` neighbouring shingles of ``region``, and their start.

        One window is counted in full; the next ones change by a shingle on each side.
        """
        bag, weights, foreign = self.bags[at], self.weights[at], float(self.foreign[at])
        held: Counter = Counter()
        low, high, found = 0.0, float(self.total[at]), (0.0, 0)
        for p, h in enumerate(region):
            held[h] += 1
            if held[h] <= bag[h]:
                low += weights[h]
            else:
                high += weights.get(h, foreign)
            if p >= width:
                old = region[p - width]
                if held[old] <= bag[old]:
                    low -= weights[old]
                else:
                    high -= weights.get(old, foreign)
                held[old] -= 1
            if p >= width - 1 or p == len(region) - 1:
                found = max(found, (low / high, -max(0, p - width + 1)))
        return found[0], -found[1]

    def search_short(self, shingles: np.ndarray) -> dict[int, tuple[float, int]]:
        """Of one whole text: item -> (similarity, 0) for the items whose pieces are longer, if it reaches the threshold."""
        found: dict[int, tuple[float, int]] = {}
        own, counts = np.unique(shingles, return_counts=True)
        low, high = np.searchsorted(self.known, own, "left"), np.searchsorted(self.known, own, "right")
        shared = np.zeros(len(self.items))
        for n, a, b in zip(counts.tolist(), low.tolist(), high.tolist(), strict=True):
            if a < b:
                shared[self.holder[a:b]] += self.weight[a:b] * np.minimum(n, self.held[a:b])
        for at in np.flatnonzero((self.piece > len(shingles)) & (shared > 0) & (shared >= self.threshold * self.total - 1e-9)).tolist():
            s, _ = self.best(at, shingles.tolist(), len(shingles))
            if s >= self.threshold - 1e-9:
                found[at] = (s, 0)
        return found

    def search(self, shingles: np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """Over several texts laid end to end: (text, item) -> (similarity, start), if it reaches the threshold."""
        found: dict[tuple[int, int], tuple[float, int]] = {}
        ends = np.cumsum(lengths)
        begins = ends - lengths
        # Only texts with a known shingle can be similar; a few others pass the table by chance.
        marked = np.r_[0, np.cumsum(self.table[shingles >> np.uint64(64 - TABLE_BITS)])]
        for k in np.flatnonzero((lengths > 0) & (lengths < self.piece.max(initial=0)) & (marked[ends] > marked[begins])).tolist():
            for at, hit in self.search_short(shingles[begins[k] : ends[k]]).items():
                found[k, at] = hit
        sums, size_of_marks = running_sums(shingles), 0
        asked: set[tuple[int, int, int]] = set()
        for size, own, tables, codes in self.groups:
            step = max(1, size // 8)
            if size_of_marks != size:
                # Windows at every step, and one at the end of each text.
                counts = np.where(lengths >= size, -(-(lengths - size) // step) + 1, 0)
                text = np.repeat(np.arange(len(lengths)), counts)
                turn = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = begins[text] + np.minimum(turn * step, lengths[text] - size)
                marks, size_of_marks = fingerprints(sums, starts, size), size
            blocks = marks.view(np.uint16).reshape(-1, 4)
            masks = tables[0][blocks[:, 0]]
            for b in range(1, 4):
                masks |= tables[b][blocks[:, b]]
            # One candidate of each window at a time, the one of the lowest bit left.
            where = np.flatnonzero(masks)
            masks = masks[where]
            while len(where):
                lowest = masks & (~masks + np.uint64(1))
                piece = np.bitwise_count(lowest - np.uint64(1))
                close = np.flatnonzero(np.bitwise_count(marks[where] ^ codes[piece]) <= self.radius)
                for hit, k in zip(where[close].tolist(), piece[close].tolist(), strict=True):
                    at, offset, _ = own[k]
                    t, start = int(text[hit]), int(starts[hit]) - offset
                    if (t, at, start) not in asked:
                        asked.add((t, at, start))
                        self._verify(at, start, step, t, shingles, int(begins[t]), int(ends[t]), found)
                masks ^= lowest
                left = masks > 0
                where, masks = where[left], masks[left]
        return found

    def _verify(self, at: int, start: int, step: int, text: int, shingles: np.ndarray, begin: int, end: int, found: dict) -> None:
        n = len(self.items[at][1])
        low = max(begin, min(start - step, end - n))
        region = shingles[low : min(end, max(low, start + step) + n)].tolist()
        if self.bags[at].keys().isdisjoint(region):
            return
        s, p = self.best(at, region, n)
        if s >= self.threshold - 1e-9 and s > found.get((text, at), (0,))[0]:
            found[text, at] = (s, low + p - begin)


def weighed(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``shingles`` in order and their ``weights``, for each different item that has words."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found, sizes = shingles_of(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "shingles"]).filter(pa.array(sizes > 0))

    cut_items = items.mapInArrow(cut, f"item_id {kind}, shingles array<long>")
    held = cut_items.select("shingles").distinct().select(F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    placed = cut_items.select("item_id", F.xxhash64("shingles").alias("key"), F.posexplode("shingles").alias("pos", "shingle")).join(held.where("n > 1"), "shingle", "left")
    rows = placed.groupBy("item_id", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "shingle", (1 / F.coalesce("n", F.lit(1))).alias("w")))).alias("all"))
    return rows.select("item_id", "key", F.col("all.shingle").alias("shingles"), F.col("all.w").alias("weights"))


def rounds_of(benchmark: DataFrame) -> Iterator[list]:
    """Broadcast blocks of items, ``ROUND`` at a time; the driver holds one block."""
    items = checkpointed(weighed(benchmark))
    count, volume = items.agg(F.count("*"), F.coalesce(F.sum(16 * F.size("shingles")), F.lit(0))).first()
    parts = max(-(-count // ITEM_BLOCK), -(-volume // BLOCK_BYTES))
    context = benchmark.sparkSession.sparkContext
    for begin in range(0, parts, ROUND):
        blocks = []
        for k in range(begin, min(parts, begin + ROUND)):
            own = items.where(F.pmod(F.xxhash64("item_id", "key"), F.lit(parts)) == k).orderBy("item_id", "key").collect()
            blocks.append(context.broadcast([(r["item_id"], np.array(r["shingles"], np.int64).view(np.uint64), np.array(r["weights"])) for r in own]))
        yield blocks


def hits(batches: Iterator[pa.RecordBatch], blocks: list[list[Item]], threshold: float, radius: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """Each batch with the list of (item_id, similarity, start) of its texts; long texts are cut with overlaps.

    With several blocks, each has its tables built anew for every batch, so that a task holds those of one.
    """
    single = Benchmark(blocks[0], threshold, radius) if len(blocks) == 1 else None

    def search(index: Benchmark, shingles: np.ndarray, sizes: np.ndarray, out: list[dict]) -> None:
        ends = np.cumsum(sizes)
        held: list[tuple[int, int, int, int]] = []  # row, start in its text, and where the part lies
        volume = 0

        def flush() -> None:
            parts = [shingles[a:b] for _, _, a, b in held]
            for (k, at), (s, start) in index.search(np.concatenate(parts), np.array([len(p) for p in parts])).items():
                row, begin, _, _ = held[k]
                known = out[row].get((index, at), (0.0, 0))
                if s > known[0]:
                    out[row][index, at] = (s, begin + start)

        for row, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
            for begin in range(0, size, CHUNK):
                to = min(size, begin + CHUNK + index.longest * 2)
                held.append((row, begin, end - size + begin, end - size + to))
                volume += to - begin
                if volume >= CHUNK:
                    flush()
                    held, volume = [], 0
        if held:
            flush()

    for batch in batches if single is None else small_batches(batches):
        shingles, sizes = shingles_of(batch.column(batch.schema.get_field_index("text")))
        rows: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
        for block in blocks:
            index, out = single or Benchmark(block, threshold, radius), [{} for _ in range(batch.num_rows)]
            search(index, shingles, sizes, out)
            for row, own in zip(rows, out, strict=True):
                row += [(index.items[at][0], s, start) for (_, at), (s, start) in sorted(own.items(), key=lambda x: x[0][1])]
        yield batch, rows


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity`` and ``first_word`` for each item found in each row of ``docs``.

    Null, empty and blank texts and items match nothing. Repeated rows are
    searched each; repeated items count once, and an id that several items share
    is reported once for each. Other columns are not read. An empty benchmark
    gives no rows.
    """
    given = docs.select("doc_id", "text")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, first_word long"
    found = []
    for blocks in rounds_of(benchmark):

        def search(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch, own in hits(batches, [b.value for b in blocks], threshold, radius):
                rows = [(batch.column(0)[k].as_py(), *hit) for k, row in enumerate(own) for hit in row]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "similarity", "first_word"])

        part = given.mapInArrow(search, kinds)
        if len(blocks) == ROUND:
            # There may be another round: this one ends here, and its blocks can go.
            part = checkpointed(part)
            for b in blocks:
                b.unpersist()
        found.append(part)
    out = docs.sparkSession.createDataFrame([], kinds)
    for part in found:
        out = part if part is found[0] else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` in which ``find`` finds nothing, with all their columns.

    Rows with null, empty or blank texts stay, and so do repeated rows. An empty
    benchmark keeps all. Columns may have any names besides ``text``.
    """
    for blocks in rounds_of(benchmark):

        def keep(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch, found in hits(batches, [b.value for b in blocks], threshold, radius):
                yield batch.filter(pa.array([not own for own in found], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        if len(blocks) == ROUND:
            docs = checkpointed(docs)
            for b in blocks:
                b.unpersist()
    return docs
