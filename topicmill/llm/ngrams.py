"""Word n-gram scoring with a weighted backoff automaton.

The model has order ``ORDER``. With the count c(h) of a history h and h' for h
without its first word, P(w | h) = (c(h w) + k(h) P(w | h')) / (c(h) + k(h)) and
k(h) = strength * c(h)**growth, so that the share k / (c + k) left to shorter
histories falls as a history grows more frequent; P(w) = (c(w) + 1) / (N + V + 1)
without a history. This sums to one for any k and needs counts only.

As an automaton: a state is a history that occurs in training; it has an arc for
each word seen after it, with log10 P(w | h) as weight and the longest suffix of
h w that is a state as target. Any other word takes the failure arc, weight
log10(k / (c + k)), to the state of h', and is tried again there. The empty state
has an arc for every word. Texts are read left to right, one state carried along.

No machine holds the model. The rows of a task are cut into blocks. A block asks
for the counts of its n-grams, and gives what its own training texts add to them;
both cross the network once, as sorted hashes by ranges of the hash:

  documents -> blocks -> sorted n-gram hashes by range -> summed and answered per
  range -> each block builds the part of the automaton its texts can reach.

Texts are not shuffled: a block meets its answers as numbers of its words. A block
and range meet only if they share an n-gram, so the rows exchanged are never more
than the n-grams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .hashing import mixed, word_hashes

#: The tokens before and after a text: their labels in every block, and their hashes.
START_LABEL, END_LABEL = 0, 1
EDGES = np.array([0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)
ORDER = 3
STRENGTH, GROWTH = 3.0, 0.85
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Hashes are so many bits longer than the number of bytes: another n-gram shares one with a probability below 2**-SPARE.
SPARE = 20
SEGMENT = 256


def pack(values: np.ndarray) -> bytes:
    """Planes of bytes without the upper ones that are zero; the two uppermost left are sparse and get compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1
    cut = max(0, used - 2)
    return np.array([len(values), used], np.int64).tobytes() + planes[:cut].tobytes() + zlib.compress(planes[cut:used].tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    n, used = (int(x) for x in np.frombuffer(data, np.int64, 2))
    raw = 16 + n * max(0, used - 2)
    planes = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
    planes[:used] = np.frombuffer(data[16:raw] + zlib.decompress(data[raw:]), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its rank among the distinct ones, and for each of those a place that holds it."""
    n, places = len(keys), len(keys).bit_length()
    if n and int(keys.max()).bit_length() + places < 64:
        # Keys and places in one number: sorting those is several times faster than an argsort.
        both = np.sort(keys.astype(np.int64) << places | np.arange(n))
        order, ranked = both & (1 << places) - 1, both >> places
    else:
        order = np.argsort(keys)
        ranked = keys[order]
    new = np.ones(n, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


class Block:
    """Some texts as labels (numbers of their words), and their distinct n-grams by level.

    Texts are laid end to end, a start before and an end after each. ``ids[n]``
    numbers the n-gram that ends at each place, -1 where a text has none; for
    every n-gram ``before``, ``last`` and ``suffix`` are its history, its last
    label, and itself without its first word, as numbers of their own levels.
    """

    def __init__(self, labels: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, order: int):
        self.labels, self.sizes, self.hashes, self.order = labels.astype(np.int32), sizes, hashes, order
        self.begins = np.cumsum(sizes) - sizes
        offset = np.arange(len(labels)) - np.repeat(self.begins, sizes)
        width = len(hashes)
        self.ids, self.sums = [None, self.labels], [None, width]
        self.before, self.last, self.suffix = [None, None], [None, np.arange(width, dtype=np.int32)], [None, None]
        for n in range(2, order + 1):
            at = np.flatnonzero(offset >= n - 1)
            shorter = self.ids[n - 1]
            rank, where = numbered(shorter[at - 1].astype(np.int64) * width + self.labels[at])
            where = at[where]
            ids = np.full(len(labels), -1, np.int32)
            ids[at] = rank
            self.ids.append(ids)
            self.sums.append(len(where))
            self.before.append(shorter[where - 1])
            self.last.append(self.labels[where])
            self.suffix.append(shorter[where])

    @classmethod
    def read(cls, texts: pa.Array, order: int) -> Block:
        words, sizes = word_hashes(texts)
        labels, where = numbered(words)
        known, seen = words[where], np.bincount(labels, minlength=len(where))
        # Frequent words get small labels, which pack well.
        ranked = np.argsort(-seen, kind="stable")
        label = np.empty(len(known), np.int64)
        label[ranked] = np.arange(len(known)) + len(EDGES)
        ends = np.cumsum(sizes + 2)
        flat = np.zeros(len(words) + 2 * len(sizes), np.int64)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = inner[ends - sizes - 2] = False
        flat[inner], flat[ends - 1] = label[labels], END_LABEL
        return cls(flat, sizes + 2, np.r_[EDGES, known[ranked]], order)

    def keys(self, bits: int) -> np.ndarray:
        """Hashes of all n-grams, level by level."""
        out = [mixed(self.hashes)]
        with np.errstate(over="ignore"):
            for n in range(2, self.order + 1):
                out.append(mixed(out[-1][self.before[n]] * np.uint64(0x2545F4914F6CDD1D) + out[0][self.last[n]] + np.uint64(n)))
        # The last bit tells words from longer n-grams.
        out[0], out[1:] = out[0] & ~(np.uint64(1) << np.uint64(64 - bits)), [h | np.uint64(1) << np.uint64(64 - bits) for h in out[1:]]
        return np.concatenate(out) >> np.uint64(64 - bits)

    def counts(self, trains: np.ndarray) -> np.ndarray:
        """How often the texts marked in ``trains`` hold each n-gram, in the order of ``keys``."""
        held = np.repeat(trains, self.sizes)
        out = []
        for n in range(1, self.order + 1):
            own = self.ids[n][held]
            out.append(np.bincount(own[own >= 0], minlength=self.sums[n]).astype(np.uint64))
        return np.concatenate(out)


class Automaton:
    """The part of the model that a block's texts can reach: states, arcs and failure arcs.

    State 0 is the empty history. Arcs are sorted by source and label.
    """

    def __init__(self, block: Block, counts: np.ndarray, total: int, distinct: int, strength: float, growth: float):
        self.width, self.order = len(block.hashes), block.order
        seen = [None, *np.split(counts.astype(np.float64), np.cumsum(block.sums[1:])[:-1])]
        probability = (seen[1] + 1) / (total + distinct + 1)
        self.known, self.plain = seen[1] > 0, np.log10(probability)
        share = [None, *(strength * np.maximum(c, 1) ** growth for c in seen[1:])]
        n_states, resolved, keys, weights, targets = 1, None, [], [], []
        fails, fail_weights = [np.zeros(1, np.int64)], [np.zeros(1)]
        for n in range(1, self.order + 1):
            shorter = resolved
            if n < self.order:
                lives = (seen[n] > 0) & (block.last[n] != END_LABEL)
                resolved = np.zeros(block.sums[n], np.int64) if n == 1 else shorter[block.suffix[n]]
                fails.append(resolved[lives])
                fail_weights.append(np.log10(share[n][lives] / (seen[n][lives] + share[n][lives])))
                resolved[lives] = n_states + np.arange(int(lives.sum()))
                n_states += int(lives.sum())
            if n == 1:
                self.first = resolved if self.order > 1 else np.zeros(self.width, np.int64)
            else:
                history = seen[n - 1][block.before[n]]
                lower = probability[block.suffix[n]]
                k = share[n - 1][block.before[n]]
                probability = np.where(history > 0, (seen[n] + k * lower) / (history + k), lower)
                arc = seen[n] > 0
                keys.append(shorter[block.before[n][arc]] * self.width + block.last[n][arc])
                weights.append(np.log10(probability[arc]))
                targets.append(resolved[arc] if n < self.order else shorter[block.suffix[n][arc]])
        none = np.array([np.iinfo(np.int64).max])
        self.keys = np.concatenate([*keys, none])
        self.weights, self.targets = np.concatenate([*weights, [0.0]]), np.concatenate([*targets, [0]])
        self.fails, self.fail_weights = np.concatenate(fails), np.concatenate(fail_weights)

    def step(self, states: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading ``labels`` in ``states``, and the weights of the arcs on the way."""
        states, weight = states.copy(), np.zeros(len(states))
        after, open_ = np.zeros(len(states), np.int64), np.arange(len(states))
        while len(open_):
            own, label = states[open_], labels[open_]
            empty = own == 0
            done = open_[empty]
            weight[done] += self.plain[label[empty]]
            after[done] = self.first[label[empty]]
            open_, own, label = open_[~empty], own[~empty], label[~empty]
            key = own * self.width + label
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            done, arc = open_[hit], at[hit]
            weight[done] += self.weights[arc]
            after[done] = self.targets[arc]
            open_, own = open_[~hit], own[~hit]
            weight[open_] += self.fail_weights[own]
            states[open_] = self.fails[own]
        return after, weight

    def walk(self, block: Block) -> np.ndarray:
        """The weight of each text. Texts advance together; long ones in segments.

        A state depends on the last order - 1 tokens only, so a segment starts in
        the empty state so many tokens early, and their weights are not counted.
        """
        warm, n = self.order - 1, block.sizes - 1
        pieces = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), pieces)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        skip = np.where(turn > 0, warm, 0)
        begin = block.begins[text] + 1 + turn * SEGMENT - skip
        length = np.minimum(SEGMENT, n[text] - turn * SEGMENT) + skip
        order = np.argsort(-length, kind="stable")
        text, skip, begin, length = text[order], skip[order], begin[order], length[order]
        states = np.where(skip > 0, 0, self.first[START_LABEL])
        total = np.zeros(len(text))
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, "left"))
            states[:live], weight = self.step(states[:live], block.labels[begin[:live] + t])
            total[:live] += np.where(t >= skip[:live], weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(n))

    def score(self, block: Block) -> dict[str, np.ndarray]:
        tokens = block.labels.copy()
        tokens[block.begins] = END_LABEL
        known, plain = self.known[tokens].astype(np.int64), self.plain[tokens]
        known[block.begins], plain[block.begins] = 0, 0.0
        return {
            "n_tokens": block.sizes - 1,
            "n_known": np.add.reduceat(known, block.begins),
            "base_score": np.add.reduceat(plain, block.begins),
            "score": self.walk(block),
        }


ROW = "dest int, block long, shard int, one binary, two binary, three binary, tokens long, words long"


def as_table(rows: list[tuple]) -> pa.Table:
    kinds = {"dest": pa.int32(), "block": pa.int64(), "shard": pa.int32(), "one": pa.binary(), "two": pa.binary(), "three": pa.binary(), "tokens": pa.int64(), "words": pa.int64()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)})


def blocks_of(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in runs of about ``block_bytes``."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held, volume = [], 0
    for batch in small_batches(batches):
        if batch.num_rows:
            held.append(batch)
            volume += batch.nbytes
        if volume >= block_bytes:
            yield joined(held)
            held, volume = [], 0
    if held:
        yield joined(held)


def package(batch: pa.RecordBatch, block: Block) -> tuple:
    """A block as a row: its name, a hash of all it holds; ids and sizes of its texts, labels, and words."""
    sink = pa.BufferOutputStream()
    own = pa.table({"doc_id": batch.column(0), "held_out": batch.column(2), "size": pa.array(block.sizes)})
    with pa.ipc.new_stream(sink, own.schema) as stream:
        stream.write_table(own)
    head, labels, hashes = sink.getvalue().to_pybytes(), block.labels.astype(np.uint32), block.hashes.tobytes()
    digest = hashlib.blake2b(digest_size=8)
    for column in (own.column(0).to_pylist(), own.column(1).to_pylist()):
        digest.update(repr(column).encode())
    for data in (block.sizes.tobytes(), labels.tobytes(), hashes):
        digest.update(data)
    return 0, int.from_bytes(digest.digest(), "little", signed=True), -1, head, pack(labels), pack(block.hashes), 0, 0


def packages(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks_of(batches, block_bytes):
        yield as_table([package(batch, Block.read(batch.column(1), 1))]).to_batches()[0]


def ask(batches: Iterator[pa.RecordBatch], shards: int, bits: int, order: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Every block's questions to each range of hashes."""
    for batch in blocks_of(batches, block_bytes):
        block = Block.read(batch.column(1), order)
        name = package(batch, block)[1]
        keys = block.keys(bits)
        counts = block.counts(~batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
        sort = np.argsort(keys)
        keys, counts = keys[sort], counts[sort]
        edges = np.searchsorted(keys, edges_of(shards, bits))
        rows = [(s, name, s, pack(np.diff(k, prepend=np.uint64(0))), pack(c), None, 0, 0) for s, (k, c) in enumerate(zip(np.split(keys, edges), np.split(counts, edges), strict=True)) if len(k)]
        yield from as_table(rows).to_batches()


def edges_of(shards: int, bits: int) -> np.ndarray:
    return np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)


def answer(table: pa.Table, start_key: int) -> pa.Table:
    """Of one range: the summed counts for each block in the order asked; the range's training tokens and different ones, once."""
    names, shard = table.column("block").to_pylist(), table.column("shard").to_pylist()
    asked = [np.cumsum(unpack(k.as_py(), np.uint64), dtype=np.uint64) for k in table.column("one")]
    given = np.concatenate([unpack(c.as_py(), np.uint64) for c in table.column("two")])
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    # As two halves, float sums of whole numbers stay exact beyond 2**53.
    low, high = np.bincount(at, weights=given & np.uint64(0xFFFFFFFF)), np.bincount(at, weights=given >> np.uint64(32))
    sums = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
    own = sums[(keys & np.uint64(1) == 0) & (keys != np.uint64(start_key))]
    told = np.split(sums[at], np.cumsum([len(k) for k in asked])[:-1])
    counts = [(int(own.sum()), int((own > 0).sum()))] + [(0, 0)] * (len(told) - 1)
    return as_table([(0, name, s, pack(t), None, None, *n) for name, s, t, n in zip(names, shard, told, counts, strict=True)])


def score(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = ORDER, strength: float = STRENGTH, growth: float = GROWTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row's log10 probability under a model of the rows that are not held out.

    Null and empty texts have one token, the end. A null id counts as the empty
    text where rows are held out. Repeated rows count as often as they occur.
    Without training rows all counts are 0. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == held
    rows = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"), held_out.alias("held_out"))
    volume = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards, bits = int(max(8, -(-volume // RANGE_BYTES))), int(min(64, volume.bit_length() + SPARE))
    start_key = int(Block(np.zeros(1, np.int64), np.ones(1, np.int64), EDGES[:1], 1).keys(bits)[0])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from ask(batches, shards, bits, order, block_bytes)

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packages(batches, block_bytes)

    def scoring(table: pa.Table) -> pa.Table:
        shard = np.array(table.column("shard").to_pylist())
        own = np.flatnonzero(shard < 0)
        # Equal blocks share a name; each range then answers each of them, and all are told the same.
        asked, first = np.unique(shard, return_index=True)
        if not len(own) or len(own) * (len(asked) - 1) != len(shard) - len(own):
            raise RuntimeError("the rows of a task differ between two reads: write such a table down before it is scored")
        at = int(own[0])
        texts = pa.ipc.open_stream(table.column("one")[at].as_py()).read_all()
        block = Block(unpack(table.column("two")[at].as_py(), np.uint32), texts.column("size").to_numpy(), unpack(table.column("three")[at].as_py(), np.uint64), order)
        # Ranges are in order of the hashes, so their answers in order are those to the sorted hashes.
        told = [unpack(table.column("one")[int(k)].as_py(), np.uint64) for k in first[1:]]
        counts = np.empty(sum(block.sums[1:]), np.uint64)
        counts[np.argsort(block.keys(bits))] = np.concatenate(told)
        found = Automaton(block, counts, total, distinct, strength, growth).score(block)
        columns = {"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": found["n_tokens"], "n_known": found["n_known"]}
        columns |= {"train_tokens": np.full(len(block.sizes), total, np.int64), "base_score": found["base_score"], "score": found["score"]}
        scored = pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v) for k, v in columns.items()})
        return pa.concat_tables([scored] * len(own))

    kind = docs.schema["doc_id"].dataType.simpleString()
    answered = checkpointed(rows.mapInArrow(asking, ROW).groupBy("dest").applyInArrow(lambda table: answer(table, start_key), ROW))
    total, distinct = (v or 0 for v in answered.agg(F.sum("tokens"), F.sum("words")).first())
    return answered.unionByName(rows.mapInArrow(packing, ROW)).groupBy("block").applyInArrow(
        scoring, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
