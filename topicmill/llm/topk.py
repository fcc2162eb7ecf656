"""Exact inner-product search: ball trees over shards of vectors, branch and bound, the k-th score shared.

Vectors are dealt to shards, shards to groups, and a task holds one group at a
time. It builds a ball tree for each shard, then takes queries in blocks. For a
block, one heap holds nodes of all trees of the group, the one with the highest
bound q.c + |q| r first; a node is opened for those queries of the block whose
bound still reaches their k-th score, which all trees share. Between groups it
is shared by two passes: each query is first searched in one group, and takes
the k-th score found there to all others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored

#: Bytes of a shard's vectors as doubles, shards of a group at most, vectors of a leaf, queries of a block.
SHARD, GROUP, LEAF, BLOCK = 1 << 21, 32, 128, 256
LAST = np.iinfo(np.int64).max


class Tree:
    """A balanced ball tree: nodes 1 to 2 * leaves - 1, the children of node i are 2 i and 2 i + 1.

    ``vectors`` (whole numbers), ``ids`` and ``rows`` lie in the order of the leaves.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        n = len(vectors)
        self.leaves = 1 << max(0, (max(1, n) - 1) // LEAF).bit_length()
        order = np.arange(n)
        self.begin, self.end = np.zeros(2 * self.leaves, np.int64), np.zeros(2 * self.leaves, np.int64)
        self.centers, self.radii = np.zeros((2 * self.leaves, vectors.shape[1])), np.zeros(2 * self.leaves)
        self.least = np.full(2 * self.leaves, LAST)
        self.end[1] = n
        for node in range(1, 2 * self.leaves):
            begin, end = self.begin[node], self.end[node]
            own = vectors[order[begin:end]]
            if len(own):
                center = own.mean(axis=0)
                away = np.square(own - center).sum(axis=1)
                self.centers[node], self.radii[node] = center, np.sqrt(away.max())
                self.least[node] = ids[order[begin:end]].min()
            if node < self.leaves:
                middle = (begin + end) // 2
                if len(own) > 1:
                    # Along the line from one far vector to the one farthest from it.
                    start = own[away.argmax()]
                    stop = own[np.square(own - start).sum(axis=1).argmax()]
                    order[begin:end] = order[begin:end][np.argpartition(own @ (stop - start), middle - begin)]
                self.begin[2 * node], self.end[2 * node], self.begin[2 * node + 1], self.end[2 * node + 1] = begin, middle, middle, end
        self.vectors, self.ids, self.rows = vectors[order], ids[order], rows[order]
        self.lengths = np.sqrt(np.square(self.centers).sum(axis=1))
        # An ample margin for rounding, of whole inner products too large for doubles as well.
        self.margin = 1e-9 * (self.lengths + self.radii)


class Block:
    """Queries with their best so far, and the least (score, id) that still counts."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, k: int):
        self.vectors, self.rows, self.k = vectors, rows, k
        self.norms = np.sqrt(np.square(vectors).sum(axis=1))
        self.floor, self.floor_id = floor.copy(), floor_id.copy()
        self.who, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, floor.dtype), np.zeros(0, np.int64)

    def live(self, bound: np.ndarray, least: int, who: np.ndarray) -> np.ndarray:
        """Whether a node of that bound and least id may still hold one of the best."""
        floor = self.floor[who].astype(np.float64)
        return (bound > floor) | (bound == floor) & (least < self.floor_id[who])

    def offer(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take scored vectors in, keep the best ``k`` of each query and raise the floors."""
        touched = np.isin(self.who, who)
        who, score, ids = np.r_[self.who[touched], who], np.r_[self.score[touched], score], np.r_[self.id[touched], ids]
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        begins = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        place = np.arange(len(who)) - np.repeat(begins, np.diff(np.r_[begins, len(who)]))
        kept, last = place < self.k, place == self.k - 1
        higher = (score[last] > self.floor[who[last]]) | (score[last] == self.floor[who[last]]) & (ids[last] < self.floor_id[who[last]])
        at = who[last][higher]
        self.floor[at], self.floor_id[at] = score[last][higher], ids[last][higher]
        self.who, self.score, self.id = np.r_[self.who[~touched], who[kept]], np.r_[self.score[~touched], score[kept]], np.r_[self.id[~touched], ids[kept]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products: exact in doubles while they stay under 2**53, else in Python's integers; an error beyond a long."""
    most = np.sqrt(np.square(a).sum(axis=1).max(initial=0)) * np.sqrt(np.square(b).sum(axis=1).max(initial=0))
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return exact.astype(np.int64)


def branch_and_bound(trees: list[Tree], block: Block) -> None:
    """Search ``block`` in all ``trees`` of its dimension."""
    heap, everyone, n = [], np.arange(len(block.rows)), 0

    def push(tree: Tree, node: int, who: np.ndarray) -> None:
        nonlocal n
        if tree.end[node] == tree.begin[node]:
            return
        bound = block.vectors[who] @ tree.centers[node] + block.norms[who] * tree.radii[node]
        bound = np.floor(bound + block.norms[who] * tree.margin[node] + 1e-6)
        alive = block.live(bound, tree.least[node], who)
        if alive.any():
            n += 1
            heapq.heappush(heap, (-bound[alive].max(), n, tree, node, who[alive], bound[alive]))

    for tree in trees:
        push(tree, 1, everyone)
    while heap:
        _, _, tree, node, who, bound = heapq.heappop(heap)
        who = who[block.live(bound, tree.least[node], who)]
        if not len(who):
            continue
        if node < tree.leaves:
            push(tree, 2 * node, who)
            push(tree, 2 * node + 1, who)
            continue
        at = slice(tree.begin[node], tree.end[node])
        score = products(block.vectors[who], tree.vectors[at])
        floor, ids = block.floor[who][:, None], tree.ids[at][None, :]
        good = (score > floor) | (score == floor) & (ids < block.floor_id[who][:, None])
        good &= tree.rows[at][None, :] != block.rows[who][:, None]
        query, column = np.nonzero(good)
        if len(query):
            block.offer(who[query], score[query, column], tree.ids[at][column])


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """``row`` (a number of its own), ``vec_id``, ``dims`` and ``v``, floor(scale * x) of each component, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = vectors.select("vec_id", x.alias("embedding")).where("embedding IS NOT NULL").where(~bad)
    # Kept as doubles: a floor of any size is one.
    floors = F.transform("embedding", lambda c: F.when(F.abs(c) < 2.0**40, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return stored(own.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), floors.alias("v")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` highest inner products of each query.

    Queries are the rows where ``is_query``, a condition on ``vec_id``, holds; a
    query meets every row of its own dimension but itself, other rows of its id
    too. Equal scores rank by ``vec_id``, null last. Vectors that are null or hold
    a null or non-finite component take no part. Scores beyond a long are an
    error. Empty tables give no rows; other columns are not read.
    """
    rows = whole(vectors, scale)
    counts = rows.groupBy("dims").agg(F.count("*").alias("count"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("count") * F.greatest(F.lit(8), F.col("dims") * 8) / F.lit(shard))).cast("long")
    sized = counts.select("dims", shards.alias("shards")).withColumn("each", F.least(F.lit(group), F.greatest(F.lit(1), (F.col("shards") / 64).cast("int"))))
    sized = checkpointed(sized.select("dims", "shards", "each", F.ceil(F.col("shards") / F.col("each")).alias("groups")))
    total = sized.agg(F.sum("groups")).first()[0] or 1
    own = F.pmod(F.xxhash64("row"), F.col("shards"))
    dealt = rows.join(F.broadcast(sized), "dims")  # one row a dimension
    spots = dealt.select("dims", (own / F.col("each")).cast("long").alias("group"), F.lit(0).alias("kind"), own.alias("part"), "row", "vec_id", "v", F.lit(None).cast("long").alias("floor"), F.lit(None).cast("long").alias("floor_id"))
    asked = dealt.where(is_query).select("dims", "groups", "row", "vec_id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.col("groups")).alias("home"))
    questions = lambda q, floor, floor_id: q.select("dims", "group", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("part"), "row", "vec_id", "v", floor.alias("floor"), floor_id.alias("floor_id"))
    none = F.lit(None).cast("long")
    near = checkpointed(searched(spots.union(questions(asked.withColumn("group", F.col("home")), none, none)), total, k))
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    kth = near.withColumn("at", F.row_number().over(place)).where(F.col("at") == k).select(F.col("query").alias("row"), F.col("score").alias("_floor"), F.coalesce("vec_id", F.lit(int(LAST))).alias("_id"))
    others = asked.where("groups > 1").join(kth, "row", "left").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).where(F.col("group") != F.col("home"))
    found = near
    if total > 1:
        found = near.union(searched(spots.union(questions(others, F.col("_floor"), F.col("_id"))), total, k))
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def searched(given: DataFrame, groups: int, k: int) -> DataFrame:
    """``query`` (its row), ``query_id``, ``vec_id`` and ``score``: the best of each query in each group that it was sent to.

    ``given`` holds vectors (kind 0) and queries (kind 1). They meet by group; a
    task sees a group's vectors first, and keeps no more than one group and one block.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[Tree] = []
        held: list[tuple] = []  # of one shard, or of one block
        spot = None

        def flush() -> pa.RecordBatch | None:
            nonlocal held
            if not held:
                return None
            v, row, ids, null, floor, floor_id = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            if spot[2] == 0:
                trees.append(Tree(v, np.where(null, LAST, ids), row))
                return None
            block = Block(v, row, floor, floor_id, k)
            branch_and_bound(trees, block)
            back = pa.array(block.id, mask=block.id == LAST)
            return pa.RecordBatch.from_arrays([pa.array(row[block.who]), pa.array(ids[block.who], mask=null[block.who]), back, pa.array(block.score)], ["query", "query_id", "vec_id", "score"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3)], axis=1).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for begin, stop in zip(edges, np.r_[edges[1:], len(key)], strict=True):
                now = tuple(key[begin])
                if now != spot:
                    if (out := flush()) is not None:
                        yield out
                    if spot is None or now[:2] != spot[:2]:
                        trees.clear()
                    spot = now
                for at in range(begin, stop, BLOCK if now[2] else stop):
                    part = batch.slice(at, min(BLOCK, stop - at) if now[2] else stop - at)
                    id_column = part.column(5)
                    held.append((
                        part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(part), now[0]), part.column(4).to_numpy(), id_column.fill_null(0).to_numpy(), id_column.is_null().to_numpy(zero_copy_only=False),
                        part.column(7).fill_null(np.iinfo(np.int64).min).to_numpy(), part.column(8).fill_null(int(LAST)).to_numpy(),
                    ))
                    if now[2] and sum(len(x[1]) for x in held) >= BLOCK and (out := flush()) is not None:
                        yield out
        if (out := flush()) is not None:
            yield out

    keys = ["dims", "group", "kind", "part"]
    order = [*keys, "row", "vec_id", "v", "floor", "floor_id"]
    placed = given.select(*order).repartition(int(max(1, groups)), "dims", "group").sortWithinPartitions(*keys)
    return placed.mapInArrow(meet, "query long, query_id long, vec_id long, score long")
