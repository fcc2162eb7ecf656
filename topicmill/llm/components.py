"""Connected components of a link table, by contraction in partitions and alternating stars between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links that a task holds at once while it contracts them.
MOST = 1 << 20


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least node it sees."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the least node that each reaches by them, but for nodes that are the least themselves."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        if (low == high).all():
            break
        np.minimum.at(least, high, low)
        while (least[least] != least).any():
            least = least[least]
    hung = least != np.arange(len(nodes))
    return nodes[hung], nodes[least[hung]]


def contracted(links: DataFrame) -> DataFrame:
    """The links with those of each ``MOST`` of a task replaced by stars around the least nodes: the same components, no more links."""

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        own = forest(*(np.concatenate(ends) for ends in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(ends) for ends in own], ["a", "b"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            n += batch.num_rows
            if n >= MOST:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    return links.mapInArrow(contract, "a long, b long")


def roots(links: DataFrame, rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``node`` and ``root``, the least node that it reaches, for every node of ``links`` (a, b) but the roots.

    Each round is one distributed pass over the links and ends in a checkpoint;
    rounds grow with the logarithm of the longest path. They end when all links
    are stars, which one row at most tells the driver. What each task's contraction
    leaves is counted first: ``MOST`` links or fewer are one task's and need no round.
    ``keep`` writes what is read again. No links, no rows.
    """
    turned = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ordered = lambda df: turned(df).distinct()
    links = keep(contracted(turned(links)))
    if links.count() <= MOST:
        return keep(contracted(links.coalesce(1))).select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(links.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        if ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = keep(contracted(ordered(_small_star(ordered(_large_star(links))))))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
