"""Full ranks by ranges; top-N and first-of-group by window, which Spark limits before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed, if_few


def full_ranks(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with the place of each in its group, from 0, as ``row_number`` over a window would count it.

    A window brings a whole group to one task. Here rows are put in ranges of
    (keys, order) by splitters that Spark samples, ``parts`` of them, so a large
    group lies in many; a row's place is its place in the partition plus what
    earlier partitions hold of the group. Groups of the null key count as one
    group; rows that tie in ``order`` come in any order. The sorted rows are
    written once, so that counts and places see the same partitions.
    """
    ranged = rows.repartitionByRange(*([parts] if parts else []), *keys, *order).sortWithinPartitions(*keys, *order)
    placed = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # A partition holds a group's rows side by side; most groups lie in one partition.
    spans = placed.groupBy(part.alias("_part"), *keys).agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_key{k}" for k in range(len(keys))]
    shifts = spans.select("_part", *[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    on = part == F.col("_part")
    for c, n in zip(keys, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    found = placed.join(if_few(checkpointed(shifts)), on)
    return found.withColumn(name, F.col("_at") + F.col("_shift")).select(*[c for c in rows.columns if c != name], name)


def member_rank(members: DataFrame, keys: list[str], sim: str = "sim", tie: str = "paper_id", parts: int | None = None) -> DataFrame:
    """Ranks from 0, the most similar member first; ties by ``tie``."""
    return full_ranks(members, keys, [F.desc(sim), F.col(tie)], "rank_in_cluster", parts)


def cluster_order(clusters: DataFrame, keys: list[str], size: str = "size", label: str = "label") -> DataFrame:
    """Position of each cluster, the largest first; ties by label."""
    w = Window.partitionBy(*keys).orderBy(F.desc(size), label) if keys else Window.orderBy(F.desc(size), label)
    return clusters.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def ranks_rise(ids: Column, ranks: Column) -> Column:
    """Whether the ranks of ``ids`` never fall; ``ranks`` is a map, and an unknown id ranks last."""
    found = F.transform(ids, lambda i: F.coalesce(F.try_element_at(ranks, i), F.lit(1_000_000_000)).cast("bigint"))
    return F.coalesce(found == F.array_sort(found), F.lit(True))
