"""K-means for many groups and candidates at once, grid search and choice of the best.

Spark ML's KMeans fits one data set per call; ``kmeans_groups`` runs Lloyd's
steps for every (group, k) in the same jobs. Only centers, k vectors a group,
move between steps; they are checkpointed, so a lost executor costs a few steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance2, mean_vector
from . import metrics
from .durable import checkpointed
from .ranking import first_of, top_n


def nearest(embedding: Column, centers: Column) -> Column:
    """Struct (d, label) of the nearest of ``centers`` (structs of label and centroid); ties to the least label."""
    return F.array_min(F.transform(centers, lambda c: F.struct(distance2(embedding, c["centroid"]).alias("d"), c["label"].alias("label"))))


def assign(points: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with ``label`` and squared distance ``d``; ``centers`` has an array ``centers`` for each group."""
    found = points.join(centers, keys).withColumn("_near", nearest(F.col("embedding"), F.col("centers")))
    return found.withColumn("label", F.col("_near")["label"]).withColumn("d", F.col("_near")["d"]).drop("_near", "centers")


def candidates(points: DataFrame, keys: list[str], k: int, passes: int = 3, seed: int = 42) -> DataFrame:
    """Starting candidates of each group by oversampling: an array ``candidates`` of structs (label, centroid), and the group's size ``n``.

    The first candidate is the point of the least hash. Each of ``passes`` passes
    adds 2 k points, drawn with chances that grow with their squared distance d to
    the nearest candidate: those of the least -ln(u) / d, for u from a hash of
    the point and the pass. So a group has 2 k ``passes`` + 1 candidates at most,
    in few passes whatever k is, and the draw does not depend on partitions.
    """
    start = points.groupBy(*keys).agg(F.min_by("embedding", F.struct(F.xxhash64("paper_id", F.lit(seed)), "paper_id")).alias("c"), F.count("*").alias("n"))
    found = checkpointed(start.select(*keys, "n", F.array(F.struct(F.lit(0).alias("label"), F.col("c").alias("centroid"))).alias("candidates")))
    for turn in range(passes):
        far = points.join(found, keys).withColumn("_d", nearest(F.col("embedding"), F.col("candidates"))["d"]).where("_d > 0")
        drawn = top_n(far.select(*keys, "paper_id", "embedding", (-F.log(uniform(seed + 1 + turn)) / F.col("_d")).alias("_key")), keys, 2 * k, "_key", "paper_id")
        more = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_key", "paper_id", "embedding"))).alias("_more"))
        joined = found.join(more, keys, "left")
        new = F.transform(F.coalesce("_more", F.array().cast(more.schema["_more"].dataType)), lambda x, i: F.struct((F.size("candidates") + i).alias("label"), x["embedding"].alias("centroid")))
        found = checkpointed(joined.select(*keys, "n", F.concat("candidates", new).alias("candidates")))
    return found


def uniform(seed: int) -> Column:
    """A number in (0, 1) from the hash of ``paper_id``."""
    return (F.pmod(F.xxhash64("paper_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def weighted_centers(vectors: np.ndarray, weights: np.ndarray, k: int, steps: int = 20) -> np.ndarray:
    """``k`` centers of weighted candidates: the heaviest first, then always that of the greatest weight times squared distance; then Lloyd's steps.

    With fewer distinct candidates than ``k`` the last are repeated.
    """
    chosen = [int(np.argmax(weights))]
    near = np.square(vectors - vectors[chosen[0]]).sum(axis=1)
    for _ in range(1, k):
        chosen.append(int(np.argmax(weights * near)))
        near = np.minimum(near, np.square(vectors - vectors[chosen[-1]]).sum(axis=1))
    centers = vectors[chosen]
    for _ in range(steps):
        label = np.square(vectors[:, None] - centers[None]).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(vectors[own], axis=0, weights=weights[own]) if (own := (label == j) & (weights > 0)).any() else centers[j] for j in range(k)])
        if np.array_equal(new, centers):
            break
        centers = new
    return centers


def first_centers(points: DataFrame, keys: list[str], ks: list[int], seed: int = 42) -> DataFrame:
    """Starting ``centers`` (structs of label and centroid) of each group and ``k``: its candidates, weighted by the points nearest to each, clustered again.

    The candidates of a group are few (see ``candidates``), whatever its size; a task takes them together.
    """
    found = candidates(points, keys, max(ks), seed=seed)
    near = points.join(found, keys).select(*keys, nearest(F.col("embedding"), F.col("candidates"))["label"].alias("label"))
    counts = near.groupBy(*keys, "label").agg(F.count("*").alias("weight"))
    flat = found.select(*keys, F.inline("candidates")).join(counts, [*keys, "label"], "left").select(*keys, "label", "centroid", F.coalesce("weight", F.lit(0)).alias("weight"))

    def cluster(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("label")
        vectors, weights = np.stack(own["centroid"].to_list()).astype(float), own["weight"].to_numpy(float)
        rows = [(k, [{"label": j, "centroid": c.tolist()} for j, c in enumerate(weighted_centers(vectors, weights, k))]) for k in ks]
        out = pd.DataFrame(rows, columns=["k", "centers"])
        for c in keys:
            out[c] = own[c].iloc[0]
        return out[[*keys, "k", "centers"]]

    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keys)
    return flat.groupBy(*keys).applyInPandas(cluster, f"{kinds}, k int, centers array<struct<label:int,centroid:array<double>>>")


def kmeans_groups(points: DataFrame, keys: list[str], ks: list[int], seed: int = 42, max_iter: int = 300, tol: float = 1e-4, together: int = 4) -> DataFrame:
    """Labels for every group and k: ``points`` (keys, ``paper_id``, ``embedding``) with ``k``, ``label``, ``d``.

    An empty cluster keeps its center. A group with fewer points than k is an
    error that names it. Same input, same labels, whatever the partitions. Up to
    ``together`` steps are one job that ends in a checkpoint of the centers; the
    run ends when the last step of a job moves them by ``tol`` at most.
    """
    # Dealt evenly once, for the many passes over them: a small or skewed input would leave most tasks idle.
    spark = points.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = metrics.as_double(points).repartition(tasks, "paper_id").persist()
    try:
        sizes = own.groupBy(*keys).agg(F.count("*").alias("n"))
        small = sizes.where(F.col("n") < max(ks)).select(*keys).limit(1).collect()
        if small:
            raise ValueError(f"k = {max(ks)} exceeds the points of group {small[0].asDict()}")
        centers = checkpointed(first_centers(own, keys, ks, seed))
        groups = [*keys, "k"]
        done = 0
        while done < max_iter:
            step = centers
            for _ in range(min(together, max_iter - done)):
                step = moved(own, step, keys)
                done += 1
            centers = checkpointed(step)
            if (centers.agg(F.max("shift")).first()[0] or 0.0) <= tol:
                break
        # Written once: its metrics and members are read from there several times.
        return checkpointed(assign(own, centers.select(*groups, "centers"), keys))
    finally:
        own.unpersist()


def moved(points: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """``centers`` after one of Lloyd's steps, and their squared ``shift``. The old ones travel with the sums, so that several steps are one chain."""
    groups = [*keys, "k"]
    found = points.join(centers.select(*groups, "centers"), keys).withColumn("label", nearest(F.col("embedding"), F.col("centers"))["label"])
    means = found.groupBy(*groups, "label").agg(mean_vector(F.col("embedding")).alias("new"), F.first("centers").alias("centers"))
    both = means.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("label", "new"))).alias("_means"), F.first("centers").alias("centers"))
    after = F.transform("centers", lambda c: F.struct(c["label"].alias("label"), F.coalesce(F.try_element_at("_means", c["label"]), c["centroid"]).alias("centroid")))
    shift = F.aggregate(F.zip_with("centers", "_after", lambda a, b: distance2(a["centroid"], b["centroid"])), F.lit(0.0), lambda s, x: s + x)
    return both.withColumn("_after", after).select(*groups, F.col("_after").alias("centers"), shift.alias("shift"))


def spark_kmeans(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """One large data set: Spark ML's KMeans; ``points`` with ``label``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    given = points.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="label", distanceMeasure="euclidean").fit(given)
    return model.transform(given).drop("_v")


def grid_search(points: DataFrame, keys: list[str], ks: list[int], **settings) -> tuple[DataFrame, DataFrame]:
    """Labelled candidates, and one scored row for each; modes are among ``keys``. ``points`` holds ``keywords`` too."""
    labelled = kmeans_groups(points, keys, ks, **settings)
    return labelled, metrics.score_all(labelled, [*keys, "k"])


def best_config(scores: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The best row of each period: highest score, then grid order."""
    return first_of(scores, keys, F.desc("score"), *order)


def best_clustering(labelled: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """The winner's members with similarities: the candidate's rows are kept, nothing is fitted again."""
    return metrics.member_similarity(labelled.join(best.select(*keys), keys, "left_semi"), keys)
