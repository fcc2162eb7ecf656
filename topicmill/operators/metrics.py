"""Clustering quality for many groups in one plan.

``points`` holds one row per vector and group: the key columns, ``paper_id``,
``embedding`` and ``label``. A group's few clusters are gathered to one array
that is joined to its points, so points are neither paired nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords_normal
from ..functions.vectors import distance2, dot, doubles, mean_vector, norm, normalized, sum_vector

NAN = float("nan")


def as_double(points: DataFrame) -> DataFrame:
    return points.withColumn("embedding", doubles(F.col("embedding")))


def centroids(points: DataFrame, keys: list[str]) -> DataFrame:
    """``centroid`` (mean), ``direction`` (mean over its length) and ``size`` of every cluster."""
    grouped = as_double(points).groupBy(*keys, "label").agg(mean_vector(F.col("embedding")).alias("centroid"), F.count("*").alias("size"))
    return grouped.withColumn("direction", normalized(F.col("centroid")))


def member_similarity(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with ``sim``, the product of a vector and its cluster's direction."""
    joined = as_double(points).join(centroids(points, keys).select(*keys, "label", "direction"), [*keys, "label"])
    return joined.withColumn("sim", dot(F.col("embedding"), F.col("direction"))).drop("direction")


def cohesion(similarities: DataFrame, keys: list[str]) -> DataFrame:
    return similarities.groupBy(*keys, "label").agg(F.coalesce(F.avg("sim"), F.lit(0.0)).alias("cohesion"), F.count("*").alias("size"))


def cohesion_summary(cohesions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and worst over clusters, each cluster counting once."""
    return cohesions.groupBy(*keys).agg(F.avg("cohesion").alias("avg_cohesion"), F.min("cohesion").alias("worst_cohesion"))


def _gathered(clusters: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    return clusters.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", *fields))).alias("clusters"))


def _joined(points: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return points.join(table, keys) if keys else points.crossJoin(table)  # one row without keys


def silhouette(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean cosine silhouette of each group, from cluster sums; NaN under two clusters or if all points are alone."""
    unit = as_double(points).select(*keys, "label", normalized(doubles(F.col("embedding"))).alias("_x"))
    sums = unit.groupBy(*keys, "label").agg(sum_vector(F.col("_x")).alias("_total"), F.count("*").alias("_n"))
    together = _joined(unit, _gathered(sums, keys, "_total", "_n"), keys)
    near = F.transform("clusters", lambda c: F.struct(c["label"].alias("label"), c["_n"].alias("n"), dot(F.col("_x"), c["_total"]).alias("d")))
    own = F.filter("_near", lambda c: c["label"] == F.col("label"))[0]
    others = F.transform(F.filter("_near", lambda c: c["label"] != F.col("label")), lambda c: 1 - c["d"] / c["n"])
    scored = together.select(*keys, "label", near.alias("_near")).select(*keys, own.alias("_own"), F.array_min(others).alias("_b"), F.size("_near").alias("_k"))
    a = (F.col("_own")["n"] - F.col("_own")["d"]) / (F.col("_own")["n"] - 1)
    valid = scored.withColumn("_a", F.when(F.col("_own")["n"] > 1, a))
    top = F.greatest("_a", "_b")
    s = F.when(F.col("_a").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("_b") - F.col("_a")) / top)
    return valid.groupBy(*keys).agg(F.when((F.first("_k") < 2) | (F.count("_a") == 0), F.lit(NAN)).otherwise(F.avg(F.coalesce(s, F.lit(0.0)))).alias("silhouette"))


def davies_bouldin(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over clusters of the worst (S_i + S_j) / M_ij, Euclidean; NaN under two clusters; a ratio over coincident centroids is 0."""
    middle = centroids(points, keys).select(*keys, "label", "centroid")
    apart = as_double(points).join(middle, [*keys, "label"]).groupBy(*keys, "label").agg(
        F.avg(F.sqrt(distance2(F.col("embedding"), F.col("centroid")))).alias("spread")
    )
    table = _gathered(middle.join(apart, [*keys, "label"]), keys, "centroid", "spread")

    def worst(c: Column) -> Column:
        def ratio(d: Column) -> Column:
            gap = F.sqrt(distance2(c["centroid"], d["centroid"]))
            return F.when(gap == 0, F.lit(0.0)).otherwise((c["spread"] + d["spread"]) / gap)

        return F.array_max(F.transform(F.filter("clusters", lambda d: d["label"] != c["label"]), ratio))

    total = F.aggregate(F.transform("clusters", worst), F.lit(0.0), lambda s, x: s + x)
    return table.select(*keys, F.when(F.size("clusters") < 2, F.lit(NAN)).otherwise(total / F.size("clusters")).alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame, keys: list[str]) -> DataFrame:
    """(B / (k - 1)) / (W / (n - k)); 1 if W is 0; NaN under two clusters or if k is n."""
    middle = centroids(points, keys).select(*keys, "label", "centroid", "size")
    within = as_double(points).join(middle, [*keys, "label"]).groupBy(*keys).agg(
        F.sum(distance2(F.col("embedding"), F.col("centroid"))).alias("w"), F.count("*").alias("n"), mean_vector(F.col("embedding")).alias("middle")
    )
    both = _joined(within, _gathered(middle, keys, "centroid", "size"), keys)
    between = F.aggregate("clusters", F.lit(0.0), lambda s, c: s + c["size"] * distance2(c["centroid"], F.col("middle")))
    k = F.size("clusters")
    score = F.when((k < 2) | (F.col("n") == k), F.lit(NAN)).when(F.col("w") == 0, F.lit(1.0)).otherwise((between / (k - 1)) / (F.col("w") / (F.col("n") - k)))
    return both.select(*keys, score.alias("calinski_harabasz"))


def keyword_entropy(papers: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy (natural logarithm) of each cluster's keywords; NaN for a cluster without any."""
    words = papers.select(*keys, "label", F.explode(keywords_normal(F.col("keywords"))).alias("keyword"))
    counts = words.groupBy(*keys, "label", "keyword").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys, "label").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    found = counts.join(totals, [*keys, "label"]).groupBy(*keys, "label").agg((-F.sum(p * F.log(p + F.lit(1e-12)))).alias("entropy"))
    clusters = papers.select(*keys, "label").distinct()
    return clusters.join(found, [*keys, "label"], "left").select(*keys, "label", F.coalesce("entropy", F.lit(NAN)).alias("entropy"))


def entropy_summary(entropies: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and largest over clusters, without NaN."""
    real = F.when(~F.isnan("entropy"), F.col("entropy"))
    return entropies.groupBy(*keys).agg(F.coalesce(F.avg(real), F.lit(NAN)).alias("avg_entropy"), F.coalesce(F.max(real), F.lit(NAN)).alias("max_entropy"))


#: Weights of the composite score; Calinski-Harabasz and the largest entropy are reported only.
WEIGHTS = {"silhouette": 1.5, "avg_cohesion": 2.0, "worst_cohesion": 1.0, "davies_bouldin": -0.7, "avg_entropy": -0.3}


def composite(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the metric columns; NaN and null count as 0."""
    out = F.lit(0.0)
    for name, w in (weights or WEIGHTS).items():
        out = out + F.lit(w) * F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))
    return out


def score_all(points: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics and ``score`` of each group; ``points`` also holds ``keywords``."""
    parts = [
        silhouette(points, keys), davies_bouldin(points, keys), calinski_harabasz(points, keys),
        cohesion_summary(cohesion(member_similarity(points, keys), keys), keys), entropy_summary(keyword_entropy(points, keys), keys),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys)
    return out.withColumn("score", composite())
