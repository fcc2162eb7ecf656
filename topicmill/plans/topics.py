"""Topics over time: matching, novelty, drift, statistics, selection rules and keyword hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords_normal
from ..functions.vectors import distance2, dot
from ..operators.durable import checkpointed
from ..operators.ranking import first_of, full_ranks, top_n


def topic_index(topics: DataFrame, pivots: int = 16, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Pivots and blocks of the topics of each ``embed_config_id``.

    ``pivots`` topics of a config, the least by hash, are its pivots; every topic
    goes to the nearest. Pivots: a row a config with ``pivots``, structs of
    ``pivot``, ``at``, ``radius`` (the farthest topic), ``most`` (the greatest
    squared length) and ``blocks``. Blocks: the topics of a pivot in arrays of
    some ``block``, dealt by hash.
    """
    chosen = top_n(topics.select("embed_config_id", "topic_id", "direction"), ["embed_config_id"], pivots, F.xxhash64("topic_id"), "topic_id")
    places = checkpointed(chosen.groupBy("embed_config_id").agg(F.array_sort(F.collect_list(F.struct("topic_id", "direction"))).alias("_at")))
    nearest = F.array_min(F.transform("_at", lambda p, i: F.struct(distance2(F.col("direction"), p["direction"]).alias("d"), i.alias("pivot"))))
    placed = topics.join(places, "embed_config_id").withColumn("_near", nearest)
    placed = checkpointed(placed.select("embed_config_id", "topic_id", "direction", "depth", F.col("_near.pivot").alias("pivot"), F.sqrt("_near.d").alias("_d"), dot(F.col("direction"), F.col("direction")).alias("_n2")))
    sizes = placed.groupBy("embed_config_id", "pivot").agg(F.max("_d").alias("radius"), F.max("_n2").alias("most"), F.ceil(F.count("*") / block).alias("blocks"))
    known = sizes.join(places, "embed_config_id").select("embed_config_id", F.struct("pivot", F.col("_at")[F.col("pivot")]["direction"].alias("at"), "radius", "most", "blocks").alias("p"))
    heads = checkpointed(known.groupBy("embed_config_id").agg(F.array_sort(F.collect_list("p")).alias("pivots")))
    dealt = placed.join(sizes.select("embed_config_id", "pivot", "blocks"), ["embed_config_id", "pivot"]).withColumn("block", F.pmod(F.xxhash64("topic_id"), F.col("blocks")))
    packed = dealt.groupBy("embed_config_id", "pivot", "block").agg(F.collect_list(F.struct("topic_id", "direction", "depth")).alias("topics"))
    return heads, checkpointed(packed)


def nearest_topics(clusters: DataFrame, topics: DataFrame, **settings: int) -> DataFrame:
    """``cluster_id``, ``best`` (score, topic_id, depth; null without topics) and ``scored``, the topics it was compared with.

    The highest inner product, exactly, ties to the greatest id. A cluster is
    first compared with the topics of its nearest pivot. By the triangle
    inequality a topic of another is no nearer than the cluster's distance to
    that pivot less its radius, which bounds the product; only pivots whose
    bound reaches the score so far are opened. Pairs meet by config, pivot and
    block, so neither a large config nor a large pivot is one key.
    """
    heads, blocks = topic_index(topics, **settings)
    q2 = dot(F.col("direction"), F.col("direction"))

    def judged(p: Column) -> Column:
        gap = F.sqrt(distance2(F.col("direction"), p["at"]))
        bound = (q2 + p["most"] - F.pow(F.greatest(F.lit(0.0), gap - p["radius"]), F.lit(2.0))) / 2
        return F.struct(gap.alias("gap"), p["pivot"].alias("pivot"), bound.alias("bound"), p["blocks"].alias("blocks"))

    asked = checkpointed(clusters.join(heads, "embed_config_id").select("cluster_id", "embed_config_id", "direction", F.array_sort(F.transform("pivots", judged)).alias("pivots")))
    best = F.array_max(F.transform("topics", lambda t: F.struct(dot(F.col("direction"), t["direction"]).alias("score"), t["topic_id"].alias("topic_id"), t["depth"].alias("depth"))))

    def compared(rows: DataFrame) -> DataFrame:
        opened = rows.select("cluster_id", "embed_config_id", "direction", "p.pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p.blocks") - 1)).alias("block"))
        met = opened.join(blocks, ["embed_config_id", "pivot", "block"]).select("cluster_id", "embed_config_id", best.alias("best"), F.size("topics").alias("scored"))
        return met.groupBy("cluster_id", "embed_config_id").agg(F.max("best").alias("best"), F.sum("scored").alias("scored"))

    home = checkpointed(compared(asked.withColumn("p", F.col("pivots")[0])))
    rest = asked.join(home.select("cluster_id", "embed_config_id", F.col("best.score").alias("_least")), ["cluster_id", "embed_config_id"])
    rest = rest.withColumn("p", F.explode(F.slice("pivots", F.lit(2), F.size("pivots")))).where(F.col("p.bound") + 1e-9 >= F.col("_least"))
    found = home.union(compared(rest)).groupBy("cluster_id").agg(F.max("best").alias("best"), F.sum("scored").alias("scored"))
    return clusters.select("cluster_id").distinct().join(found, "cluster_id", "left").select("cluster_id", "best", F.coalesce("scored", F.lit(0)).alias("scored"))


def match_topics(clusters: DataFrame, topics: DataFrame, threshold: float, **settings: int) -> DataFrame:
    """The nearest stored topic of each cluster under one ``embed_config_id``; attached at ``threshold`` or more, else new.

    ``clusters``: ``cluster_id``, ``embed_config_id``, ``direction``; ``topics``: ``topic_id``, ``embed_config_id``, ``direction``, ``depth``.
    """
    top = nearest_topics(clusters, topics, **settings)
    near = F.coalesce(F.col("best.score") >= threshold, F.lit(False))
    return top.select(
        "cluster_id", F.when(near, F.lit("attach")).otherwise(F.lit("new")).alias("decision"), F.when(near, F.col("best.topic_id")).alias("topic_id"),
        F.col("best.score").alias("match_score"), F.when(near, F.col("best.depth") + 1).otherwise(F.lit(0)).alias("depth"),
    )


def novelty(members: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Distance to the own centroid, and its rank, the farthest first."""
    far = members.withColumn("novelty", 1 - F.col("sim"))
    return full_ranks(far, [*keys, "label"], ["sim", "paper_id"], "novelty_rank", parts)


def period_sizes(members: DataFrame, period: str) -> DataFrame:
    sizes = members.groupBy(period, "label").agg(F.count("*").alias("size"))
    return sizes.groupBy(period).agg(F.count("*").alias("n_clusters"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.avg("size").alias("mean_size"))


def drift(centroids: DataFrame, period: str) -> DataFrame:
    """For each cluster the most similar one of the period before. ``period`` is an integer that counts up."""
    before = centroids.groupBy((F.col(period) + 1).alias(period)).agg(F.collect_list(F.struct("label", "direction")).alias("_before"))
    best = F.array_max(F.transform("_before", lambda c: F.struct(dot(F.col("direction"), c["direction"]).alias("similarity"), c["label"].alias("label"))))
    return centroids.join(before, period).withColumn("_best", best).select(
        period, "label", F.col("_best.label").alias("previous_label"), F.col("_best.similarity").alias("similarity"), (1 - F.col("_best.similarity")).alias("drift")
    )


def topic_statistics(links: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports of each topic and role, with the first and last period."""
    return links.join(reports, "report_id").groupBy("topic_id", "role").agg(
        F.count("*").alias("n_reports"), F.min("period_start").alias("first_period"), F.max("period_end").alias("last_period")
    )


def board(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Mean scores and failure rates for each combination of ``keys`` and their subtotals."""
    return judged.rollup(*keys).agg(
        F.avg("overall").alias("mean_overall"), F.avg((~F.col("parsed")).cast("double")).alias("parse_failures"), F.avg((~F.col("hard_valid")).cast("double")).alias("hard_failures"), F.count("*").alias("n")
    )


def unique_tags(tags: DataFrame, keys: list[str]) -> DataFrame:
    """The share of a group's tags that only one cluster has."""
    words = tags.select(*keys, "label", F.explode(keywords_normal(F.col("keywords"))).alias("tag")).distinct()
    seen = words.groupBy(*keys, "tag").agg(F.count("*").alias("n"))
    return seen.groupBy(*keys).agg(F.avg((F.col("n") == 1).cast("double")).alias("unique_share"), F.count("*").alias("n_tags"))


def constrained_best(scores: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """The best mean cohesion among candidates whose worst cohesion reaches ``floor``; ties by silhouette, then Davies-Bouldin."""
    return first_of(scores.where(F.col("worst_cohesion") >= floor), keys, F.desc("avg_cohesion"), F.desc("silhouette"), "davies_bouldin")


def keyword_hints(papers: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The keywords of each cluster with the highest tf-idf, clusters being the documents."""
    words = papers.select(*keys, "label", F.explode(keywords_normal(F.col("keywords"))).alias("keyword"))
    tf = words.groupBy(*keys, "label", "keyword").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*keys, "keyword").agg(F.count("*").alias("df"))
    total = papers.groupBy(*keys).agg(F.countDistinct("label").alias("n"))
    joined = tf.join(df, [*keys, "keyword"])
    joined = joined.join(total, keys) if keys else joined.crossJoin(total)  # total has one row without keys
    scored = joined.withColumn("tfidf", F.col("tf") * F.log((1 + F.col("n")) / (1 + F.col("df"))) + F.col("tf"))
    return top_n(scored, [*keys, "label"], n, F.desc("tfidf"), "keyword").select(*keys, "label", "keyword", "tf", "df", "tfidf")


def rubric(scores: DataFrame, weights: dict[str, float], gates: list[str]) -> DataFrame:
    """Weighted score of the rubric's columns; 0 unless all gates hold."""
    total = sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    shut = F.lit(False)
    for g in gates:
        shut = shut | ~F.coalesce(F.col(g), F.lit(False))
    return scores.withColumn("rubric", F.when(shut, F.lit(0.0)).otherwise(total))


def markdown_cards(clusters: DataFrame) -> DataFrame:
    """A Markdown card of each packed cluster: ``label``, ``title``, ``size``, ``cohesion``, ``papers`` (id and title)."""
    items = F.array_join(F.transform("papers", lambda p: F.concat(F.lit("- ["), p["paper_id"], F.lit("] "), p["title"])), "\n")
    head = F.concat(F.lit("## "), F.col("title"), F.lit("\n\ncluster "), F.col("label").cast("string"), F.lit(", "), F.col("size").cast("string"), F.lit(" papers, cohesion "), F.format_number("cohesion", 3))
    return clusters.select("label", F.concat(head, F.lit("\n\n"), items, F.lit("\n")).alias("card"))
