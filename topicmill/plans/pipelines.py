"""Whole runs as lazy plans: monthly clustering, best runs, and the two evaluations."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clustering, judging, packing
from ..operators.ranking import member_rank, top_n
from ..sources.sinks import report_lines, text_report, write_run


def hashed_vectors(texts: DataFrame, column: str = "text", dims: int = 256) -> DataFrame:
    """The default encoder: hashed term counts of unit length, as ``embedding``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol=column, outputCol="_terms", pattern=T.PLAIN_WORD, gaps=False),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=dims),
        Normalizer(inputCol="_counts", outputCol="_unit", p=2.0),
    ]
    filled = texts.withColumn(column, F.coalesce(F.col(column), F.lit("")))
    encoded = Pipeline(stages=stages).fit(filled).transform(filled)
    return encoded.withColumn("embedding", vector_to_array("_unit").cast("array<float>")).drop("_terms", "_counts", "_unit")


def encode_papers(papers: DataFrame, modes: list[str], top_n: int = 10, encoder=hashed_vectors) -> DataFrame:
    """``papers`` for each text mode, with ``embedding``. An encoder maps a DataFrame with ``text`` to one with ``embedding``."""
    text = F.array(*[F.struct(F.lit(m).alias("mode"), T.embedding_text(F.col("title"), F.col("summary"), F.col("keywords"), m, top_n).alias("text")) for m in modes])
    return encoder(papers.select("*", F.inline(text))).drop("text")


def run_monthly(papers: DataFrame, period: str = "month_key", modes=("B", "C"), ks=(4, 5), encoder=hashed_vectors, **settings) -> dict[str, DataFrame]:
    """Scores of all candidates, the best of each period, its ranked members, text reports (as lines, too) and payloads.

    ``papers``: the period, ``paper_id``, ``title``, ``summary``, ``keywords``, ``url``, ``published_at``.
    """
    vectors = encode_papers(papers, list(modes), encoder=encoder)
    labelled, scores = clustering.grid_search(vectors, [period, "mode"], list(ks), **settings)
    best = clustering.best_config(scores, [period], "mode", "k")
    keys = [period, "mode", "k"]
    members = member_rank(clustering.best_clustering(labelled, best, keys), [*keys, "label"])
    return {"scores": scores, "best": best, "members": members, "reports": text_report(members, keys), "report_lines": report_lines(members, keys), "payloads": packing.payload(members, keys)}


def monthly_payload(members: DataFrame, period: str = "month_key", source: str = "hf", encoder: str = "hashed", version: str = "0.1") -> dict[str, DataFrame]:
    """The members of ``run_monthly`` as flat payloads, ready for ``memory.ingest``: one for each period, its text mode and k in the configurations' ids."""
    start, end = T.period_bounds(F.col(period))
    identity = T.piped(F.col(period), F.col("mode"), F.col("k").cast("string"))
    chosen = members.select(period, "mode", "k").distinct()
    embed = T.piped(F.lit(encoder), F.col("mode"), F.lit(version))
    cluster = T.piped(F.lit("kmeans"), F.col("k").cast("string"), F.lit(version))
    headers = chosen.select(
        identity.alias("payload_id"), F.lit(source).alias("source"), start.alias("period_start"), end.alias("period_end"),
        embed.alias("embed_config_id"), F.to_json(F.struct("mode")).alias("embed_json"), cluster.alias("cluster_config_id"), F.to_json(F.struct("k")).alias("cluster_json"),
    )
    return packing.flat_payload(members.withColumn("payload_id", identity), headers)


def prompts(packed: DataFrame, template: str, expected_output: int = 512) -> DataFrame:
    """``packed`` with ``prompt``, ``template_hash`` and ``tokens``."""
    rows = packed.withColumn("prompt", T.prompt(template, CLUSTER_JSON=F.to_json(F.struct("papers"))))
    return rows.withColumn("template_hash", T.template_hash(F.lit(template))).withColumn("tokens", T.token_estimate(F.col("prompt"), expected_output))


def evaluate(packed: DataFrame, responses: DataFrame, keys: list[str], dry_run: bool = False, template: str = "{{CLUSTER_JSON}}") -> dict[str, DataFrame]:
    """Prompts; unless ``dry_run``, judgements of ``responses`` (keys, ``run_id``, ``model``, ``cluster_index``, ``raw_text``) and the board."""
    asked = prompts(packed, template)
    if dry_run:
        return {"prompts": asked}
    ids = asked.select(*keys, "cluster_index", F.transform("papers", lambda p: p["paper_id"]).alias("input_ids"))
    judged = judging.judge(responses.join(ids, [*keys, "cluster_index"]))
    board = judging.leaderboard(judged, ["run_id", "model"])
    return {"prompts": asked, "judged": judged, "leaderboard": board, "summary": judging.run_summary(board, ["run_id"])}


def write_evaluation(packed: DataFrame, responses: DataFrame, runs: DataFrame, keys: list[str], path: str) -> dict:
    """Run an evaluation to its end: judgements written by run, the summary of each run made from what was written.

    Returns ``counts`` that Spark observed while the judgements were written
    (``n``, ``parsed``, ``hard_valid``, ``failed`` calls), the ``seconds`` of each
    step, and the written ``judged`` and ``summary``. A run that is evaluated
    again replaces its own partition.
    """
    began = time.monotonic()
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in (("parsed", F.col("parsed")), ("hard_valid", F.col("hard_valid")), ("failed", F.col("raw_text").isNull()))]]
    write_run({"judged": evaluate(packed, responses, keys)["judged"].observe(seen, *counts)}, path)
    spark, judged_at = packed.sparkSession, time.monotonic()
    asked = runs.select("run_id").distinct()
    judged = spark.read.parquet(f"{path}/judged").join(asked, "run_id", "left_semi")
    write_run({"summary": judging.full_summary(judged, runs)}, path)
    summary = spark.read.parquet(f"{path}/summary").join(asked, "run_id", "left_semi")
    return {"counts": seen.get, "seconds": {"judged": judged_at - began, "summary": time.monotonic() - judged_at}, "judged": judged, "summary": summary}


def evaluate_sections(clusters: DataFrame, outputs: DataFrame, first: int | None = 8) -> dict[str, DataFrame]:
    """The second evaluation, of the first clusters by id (all if None): ``clusters`` as from ``unify``, ``outputs`` (``cluster_id``, ``raw_text``)."""
    some = clusters if first is None else clusters.orderBy("cluster_id").limit(first)
    ranks = F.map_from_entries(F.transform("papers", lambda p: F.struct(p["paper_id"], F.coalesce(p["rank_in_cluster"], F.lit(1_000_000_000)))))
    scored = judging.heuristic(outputs.join(some.select("cluster_id", ranks.alias("ranks")), "cluster_id"))
    return {"scored": scored, "rules": judging.rule_averages(scored, [])}


def confidence(size: Column, cohesion: Column, strong: float = 0.35, moderate: float = 0.25) -> Column:
    """HIGH: four papers or more and strong cohesion; MEDIUM: two or more, or moderate cohesion; else LOW."""
    return F.when((size >= 4) & (cohesion >= strong), "HIGH").when((size >= 2) | (cohesion >= moderate), "MEDIUM").otherwise("LOW")


def rich_pack(members: DataFrame, keys: list[str], cues: str = r"(?i)\b(we propose|novel|outperform|future work|limitation)", n: int = 3, max_chars: int = 1200) -> DataFrame:
    """The top papers of each cluster with their cue sentences, cut to ``max_chars``."""
    tops = top_n(members, [*keys, "label"], n, "rank_in_cluster")
    cue = F.filter(T.sentences(F.col("summary")), lambda s: s.rlike(cues))
    return tops.select(*keys, "label", "paper_id", "rank_in_cluster", F.substring(F.array_join(cue, " "), 1, max_chars).alias("highlights"))
