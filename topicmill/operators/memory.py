"""Upserts into the memory tables, and reading the best run back. All return new DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cluster_id, piped
from .durable import checkpointed, if_few
from .ranking import first_of, top_n


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """One row a key: new rows as they come, known rows with the ``update`` columns replaced. Keys are unique on either side."""
    old = existing.select(*keys, F.struct(*existing.columns).alias("_old"))
    new = incoming.select(*keys, F.struct(*incoming.columns).alias("_new"))
    both = old.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in update:
            return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
        return F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c)

    return both.select(*[value(c) for c in existing.columns])


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: rows of new keys are added, nothing is removed."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def last_of_batch(incoming: DataFrame, keys: list[str], *position: str) -> DataFrame:
    return first_of(incoming, keys, *[F.desc(p) for p in position])


def select_run(runs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert runs; of each snapshot and role only the incoming run stays selected. ``incoming`` has one run of each."""
    chosen = incoming.select("snapshot_id", "role", F.col("cluster_run_id").alias("_chosen"))
    merged = upsert(runs, incoming, ["cluster_run_id"], ["selected_best"])
    return merged.join(chosen, ["snapshot_id", "role"], "left").withColumn(
        "selected_best", F.when(F.col("_chosen").isNotNull(), F.col("cluster_run_id") == F.col("_chosen")).otherwise(F.col("selected_best"))
    ).select(*runs.columns)


def replace_of_runs(existing: DataFrame, incoming: DataFrame, runs: DataFrame) -> DataFrame:
    """Clusters of other runs stay, those of ``runs`` are the incoming ones."""
    return existing.join(runs.select("cluster_run_id"), "cluster_run_id", "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def replace_members(existing: DataFrame, clusters: DataFrame, incoming: DataFrame, runs: DataFrame) -> DataFrame:
    """Members of the clusters of ``runs`` go with them."""
    gone = clusters.join(runs.select("cluster_run_id"), "cluster_run_id", "left_semi").select("cluster_id")
    return existing.join(gone, "cluster_id", "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def missing_keys(rows: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose ``key`` no parent has."""
    return rows.join(parents.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def flatten(payloads: DataFrame) -> dict[str, DataFrame]:
    """Nested payloads (a row each) as flat tables, see ``packing.flat_payload``; the key is the run's id."""
    header = payloads.select(
        "*", F.col("embed_config.embed_config_id").alias("embed_config_id"), F.col("embed_config.json_payload").alias("embed_json"),
        F.col("cluster_config.cluster_config_id").alias("cluster_config_id"), F.col("cluster_config.json_payload").alias("cluster_json"),
    )
    base = with_ids(header).withColumn("payload_id", F.col("cluster_run_id"))
    clusters = base.select("payload_id", F.explode("clusters").alias("c")).select("payload_id", "c.*")
    return {
        "payload": base.select("payload_id", *HEADER),
        "papers": base.select("payload_id", F.posexplode("papers").alias("pos", "p")).select("payload_id", "pos", "p.*"),
        "clusters": clusters.drop("members"),
        "members": clusters.select("payload_id", "cluster_index", F.explode("members").alias("m")).select("payload_id", "cluster_index", "m.*"),
    }


HEADER = ["source", "period_start", "period_end", "snapshot_id", "raw_json", "role", "embed_config_id", "embed_json", "cluster_config_id", "cluster_json"]


def with_ids(header: DataFrame) -> DataFrame:
    """Headers of payloads with missing ids, role and text filled in, and ``cluster_run_id``."""
    snapshot = F.coalesce("snapshot_id", piped(F.col("source"), F.col("period_start"), F.col("period_end")))
    filled = header.withColumns({"snapshot_id": snapshot, "role": F.coalesce("role", F.lit("hf_batch")), "raw_json": F.coalesce("raw_json", F.lit("{}"))})
    return filled.withColumn("cluster_run_id", piped(F.col("snapshot_id"), F.col("embed_config_id"), F.col("cluster_config_id"), F.col("role")))


def new_tables(flat: dict[str, DataFrame], now: Column | None = None, more: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The memory's rows of flat payloads. Papers, clusters and members meet their payload's ids by a join on ``payload_id``.

    ``more``: ids of the payload (``snapshot_id``) that clusters and members get beside their own columns.

    Of a paper's rows the last wins, by snapshot and position; of a configuration's the last by payload.
    """
    at = F.current_timestamp() if now is None else now
    base = with_ids(flat["payload"])
    ids = if_few(checkpointed(base.select("payload_id", "snapshot_id", "cluster_run_id")))
    papers = flat["papers"].join(ids, "payload_id")
    clusters = flat["clusters"].join(ids, "payload_id").withColumn("cluster_id", cluster_id(F.col("cluster_run_id"), F.col("cluster_index")))
    members = flat["members"].join(ids, "payload_id").withColumn("cluster_id", cluster_id(F.col("cluster_run_id"), F.col("cluster_index")))
    config = lambda kind: last_of_batch(base, [f"{kind}_config_id"], "payload_id").select(f"{kind}_config_id", F.col(f"{kind}_json").alias("json_payload"), at.alias("created_at"))
    return {
        "embed_config": config("embed"),
        "cluster_config": config("cluster"),
        "source_snapshot": last_of_batch(base, ["snapshot_id"], "payload_id").select("snapshot_id", "source", "period_start", "period_end", "raw_json", at.alias("created_at")),
        "paper": last_of_batch(papers, ["paper_id"], "snapshot_id", "pos").select(
            "paper_id", "title", "summary", "keywords", "url", F.lit("hf").alias("source"), "published_at", at.alias("ingested_at")
        ),
        "snapshot_paper": papers.select("snapshot_id", "paper_id").distinct(),
        "cluster_run": base.select("cluster_run_id", "snapshot_id", "embed_config_id", "cluster_config_id", "role", F.lit(True).alias("selected_best"), at.alias("created_at")),
        "cluster": clusters.select("cluster_id", "cluster_run_id", "cluster_index", "size", "centroid", "cohesion", at.alias("created_at"), *more),
        "cluster_member": members.select("cluster_id", "paper_id", "rank_in_cluster", "sim_to_centroid", *more),
    }


def explode_payloads(payloads: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """The memory's rows of nested payloads; ids are derived where they are missing."""
    return new_tables(flatten(payloads), now)


def faults(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """What forbids an ingest: ``fault`` and ``id``, for members without a paper, clusters twice in a run, members of no cluster, two runs for one snapshot and role."""
    papers = tables["paper"].select("paper_id").union(new["paper"].select("paper_id"))
    unknown = missing_keys(new["cluster_member"], papers, "paper_id").select(F.lit("member without paper").alias("fault"), F.col("paper_id").alias("id"))
    twice = new["cluster"].groupBy("cluster_id").count().where("count > 1").select(F.lit("cluster index twice").alias("fault"), F.col("cluster_id").alias("id"))
    runs = new["cluster_run"].groupBy("snapshot_id", "role").count().where("count > 1").select(F.lit("two runs for one snapshot and role").alias("fault"), F.col("snapshot_id").alias("id"))
    stray = missing_keys(new["cluster_member"], new["cluster"], "cluster_id").select(F.lit("member without cluster").alias("fault"), F.col("cluster_id").alias("id"))
    return unknown.union(twice).union(runs).union(stray)


def refuse_faults(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> None:
    """Raise an error that names the first faults of an ingest."""
    if bad := faults(tables, new).limit(5).collect():
        raise ValueError("; ".join(f"{r['fault']}: {r['id']}" for r in bad))


def merged(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after the new rows, which have no faults."""
    runs = new["cluster_run"]
    return tables | {
        "embed_config": upsert(tables["embed_config"], new["embed_config"], ["embed_config_id"], ["json_payload"]),
        "cluster_config": upsert(tables["cluster_config"], new["cluster_config"], ["cluster_config_id"], ["json_payload"]),
        "source_snapshot": upsert(tables["source_snapshot"], new["source_snapshot"], ["snapshot_id"], ["raw_json"]),
        "paper": upsert(tables["paper"], new["paper"], ["paper_id"], ["title", "summary", "keywords", "url", "published_at"]),
        "snapshot_paper": insert_missing(tables["snapshot_paper"], new["snapshot_paper"], ["snapshot_id", "paper_id"]),
        "cluster_run": select_run(tables["cluster_run"], runs),
        "cluster": replace_of_runs(tables["cluster"], new["cluster"], runs),
        "cluster_member": replace_members(tables["cluster_member"], tables["cluster"], new["cluster_member"], runs),
    }


def ingest(tables: dict[str, DataFrame], payloads: DataFrame | dict[str, DataFrame], now: Column | None = None) -> dict[str, DataFrame]:
    """All tables after the payloads, nested or flat; an error names the faults before anything is written."""
    new = new_tables(payloads, now) if isinstance(payloads, dict) else explode_payloads(payloads, now)
    refuse_faults(tables, new)
    return merged(tables, new)


def selected_runs(runs: DataFrame, role: str = "hf_batch") -> DataFrame:
    """The newest selected run of every snapshot."""
    return first_of(runs.where((F.col("role") == role) & F.col("selected_best")), ["snapshot_id"], F.desc("created_at"), "cluster_run_id")


def top_members(members: DataFrame, papers: DataFrame, n: int) -> DataFrame:
    """The first ``n`` known papers of every cluster, in one pass."""
    return top_n(members.join(papers, "paper_id"), ["cluster_id"], n, "rank_in_cluster", "paper_id")


def best_runs(tables: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """One card a snapshot: its selected run with clusters by index and their top papers."""
    runs = selected_runs(tables["cluster_run"]).drop("selected_best", "created_at", "role")
    clusters = tables["cluster"].join(runs.select("cluster_run_id"), "cluster_run_id", "left_semi")
    paper = F.struct("rank_in_cluster", "paper_id", "title", "summary", "keywords", "url", "sim_to_centroid")
    tops = top_members(tables["cluster_member"].join(clusters.select("cluster_id"), "cluster_id", "left_semi"), tables["paper"], n)
    nested = tops.groupBy("cluster_id").agg(F.array_sort(F.collect_list(paper)).alias("papers"))
    none = F.array().cast(nested.schema["papers"].dataType)
    cards = clusters.join(nested, "cluster_id", "left").withColumn("papers", F.coalesce("papers", none))
    lists = cards.groupBy("cluster_run_id").agg(F.array_sort(F.collect_list(F.struct("cluster_index", "cluster_id", "size", "cohesion", "papers"))).alias("clusters"))
    return runs.join(tables["source_snapshot"].select("snapshot_id", "source", "period_start", "period_end"), "snapshot_id").join(lists, "cluster_run_id", "left")


def best_run(tables: dict[str, DataFrame], source: str, start: str, end: str, n: int = 10) -> DataFrame:
    """The card of one period; an error if it has no selected run."""
    found = best_runs(tables, n).where(F.col("snapshot_id") == f"{source}|{start}|{end}")
    if found.isEmpty():
        raise ValueError(f"no selected run for {source}|{start}|{end}")
    return found
