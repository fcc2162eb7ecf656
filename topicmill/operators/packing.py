"""Packing clusters for summaries, and nesting clusterings to payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import FLAT
from .durable import checkpointed, if_few
from .ranking import first_of, full_ranks


def pack(members: DataFrame, papers: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cluster with its ranked known papers; clusters left empty stay.

    ``members``: keys, ``cluster_index``, ``seq``, ``paper_id``, ``rank_in_cluster``, ``sim_to_centroid``; a cluster
    without members has one row of null ``paper_id`` and ``seq``. ``papers``: keys, ``pos`` and the paper's
    fields; the last duplicate wins. Missing ranks sort as 999 and read 0.
    """
    known = first_of(papers, [*keys, "paper_id"], F.desc("pos")).drop("pos").withColumn("_known", F.lit(True))
    joined = members.join(known, [*keys, "paper_id"], "left")
    paper = F.struct(
        F.coalesce("rank_in_cluster", F.lit(999)).alias("order"), "seq", "paper_id", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("sim_to_centroid", F.lit(0.0)).alias("sim_to_centroid"),
        F.coalesce("rank_in_cluster", F.lit(0)).alias("rank_in_cluster"),
    )
    packed = joined.groupBy(*keys, "cluster_index").agg(F.array_sort(F.collect_list(F.when(F.col("_known"), paper))).alias("papers"))
    return packed.withColumn("papers", F.transform("papers", lambda p: p.dropFields("order", "seq")))


def pack_warnings(members: DataFrame, papers: DataFrame, keys: list[str]) -> DataFrame:
    """Members without an id, or of papers that are not there."""
    given = members.where(F.col("seq").isNotNull())
    empty = given.where(F.coalesce("paper_id", F.lit("")) == "").select(*keys, "cluster_index", F.lit("missing paper id").alias("warning"), "paper_id")
    unknown = given.where(F.coalesce("paper_id", F.lit("")) != "").join(papers.select(*keys, "paper_id"), [*keys, "paper_id"], "left_anti")
    return empty.union(unknown.select(*keys, "cluster_index", F.lit("unknown paper").alias("warning"), "paper_id"))


def pack_stats(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.groupBy(*keys).agg(F.count("*").alias("n_clusters"), F.sum(F.size("papers")).alias("n_papers"))


def unify(payloads: DataFrame) -> DataFrame:
    """Clusters of many payloads with their known papers in member order; clusters without any are dropped."""
    base = payloads.select("source", "period_start", "period_end", "papers", F.explode("clusters").alias("c"))
    period = F.concat_ws("|", "source", "period_start", "period_end", F.col("c.cluster_index").cast("string"))
    members = base.select(period.alias("cluster_id"), "source", "period_start", "period_end", F.posexplode("c.members").alias("pos", "m"))
    papers = first_of(
        payloads.select("source", "period_start", "period_end", F.posexplode("papers").alias("at", "p")).select("source", "period_start", "period_end", "at", "p.paper_id", "p.title", "p.summary", "p.keywords"),
        ["source", "period_start", "period_end", "paper_id"], F.desc("at"),
    ).drop("at")
    rows = members.select("cluster_id", "source", "period_start", "period_end", "pos", "m.paper_id", "m.rank_in_cluster").join(papers, ["source", "period_start", "period_end", "paper_id"])
    paper = F.struct("pos", "paper_id", "title", "summary", "keywords", "rank_in_cluster")
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(paper)).alias("papers")).withColumn("papers", F.transform("papers", lambda p: p.dropFields("pos")))


def unify_rows(flat: dict[str, DataFrame]) -> DataFrame:
    """As ``unify``, of flat payloads and with a row for each member: ``cluster_id``, ``pos``, the paper's fields and ``rank_in_cluster``.

    Nothing is gathered, so a payload or cluster may hold any number of papers. ``pos``
    counts a cluster's known papers from 0, by rank and then id; known papers are placed
    without their texts, which join afterwards. Of a paper given twice the last one wins.
    """
    period = ["source", "period_start", "period_end"]
    dated = flat["payload"].select("payload_id", *period)
    papers = first_of(flat["papers"].join(dated, "payload_id").select(*period, "pos", "paper_id", "title", "summary", "keywords"), [*period, "paper_id"], F.desc("pos")).drop("pos")
    cluster = F.concat_ws("|", *period, F.col("cluster_index").cast("string")).alias("cluster_id")
    members = flat["members"].join(dated, "payload_id").select(cluster, *period, "paper_id", "rank_in_cluster")
    known = members.join(papers.select(*period, "paper_id"), [*period, "paper_id"], "left_semi")
    placed = full_ranks(known, ["cluster_id"], ["rank_in_cluster", "paper_id"], "pos")
    return placed.join(papers, [*period, "paper_id"]).select("cluster_id", "pos", "paper_id", "title", "summary", "keywords", "rank_in_cluster")


def _flat(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with the columns and types of one table of a flat payload; missing ones are null."""
    fields = [f.split(":", 1) for f in _fields(FLAT[kind])]
    return rows.select("payload_id", *[(F.col(name) if name in rows.columns else F.lit(None)).cast(type_).alias(name) for name, type_ in fields])


def _fields(text: str) -> list[str]:
    """The fields of a struct's text; none of the flat tables nests further than an array."""
    return text.split(",")


def flat_payload(members: DataFrame, headers: DataFrame) -> dict[str, DataFrame]:
    """Payloads as four tables that share ``payload_id``: ``payload`` (a row each), ``papers``, ``clusters`` and ``members``.

    Nothing is gathered, so a period may hold any number of papers. ``members``:
    ``payload_id``, ``label``, ``paper_id``, ``rank_in_cluster``, ``sim`` and the
    paper's fields, a paper once a payload; ``headers``: ``payload_id`` and what
    it has of source, period, ids, role and configurations (the rest is null).
    Members without a header are left out; a header without members stays.
    """
    known = members.join(if_few(checkpointed(headers.select("payload_id"))), "payload_id", "left_semi")
    placed = known.withColumn("cluster_index", F.col("label")).withColumn("sim_to_centroid", F.col("sim"))
    clusters = placed.groupBy("payload_id", "cluster_index").agg(F.count("*").alias("size"), F.avg("sim").alias("cohesion"))
    return {
        "payload": _flat(headers, "payload"),
        "papers": _flat(known.drop("pos").withColumn("pos", F.lit(0)), "papers"),
        "clusters": _flat(clusters, "clusters"),
        "members": _flat(placed, "members"),
    }


def typed_rows(flat: dict[str, DataFrame]) -> DataFrame:
    """A flat payload as one table: ``kind``, ``payload_id`` and a struct for each kind, null but for the row's own."""
    out = None
    for kind in FLAT:
        rows = _flat(flat[kind], kind)
        own = F.struct(*[c for c in rows.columns if c != "payload_id"])
        structs = [(own if k == kind else F.lit(None).cast(f"struct<{fields}>")).alias(k) for k, fields in FLAT.items()]
        part = rows.select(F.lit(kind).alias("kind"), "payload_id", *structs)
        out = part if out is None else out.union(part)
    return out


def flat_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of typed rows; an unknown kind is an error."""
    known = F.when(F.col("kind").isin(*FLAT), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of payload row: "), F.coalesce("kind", F.lit("null")))))
    return {kind: rows.where(known == kind).select("payload_id", f"{kind}.*") for kind in FLAT}


def payload(members: DataFrame, keys: list[str]) -> DataFrame:
    """One row a period, for periods that one row can hold (``flat_payload`` has no such limit): ``papers``, and ``clusters`` with ranked members, size and cohesion.

    ``members``: keys, ``label``, ``paper_id``, ``rank_in_cluster``, ``sim``, and the paper's fields.
    """
    one = members.groupBy(*keys, "label").agg(
        F.array_sort(F.collect_list(F.struct("rank_in_cluster", "paper_id", F.col("sim").alias("sim_to_centroid")))).alias("members"), F.avg("sim").alias("cohesion"), F.count("*").alias("size")
    )
    clusters = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("label").cast("bigint").alias("cluster_index"), "size", "cohesion", "members"))).alias("clusters"))
    papers = members.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("paper_id", "title", "summary", "keywords", "url", "published_at"))).alias("papers"))
    return papers.join(clusters, keys)
