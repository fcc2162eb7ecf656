"""Registered queries: each operator over whole tables. SQL for them is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoders
from ..functions import text as T
from ..functions.vectors import doubles
from ..operators import clustering, json_checks, judging, memory, metrics, packing, ranking
from ..operators.durable import scratch_folder, stored
from ..sources import checked, readers, sinks, table
from . import pipelines, reports, topics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def r6(c):
    return F.round(c, 6)


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read as papers."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), 0)
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("hf:"), F.col("doc_id").cast("string")).alias("paper_id"), F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("summary"), words.alias("keywords"), F.col("lang"), F.col("source"),
        F.concat(F.lit("month=2025-"), F.lpad((1 + F.col("doc_id") % 12).cast("string"), 2, "0")).alias("month_key"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding", "label")


def labelled_papers(spark: SparkSession, folder: str) -> DataFrame:
    return points(spark, folder).select(F.col("paper_id").alias("doc_id"), "label").join(papers(spark, folder), "doc_id")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The given labels coarsened to k = 4 and 5, with keywords."""
    ks = points(spark, folder).select("paper_id", "embedding", F.col("label").alias("_label"), F.explode(F.array(F.lit(4), F.lit(5))).alias("k"))
    words = papers(spark, folder).select(F.col("doc_id").alias("paper_id"), "keywords")
    return ks.withColumn("label", F.col("_label") % F.col("k")).drop("_label").join(words, "paper_id", "left")


# --- vectors and metrics ----------------------------------------------------------------------


@query
def centroids(spark, folder):
    found = metrics.centroids(points(spark, folder), []).select("label", F.posexplode("centroid").alias("pos", "value"))
    return found.select("label", F.col("pos").cast("bigint").alias("pos"), r6(F.col("value")).alias("value"))


def _similar(spark, folder):
    return metrics.member_similarity(points(spark, folder), [])


@query
def member_similarity(spark, folder):
    return _similar(spark, folder).select("paper_id", "label", r6(F.col("sim")).alias("sim"))


def _ranked(spark, folder):
    return ranking.member_rank(_similar(spark, folder).withColumn("sim", F.round("sim", 9)), ["label"])


@query
def member_rank(spark, folder):
    return _ranked(spark, folder).select("paper_id", "label", "rank_in_cluster")


@query
def cluster_cohesion(spark, folder):
    return metrics.cohesion(_similar(spark, folder), []).select("label", r6(F.col("cohesion")).alias("cohesion"), "size")


@query
def cohesion_summary(spark, folder):
    found = metrics.cohesion_summary(metrics.cohesion(_similar(spark, folder), []), [])
    return found.select(*[r6(F.col(c)).alias(c) for c in found.columns])


@query
def silhouette_cosine(spark, folder):
    return metrics.silhouette(points(spark, folder), []).select(r6(F.col("silhouette")).alias("silhouette"))


@query
def davies_bouldin(spark, folder):
    return metrics.davies_bouldin(points(spark, folder), []).select(r6(F.col("davies_bouldin")).alias("davies_bouldin"))


@query
def calinski_harabasz(spark, folder):
    return metrics.calinski_harabasz(points(spark, folder), []).select(r6(F.col("calinski_harabasz")).alias("calinski_harabasz"))


@query
def keyword_entropy(spark, folder):
    return metrics.keyword_entropy(labelled_papers(spark, folder), []).select("label", r6(F.col("entropy")).alias("entropy"))


@query
def entropy_summary(spark, folder):
    found = metrics.entropy_summary(metrics.keyword_entropy(labelled_papers(spark, folder), []), [])
    return found.select(*[r6(F.col(c)).alias(c) for c in found.columns])


def _scores(spark, folder):
    return metrics.score_all(candidates(spark, folder), ["k"])


@query
def composite_score(spark, folder):
    names = ["silhouette", "davies_bouldin", "calinski_harabasz", "avg_cohesion", "worst_cohesion", "avg_entropy", "max_entropy", "score"]
    return _scores(spark, folder).select("k", *[r6(F.col(c)).alias(c) for c in names])


@query
def best_config(spark, folder):
    found = clustering.best_config(_scores(spark, folder).withColumn("period", F.lit("all")).withColumn("score", r6(F.col("score"))), ["period"], "k")
    return found.select("period", "k", "score")


@query
def nearest_centroid(spark, folder):
    own = points(spark, folder)
    middle = metrics.centroids(own, []).withColumn("g", F.lit(0)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("centers"))
    found = clustering.assign(metrics.as_double(own).withColumn("g", F.lit(0)).drop("label"), middle, ["g"])
    return found.select("paper_id", "label", r6(F.sqrt("d")).alias("distance"))


def _by_month(spark, folder):
    own = points(spark, folder).drop("label").join(papers(spark, folder).select(F.col("doc_id").alias("paper_id"), "keywords"), "paper_id", "left")
    return own.withColumn("period", F.col("paper_id") % 4)


@query
def kmeans_grid(spark, folder):
    found = clustering.kmeans_groups(_by_month(spark, folder), ["period"], [4, 5])
    return found.groupBy("period", "k", "label").agg(F.count("*").alias("size"), r6(F.sum("d")).alias("inertia"))


@query
def best_clustering(spark, folder):
    labelled, scores = clustering.grid_search(_by_month(spark, folder), ["period"], [4, 5])
    best = clustering.best_config(scores, ["period"], "k")
    members = ranking.member_rank(clustering.best_clustering(labelled, best, ["period", "k"]), ["period", "k", "label"])
    return members.select("period", "k", "label", "paper_id", "rank_in_cluster", r6(F.col("sim")).alias("sim"))


# --- text -------------------------------------------------------------------------------------


def _embedding_text(mode):
    def run(spark, folder):
        return papers(spark, folder).select("doc_id", T.embedding_text(F.col("title"), F.col("summary"), F.col("keywords"), mode).alias("text"))

    run.__name__ = f"embedding_text_{mode.lower()}"
    return run


for _mode in "ABC":
    query(_embedding_text(_mode))


@query
def encode_text(spark, folder):
    found = pipelines.encode_papers(papers(spark, folder), ["B"])
    return found.select("doc_id", F.size("embedding").alias("dims"), r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2"))


@query
def encode_terms(spark, folder):
    """The vectors of a model fitted on all documents and run by ``predict_batch_udf``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encode = encoders.model_encoder(encoders.term_model(encoders.fit_term_weights(docs)), precise=True)
    return encode(docs).select("doc_id", F.posexplode("embedding").alias("pos", "value")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), (r6("value") + 0.0).alias("value"))


@query
def month_counts(spark, folder):
    months = spark.range(0, 24).select(F.date_format(F.add_months(F.lit("2025-01-01").cast("date"), F.col("id").cast("int")), "'month='yyyy-MM").alias("month_key"))
    counts = papers(spark, folder).groupBy("month_key").agg(F.count("*").alias("n"))
    return months.join(counts, "month_key", "left").select("month_key", F.coalesce("n", F.lit(0)).alias("n"))


@query
def period_bounds(spark, folder):
    key = F.concat(F.lit("month="), F.date_format("ts", "yyyy-MM"))
    first, last = T.period_bounds(F.col("month_key"))
    return table(spark, folder, "events").select(key.alias("month_key")).groupBy("month_key").agg(F.count("*").alias("n")).select("month_key", "n", first.alias("period_start"), last.alias("period_end"))


@query
def paper_projection(spark, folder):
    stamp = F.concat(F.substring(F.col("ts").cast("string"), 1, 10), F.lit("T23:30:00-05:00"))
    given = F.when(F.col("event_id") % 5 == 0, F.lit("bad")).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(stamp)
    rows = table(spark, folder, "events").select("event_id", F.col("event_id").cast("string").alias("id"), given.alias("at"))
    return rows.select(
        "event_id", T.paper_id(F.col("id")).alias("paper_id"), F.concat(F.lit("https://papers/"), F.col("id")).alias("url"),
        T.iso_date(F.col("at")).alias("published_at"), T.is_date(T.iso_date(F.col("at"))).alias("is_date"),
    )


@query
def truncate_summary(spark, folder):
    return papers(spark, folder).select("doc_id", T.truncate(F.col("summary")).alias("summary"))


@query
def derived_ids(spark, folder):
    first, last = T.period_bounds(F.col("month_key"))
    base = papers(spark, folder).select("doc_id", T.piped("hf", first, last).alias("snapshot_id"))
    run = T.piped(F.col("snapshot_id"), T.config_id("embed", "0.1"), T.config_id("kmeans", "0.1"), "hf_batch")
    return base.select("doc_id", "snapshot_id", run.alias("run_id")).withColumn("cluster_id", T.cluster_id(F.col("run_id"), F.col("doc_id") % 5))


@query
def word_count(spark, folder):
    s = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", T.word_count(s).cast("bigint").alias("words"), T.plain_word_count(s).cast("bigint").alias("plain_words"), F.size(T.terms(s)).cast("bigint").alias("terms")
    )


@query
def title_case(spark, folder):
    titles = papers(spark, folder).select("doc_id", F.initcap(T.strip(F.col("title"))).alias("capital"), T.strip(F.col("title")).alias("title"))
    return titles.select("doc_id", T.title_case(F.col("title")).alias("plain"), T.title_case(F.col("capital")).alias("capital"))


@query
def title_case_strict(spark, folder):
    titles = table(spark, folder, "conversations").select("conv_id", "turn", T.strip(F.col("text")).alias("t"))
    return titles.select("conv_id", "turn", T.title_case_strict(F.col("t")).alias("plain"), T.title_case_strict(F.initcap("t")).alias("capital"))


@query
def citations(spark, folder):
    cited = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.col("text"), F.lit(" [x.1] [not one]"))
    rows = table(spark, folder, "documents").select("doc_id", cited.alias("t"))
    return rows.select(
        "doc_id", F.array_join(T.citations(F.col("t")), ",").alias("cited"), T.has_citation(F.col("t")).alias("has"), T.item_id(F.col("t")).alias("item"), F.length(T.item_rest(F.col("t"))).cast("bigint").alias("rest"),
        T.names_cluster(F.col("t")).alias("names_cluster"),
    )


@query
def sentence_links(spark, folder):
    t = F.regexp_replace(F.col("text"), r"\. ", " [a] [b]. ")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", judging.link_sentences(F.col("t")).cast("bigint").alias("n_links"), judging.cross_links(F.col("t")).alias("score"))


@query
def keyword_dedup(spark, folder):
    k = F.concat("keywords", F.transform("keywords", lambda x: F.replace(x, F.lit("e"), F.lit("E"))))
    return papers(spark, folder).select("doc_id", T.unique_ignoring_case(k).cast("bigint").alias("n_unique"), F.array_join(T.distinct_first(F.col("keywords")), " ").alias("first"), F.array_join(T.keywords_normal(k), " ").alias("normal"))


@query
def rank_order(spark, folder):
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    ids = F.transform("t", lambda x: x["turn"].cast("string"))
    ranks = F.map_from_entries(F.transform("t", lambda x: F.struct(x["turn"].cast("string"), x["n"])))
    return rows.select("conv_id", ranking.ranks_rise(ids, ranks).alias("rises"))


@query
def page_links(spark, folder):
    found = table(spark, folder, "pages").select("page_id", F.posexplode(T.links(F.col("html"), r"/[A-Za-z]+")).alias("pos", "link"))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


# --- memory -----------------------------------------------------------------------------------


def _versions(spark, folder):
    base = papers(spark, folder).select("doc_id", "paper_id", "title", "lang", F.lit("old").alias("batch"))
    return base.where("doc_id % 3 < 2"), base.where("doc_id % 3 > 0").withColumn("title", F.concat(F.lit("new "), F.col("title"))).withColumn("batch", F.lit("new"))


@query
def upsert_papers(spark, folder):
    old, new = _versions(spark, folder)
    return memory.upsert(old, new, ["paper_id"], ["title"]).select("paper_id", "title", "batch")


@query
def link_insert_ignore(spark, folder):
    old, new = _versions(spark, folder)
    return memory.insert_missing(old.select("lang", "paper_id", "batch"), new.select("lang", "paper_id", "batch"), ["lang", "paper_id"])


def _runs(spark, folder):
    """Two runs for each month; the incoming ones are those of even months."""
    first, last = T.period_bounds(F.col("month_key"))
    months = papers(spark, folder).groupBy("month_key").agg(F.count("*").alias("n"))
    base = months.select("month_key", T.piped("hf", first, last).alias("snapshot_id"), F.explode(F.array(F.lit("k4"), F.lit("k5"))).alias("config"))
    runs = base.select(
        "month_key", F.concat_ws("|", "snapshot_id", "config").alias("cluster_run_id"), "snapshot_id", F.lit("hf_batch").alias("role"), (F.col("config") == "k4").alias("selected_best"),
        F.when(F.col("config") == "k4", F.lit("2025-01-01")).otherwise(F.lit("2025-01-02")).alias("created_at"),
    )
    even = F.substring("month_key", 12, 2).cast("int") % 2 == 0
    incoming = runs.where(even & F.col("cluster_run_id").endswith("k5")).withColumn("selected_best", F.lit(True))
    return runs.where(~(even & F.col("cluster_run_id").endswith("k5"))).drop("month_key"), incoming.drop("month_key")


@query
def select_best_run(spark, folder):
    merged = memory.select_run(*_runs(spark, folder))
    chosen = memory.selected_runs(merged).select("cluster_run_id", F.lit(True).alias("shown"))
    return merged.join(chosen, "cluster_run_id", "left").select("cluster_run_id", "snapshot_id", "selected_best", F.coalesce("shown", F.lit(False)).alias("shown"))


@query
def replace_clusters(spark, folder):
    rows = points(spark, folder).select(F.concat(F.lit("r"), (F.col("paper_id") % 4).cast("string")).alias("cluster_run_id"), "label", "paper_id")
    old = rows.groupBy("cluster_run_id", "label").agg(F.count("*").alias("size")).withColumn("batch", F.lit("old"))
    new = rows.where("cluster_run_id = 'r1' AND label < 5").groupBy("cluster_run_id", "label").agg(F.count("*").alias("size")).withColumn("batch", F.lit("new"))
    return memory.replace_of_runs(old, new, new.select("cluster_run_id").distinct())


@query
def fk_violations(spark, folder):
    # Each member, and once more under an id that no document has.
    rows = points(spark, folder).select(F.explode(F.array(F.col("paper_id"), -F.col("paper_id") - 1)).alias("paper_id"), "label")
    return memory.missing_keys(rows, table(spark, folder, "documents"), "paper_id", "doc_id").select("paper_id", "label")


def _known_payloads(spark, folder):
    """Flat payloads of the months, the given labels as clusters; members are the known papers among theirs."""
    first, last = T.period_bounds(F.col("payload_id"))
    own = papers(spark, folder).select(F.col("month_key").alias("payload_id"), "paper_id", "title", "summary", "keywords", F.lit("").alias("url"), F.lit("").alias("published_at"))
    month = F.concat(F.lit("month=2025-"), F.lpad((1 + F.col("paper_id") % 12).cast("string"), 2, "0"))
    placed = _ranked(spark, folder).select(month.alias("payload_id"), F.concat(F.lit("hf:"), F.col("paper_id").cast("string")).alias("paper_id"), "label", "rank_in_cluster", "sim")
    headers = own.select("payload_id").distinct().join(placed, "payload_id", "left_semi").select(
        "payload_id", F.lit("hf").alias("source"), first.alias("period_start"), last.alias("period_end"),
        *[F.lit(f"{k}|0.1").alias(f"{k}_config_id") for k in ("embed", "cluster")], *[F.lit("{}").alias(f"{k}_json") for k in ("embed", "cluster")],
    )
    flat = packing.flat_payload(placed, headers)
    every = packing.flat_payload(own.withColumns({"label": F.lit(0), "rank_in_cluster": F.lit(0), "sim": F.lit(0.0)}), headers)
    return flat | {"papers": every["papers"], "members": flat["members"].join(own.select("paper_id"), "paper_id", "left_semi")}


@query
def ingest_memory(spark, folder):
    from ..sources.schemas import TABLES

    empty = {name: spark.createDataFrame([], schema) for name, (schema, _) in TABLES.items()}
    own = _known_payloads(spark, folder)
    once = memory.ingest(empty, own)
    twice = memory.ingest(once, own)
    parts = [twice[n].groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("source_snapshot", "paper", "snapshot_paper", "cluster_run", "cluster", "cluster_member")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _flat_payloads(spark, folder, later: bool):
    """A flat payload for each month. The later ones, of even months, have new texts and fewer clusters; every other one is of a new configuration."""
    month = lambda c: F.concat(F.lit("month=2025-"), F.lpad((1 + F.col(c) % 12).cast("string"), 2, "0"))
    number = F.substring("month_key", 12, 2).cast("int")
    own = papers(spark, folder)
    own = own.where(number % 2 == 0) if later else own.withColumn("title", F.concat(F.lit("old "), F.col("title")))
    placed = _ranked(spark, folder).select(F.col("paper_id").alias("doc_id"), "label", "rank_in_cluster", "sim").withColumn("month_key", month("doc_id"))
    placed = placed.where((number % 2 == 0) & (F.col("label") < 5)) if later else placed
    first, last = T.period_bounds(F.col("month_key"))
    version = F.when((number % 4 == 0) & F.lit(later), F.lit("0.2")).otherwise(F.lit("0.1"))
    headers = own.select("month_key").distinct().select(
        F.col("month_key").alias("payload_id"), F.lit("hf").alias("source"), first.alias("period_start"), last.alias("period_end"), F.lit('{"n": 2}' if later else '{"n": 1}').alias("raw_json"),
        F.lit("embed|0.1").alias("embed_config_id"), F.lit('{"v": 2}' if later else '{"v": 1}').alias("embed_json"),
        T.piped("cluster", version).alias("cluster_config_id"), F.lit('{"k": 5}' if later else '{"k": 10}').alias("cluster_json"),
    )
    known = own.select("doc_id", F.col("month_key").alias("payload_id"), "paper_id", "title", "summary", "keywords", F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"), F.lit("2025-01-01").alias("published_at"))
    flat = packing.flat_payload(placed.drop("month_key").join(known, "doc_id"), headers)
    # Papers that no cluster has belong to the snapshot, too.
    every = packing.flat_payload(known.withColumns({"label": F.lit(0), "rank_in_cluster": F.lit(0), "sim": F.lit(0.0)}), headers)
    return flat | {"papers": every["papers"]}


@query
def payload_rows(spark, folder):
    rows = packing.typed_rows(_flat_payloads(spark, folder, False))
    return rows.select(
        "kind", "payload_id", F.coalesce("payload.period_end", "papers.paper_id", "members.paper_id").alias("id"), F.coalesce("clusters.cluster_index", "members.cluster_index").alias("cluster_index"),
        F.coalesce("clusters.size", "members.rank_in_cluster").alias("number"), r6(F.coalesce("clusters.cohesion", "members.sim_to_centroid")).alias("value"), F.size("papers.keywords").cast("bigint").alias("n_keywords"),
    )


def _ingested(name, *columns):
    """One table of the memory after the earlier and the later payloads."""

    def run(spark, folder):
        from ..sources.schemas import TABLES

        empty = {n: spark.createDataFrame([], schema) for n, (schema, _) in TABLES.items()}
        tables = memory.ingest(empty, _flat_payloads(spark, folder, False))
        return memory.ingest(tables, _flat_payloads(spark, folder, True))[name].selectExpr(*columns)

    run.__name__ = f"ingested_{name}"
    return run


for _made in (
    _ingested("embed_config", "embed_config_id", "json_payload"),
    _ingested("cluster_config", "cluster_config_id", "json_payload"),
    _ingested("source_snapshot", "snapshot_id", "source", "period_start", "period_end", "raw_json"),
    _ingested("paper", "paper_id", "title", "sha2(cast(summary AS binary), 256) AS summary_sha256", "cast(size(keywords) AS bigint) AS n_keywords", "url", "source", "published_at"),
    _ingested("snapshot_paper", "snapshot_id", "paper_id"),
    _ingested("cluster_run", "cluster_run_id", "snapshot_id", "embed_config_id", "cluster_config_id", "role", "selected_best"),
    _ingested("cluster", "cluster_id", "cluster_run_id", "cluster_index", "size", "round(cohesion, 6) AS cohesion"),
    _ingested("cluster_member", "cluster_id", "paper_id", "rank_in_cluster", "round(sim_to_centroid, 6) AS sim_to_centroid"),
):
    query(_made)


@query
def best_run_cards(spark, folder):
    new = memory.new_tables(_known_payloads(spark, folder))
    cards = memory.best_runs(new, 3)
    flat = cards.select("snapshot_id", F.explode("clusters").alias("c")).select("snapshot_id", "c.cluster_index", "c.size", F.posexplode_outer("c.papers").alias("pos", "p"))
    return flat.select("snapshot_id", "cluster_index", "size", F.col("pos").cast("bigint").alias("pos"), F.col("p.paper_id").alias("paper_id"), F.col("p.rank_in_cluster").alias("rank_in_cluster"))


@query
def top_n_per_cluster(spark, folder):
    members = _ranked(spark, folder).select(F.col("label").alias("cluster_id"), F.col("paper_id").alias("doc_id"), "rank_in_cluster")
    known = papers(spark, folder).select("doc_id", "paper_id", "title")
    return memory.top_members(members.join(known.select("doc_id", "paper_id"), "doc_id").drop("doc_id"), known.drop("doc_id"), 10).select("cluster_id", "paper_id", "title", "rank_in_cluster")


@query
def cluster_order(spark, folder):
    sizes = points(spark, folder).withColumn("part", F.col("paper_id") % 5).groupBy("part", "label").agg(F.count("*").alias("size"))
    return ranking.cluster_order(sizes, ["part"])


# --- packing ----------------------------------------------------------------------------------


def _pack_inputs(spark, folder):
    members = _ranked(spark, folder).select(
        (F.col("paper_id") % 3).alias("part"), F.col("label").alias("cluster_index"), F.col("paper_id").alias("seq"), F.concat(F.lit("hf:"), F.col("paper_id").cast("string")).alias("paper_id"),
        F.when(F.col("paper_id") % 11 > 0, F.col("rank_in_cluster")).alias("rank_in_cluster"), F.col("sim").alias("sim_to_centroid"),
    )
    unknown = members.where("seq % 13 = 0").withColumn("paper_id", F.concat(F.lit("unknown:"), F.col("seq").cast("string"))).withColumn("seq", -F.col("seq") - 1)
    members = members.unionByName(unknown)
    own = papers(spark, folder).select((F.col("doc_id") % 3).alias("part"), "paper_id", "title", "summary", "keywords", F.lit(None).cast("string").alias("url"), F.col("doc_id").alias("pos"))
    return members, own


@query
def pack_clusters(spark, folder):
    packed = packing.pack(*_pack_inputs(spark, folder), ["part"])
    flat = packed.select("part", "cluster_index", F.posexplode_outer("papers").alias("pos", "p"))
    return flat.select("part", "cluster_index", F.col("pos").cast("bigint").alias("pos"), F.col("p.paper_id").alias("paper_id"), F.col("p.title").alias("title"), F.col("p.rank_in_cluster").alias("rank_in_cluster"), F.size("p.keywords").cast("bigint").alias("n_keywords"))


@query
def pack_warnings(spark, folder):
    return packing.pack_warnings(*_pack_inputs(spark, folder), ["part"])


@query
def pack_stats(spark, folder):
    return packing.pack_stats(packing.pack(*_pack_inputs(spark, folder), ["part"]), ["part"])


@query
def unify_clusters(spark, folder):
    return packing.unify_rows(_known_payloads(spark, folder)).select("cluster_id", "pos", "paper_id")


@query
def payload_json(spark, folder):
    """The months' payloads without their texts: numbers of papers, clusters, and their members in order."""
    known = papers(spark, folder).select("doc_id", "paper_id", F.col("month_key").alias("payload_id"))
    members = _ranked(spark, folder).withColumnRenamed("paper_id", "doc_id").join(known, "doc_id")
    flat = packing.flat_payload(members, known.select("payload_id").distinct())
    counts = flat["papers"].groupBy("payload_id").agg(F.count("*").alias("n_papers"))
    names = flat["members"].groupBy("payload_id", "cluster_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_cluster", "paper_id"))), lambda m: m["paper_id"]), ",").alias("members"))
    found = flat["clusters"].join(names, ["payload_id", "cluster_index"]).join(counts, "payload_id")
    return found.select(F.col("payload_id").alias("month_key"), "n_papers", "cluster_index", "size", r6(F.col("cohesion")).alias("cohesion"), "members")


@query
def text_report(spark, folder):
    members = _ranked(spark, folder).withColumnRenamed("paper_id", "doc_id").join(papers(spark, folder), "doc_id").withColumn("url", F.lit(""))
    return sinks.text_report(members, ["month_key"], "Best clustering")


@query
def report_lines(spark, folder):
    members = _ranked(spark, folder).withColumnRenamed("paper_id", "doc_id").join(papers(spark, folder), "doc_id").withColumn("url", F.lit(""))
    lines = sinks.report_lines(members, ["month_key"], "Best clustering")
    return ranking.full_ranks(lines, ["month_key"], ["place"], "n").select("month_key", "n", "line")


def _month_papers(spark, folder):
    return papers(spark, folder).select("month_key", F.col("doc_id").alias("pos"), F.col("paper_id").alias("id"), "title", "summary", F.lit(None).cast("string").alias("ai_summary"))


@query
def month_lines(spark, folder):
    return ranking.full_ranks(sinks.month_lines(_month_papers(spark, folder)), ["month_key"], ["place"], "n").select("month_key", "n", "line")


@query
def month_text(spark, folder):
    own = _month_papers(spark, folder)
    return sinks.month_text(own).select("month_key", F.sha2(F.col("report").cast("binary"), 256).alias("sha256"), F.length("report").cast("bigint").alias("n_chars"))


@query
def prompt_render(spark, folder):
    rows = papers(spark, folder).select("doc_id", T.prompt("Sum up {{CLUSTER_JSON}} for {{INPUT_JSON}}.", CLUSTER_JSON=F.col("title"), INPUT_JSON=F.col("lang")).alias("prompt"))
    return rows.select("doc_id", "prompt", T.template_hash(F.col("prompt")).alias("digest"), T.token_estimate(F.col("prompt")).alias("tokens"))


@query
def run_id(spark, folder):
    rows = papers(spark, folder).select("doc_id", F.substring("month_key", 7, 7).alias("m"), "lang", T.template_hash(F.col("title")).alias("h"))
    return rows.select("doc_id", T.run_id(F.col("m"), F.lit("p0"), F.lit("enrich"), F.concat(F.lit("org/"), F.col("lang")), F.lit(0.2), F.col("h")).alias("run_id"))


# --- files written and read again -------------------------------------------------------------


def _bodies(spark, folder):
    """Responses in all right shapes and several wrong ones, each with the whole text of a document."""
    docs = table(spark, folder, "documents")
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("title"))
    right, own = F.to_json(item), F.col("doc_id") % 8
    body = F.when(own == 0, F.concat(F.lit('{"paper": [{"paper": '), right, F.lit("}]}"))).when(own == 1, F.concat(F.lit("["), right, F.lit(", "), right, F.lit("]")))
    body = body.when(own == 2, F.concat(F.lit('{"paper": ['), right)).when(own == 3, F.lit('{"other": 1}')).when(own == 4, F.concat(F.lit('[{"id": 5}, '), right, F.lit("]")))
    body = body.when(own == 5, F.concat(F.lit('[5, {"id": "x", "title": ["t"]}, {"paper": '), right, F.lit("}]"))).when(own == 6, F.lit(None)).otherwise(F.lit("[]"))
    return docs.select("doc_id", body.alias("body"))


@query
def checked_items(spark, folder):
    good, bad = sinks.write_checked(checked.responses(_bodies(spark, folder)), scratch_folder(spark, "items"))
    read = good.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.lit("").alias("fault"), F.col("paper.id").alias("id"), F.sha2(F.col("paper.title").cast("binary"), 256).alias("sha256"))
    return read.unionByName(bad.select("doc_id", F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"), "fault", F.lit("").alias("id"), F.when(F.col("fault") == "not JSON", F.lit("")).otherwise(F.regexp_replace("value", " ", "")).alias("sha256")))


@query
def payload_files(spark, folder):
    """Typed rows of payloads written as JSON lines and read back, faults among them counted."""
    path = scratch_folder(spark, "payloads")
    sinks.write_payload_rows(packing.typed_rows(_flat_payloads(spark, folder, False)), path)
    rows = checked.payload_rows(spark, path)
    return rows.groupBy("kind", "payload_id").agg(
        F.count("*").alias("n"), F.count("fault").alias("n_faults"), F.count_distinct(F.coalesce("papers.paper_id", "members.paper_id")).alias("n_papers"), F.sum(F.length("papers.summary")).cast("bigint").alias("n_chars"), r6(F.sum("clusters.cohesion")).alias("cohesion")
    )


@query
def month_files(spark, folder):
    """The lines of months written as files of at most 1,000 lines, and read back in order."""
    path = scratch_folder(spark, "months")
    sinks.write_lines(sinks.month_lines(_month_papers(spark, folder)), path, ["month_key"], lines_per_file=1000)
    return ranking.full_ranks(readers.text_lines(spark, path, ["month_key"]), ["month_key"], ["place"], "n").select("month_key", "n", "line")


@query
def memory_files(spark, folder):
    """The memory's members after the earlier and the later payloads, written as a version and read back."""
    path, tables = scratch_folder(spark, "memory"), readers.memory(spark, scratch_folder(spark, "none"))
    for later in (False, True):
        tables = memory.ingest(tables, {n: stored(rows) for n, rows in _flat_payloads(spark, folder, later).items()})
    return readers.memory_table(spark, sinks.write_memory({"cluster_member": tables["cluster_member"]}, path, "1"), "cluster_member").select("cluster_id", "paper_id", "rank_in_cluster", r6("sim_to_centroid").alias("sim_to_centroid"))


def _cards(spark, folder):
    """Rich cards from whole documents, with planted faults in fields that texts don't reach."""
    docs = papers(spark, folder).withColumn("words", F.array_distinct("keywords"))
    fault = lambda n: F.col("doc_id") % n == 0
    paper, text = F.col("paper_id"), F.coalesce("summary", F.lit(""))
    card = F.struct(
        F.concat(F.lit("cluster_index:"), "doc_id").alias("cluster_key"), F.col("title").alias("topic_name"), F.coalesce("title", F.lit("")).alias("one_liner"), F.coalesce("words", F.array().cast("array<string>")).alias("tags"),
        text.alias("what_this_cluster_is_about"), text.alias("why_it_matters"), F.when(fault(5), F.lit("HIGH")).otherwise(F.lit("low")).alias("confidence"), F.lit("few papers").alias("confidence_rationale"),
        F.when(~fault(7), F.array(F.struct(paper.alias("paper_id"), F.lit("t").alias("title"), F.when(~fault(11), F.lit("u")).alias("url"), F.lit("first").alias("reason_representative")))).alias("representative_papers"),
        F.array_repeat(F.struct(paper.alias("paper_id"), F.lit("u").alias("url"), F.lit("next").alias("why_read_next")), (F.col("doc_id") % 13).cast("int")).alias("reading_order"),
        F.lit("seed").alias("search_query_seed"), F.lit("").alias("notes"), F.when(fault(3), F.lit(1)).alias("score"), F.transform(F.sequence(F.lit(1), (2 + F.col("doc_id") % 9).cast("int")), lambda i: F.lit("h")).alias("cluster_highlights"),
    )
    report = F.struct(*[F.lit("x").alias(n) for n in ("snapshot_id", "cluster_run_id", "period_start", "period_end")], F.array(card).alias("cluster_cards"))
    return docs.select("doc_id", F.when(fault(17), F.lit("{")).otherwise(F.to_json(report)).alias("raw_text"))


@query
def card_faults(spark, folder):
    found = json_checks.checked(_cards(spark, folder), json_checks.RICH_CARDS)
    told = F.array_join(F.array_sort(F.transform("violations", lambda x: F.concat(F.regexp_replace(F.replace(x["path"], F.lit("$.cluster_cards[0]."), F.lit("")), r"^tags\[.*", "tags"), F.lit(" "), x["rule"]))), ",")
    return found.select("doc_id", F.size("violations").cast("bigint").alias("n"), told.alias("faults"))


# --- judging ----------------------------------------------------------------------------------


def _judged(spark, folder):
    return judging.judge(reports.flat_reports(table(spark, folder, "documents")))


@query
def judge_checks(spark, folder):
    judged = _judged(spark, folder)
    rule = lambda name, checks: F.coalesce(F.exists(checks, lambda x: (x["rule"] == name) & x["ok"]), F.lit(False)).alias(name)
    return judged.select("doc_id", "parsed", *[rule(n, F.col("hard_checks")) for n in judging.HARD], *[rule(n, F.col("soft_checks")) for n in judging.SOFT])


@query
def judge_overall(spark, folder):
    return _judged(spark, folder).select("doc_id", "parsed", "hard_valid", r6(F.col("soft_score")).alias("soft_score"), r6(F.col("overall")).alias("overall"))


@query
def invalid_citations(spark, folder):
    return _judged(spark, folder).select("doc_id", F.array_join("invalid_citations", ",").alias("bad"), judging.invalid_reason(F.col("invalid_citations")).alias("reason"))


def _board(spark, folder):
    rows = _judged(spark, folder).withColumn("run_id", F.col("lang")).withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")))
    return judging.leaderboard(rows, ["run_id", "model"], "doc_id")


@query
def model_leaderboard(spark, folder):
    return _board(spark, folder).select("run_id", "model", r6(F.col("overall")).alias("overall"), "n_reports", F.array_join(F.col("missing_report").cast("array<string>"), ",").alias("missing_report"), F.size("missing_response").cast("bigint").alias("n_missing_response"))


@query
def run_summary(spark, folder):
    found = judging.run_summary(_board(spark, folder), ["run_id"])
    return found.select("run_id", F.size("models").cast("bigint").alias("n_models"), F.array_join(F.transform("models", lambda m: m["model"]), ",").alias("order"))


@query
def evaluation_summary(spark, folder):
    docs = table(spark, folder, "documents")
    flat = reports.flat_reports(docs).withColumnRenamed("doc_id", "cluster_index")
    packed = flat.select("lang", "cluster_index", F.transform("input_ids", lambda i: F.struct(i.alias("paper_id"), F.lit("t").alias("title"))).alias("papers"))
    second = lambda more: F.timestamp_seconds(F.col("cluster_index") + more)
    responses = flat.select("lang", F.col("lang").alias("run_id"), F.concat(F.lit("m"), (F.col("cluster_index") % 3).cast("string")).alias("model"), "cluster_index", "raw_text", second(0).alias("started_at"), second(1 + F.col("cluster_index") % 7).alias("ended_at"))
    runs = docs.select(F.col("lang").alias("run_id")).distinct().select(
        "run_id", F.lit("hf|2025-01-01|2025-01-31").alias("snapshot_id"), F.lit("2025-01").alias("month"), F.lit("p0").alias("packing_variant"), F.lit("enrich").alias("prompt_variant"),
        F.concat(F.lit("Sum up in "), "run_id").alias("template"), F.array(*map(F.lit, ["m2", "org/none", "m0", "m1"])).alias("models"),
    )
    found = judging.full_summary(pipelines.evaluate(packed, responses, ["lang"])["judged"], runs)
    flat = found.select("*", F.posexplode("model_results").alias("pos", "m"))
    return flat.select(
        "run_id", "snapshot_id", "month", "packing_variant", "prompt_variant", "prompt_hash", F.array_join("models_evaluated", ",").alias("models"), F.col("pos").cast("bigint").alias("pos"), "m.model", r6(F.col("m.scores.overall")).alias("overall"),
        r6(F.col("m.duration")).alias("duration"), "m.parsed_output", F.array_join("m.missing_report", ",").alias("missing_report"), F.array_join("m.missing_response", ",").alias("missing_response"), "m.response_file", "m.error",
    )


@query
def section_rules(spark, folder):
    flat = reports.section_reports(table(spark, folder, "documents")).withColumnRenamed("doc_id", "cluster_id")
    paper = [F.struct(F.lit(i).alias("paper_id"), F.lit(r).cast("bigint").alias("rank_in_cluster")) for r, i in enumerate("abc")]
    clusters = flat.where("ranks IS NOT NULL").select("cluster_id", F.array(*paper).alias("papers"))
    return pipelines.evaluate_sections(clusters, flat.select("cluster_id", "raw_text"), None)["rules"].select("rule", r6(F.col("average")).alias("average"))


@query
def judge_rule_averages(spark, folder):
    return judging.rule_averages(_judged(spark, folder), ["lang"]).select("lang", "rule", r6(F.col("average")).alias("average"))


@query
def board_rollup(spark, folder):
    rows = _judged(spark, folder).withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")))
    found = topics.board(rows, ["lang", "model"])
    return found.select("lang", "model", *[r6(F.col(c)).alias(c) for c in ("mean_overall", "parse_failures", "hard_failures")], "n")


def _heuristic(spark, folder, shift=0):
    return judging.heuristic(reports.section_reports(table(spark, folder, "documents"), shift))


@query
def heuristic_score(spark, folder):
    return _heuristic(spark, folder).select("doc_id", "json_ok", "schema_ok", r6(F.col("overall")).alias("overall"))


@query
def rule_compare(spark, folder):
    found = judging.compare_rules(judging.rule_averages(_heuristic(spark, folder), []), judging.rule_averages(_heuristic(spark, folder, 1), []))
    return found.select("rule", *[r6(F.col(c)).alias(c) for c in ("before", "after", "change")])


# --- topics -----------------------------------------------------------------------------------


@query
def novelty(spark, folder):
    found = topics.novelty(_similar(spark, folder).withColumn("sim", F.round("sim", 9)), [])
    return found.select("paper_id", "label", r6(F.col("novelty")).alias("novelty"), "novelty_rank")


def _period_points(spark, folder):
    return points(spark, folder).withColumn("period", F.col("paper_id") % 4)


@query
def period_sizes(spark, folder):
    found = topics.period_sizes(_period_points(spark, folder), "period")
    return found.select("period", "n_clusters", "smallest", "largest", r6(F.col("mean_size")).alias("mean_size"))


@query
def period_drift(spark, folder):
    found = topics.drift(metrics.centroids(_period_points(spark, folder), ["period"]), "period")
    return found.select("period", "label", "previous_label", r6(F.col("drift")).alias("drift"))


@query
def topic_match(spark, folder):
    both = metrics.centroids(points(spark, folder).withColumn("half", F.col("paper_id") % 2), ["half"]).withColumn("embed_config_id", F.lit("e|1"))
    stored = both.where("half = 0").select(F.col("label").cast("string").alias("topic_id"), "embed_config_id", "direction", F.col("label").alias("depth"))
    return topics.match_topics(both.where("half = 1").select(F.col("label").alias("cluster_id"), "embed_config_id", "direction"), stored, 0.1).select(
        "cluster_id", "decision", "topic_id", r6(F.col("match_score")).alias("match_score"), "depth"
    )


@query
def unique_tags(spark, folder):
    found = topics.unique_tags(labelled_papers(spark, folder), ["lang"])
    return found.select("lang", r6(F.col("unique_share")).alias("unique_share"), "n_tags")


@query
def keyword_hints(spark, folder):
    found = topics.keyword_hints(labelled_papers(spark, folder), [])
    return found.select("label", "keyword", "tf", "df", r6(F.col("tfidf")).alias("tfidf"))


@query
def constrained_best(spark, folder):
    found = topics.constrained_best(_scores(spark, folder).withColumn("period", F.lit("all")), ["period"], -1.0)
    return found.select("period", "k", r6(F.col("avg_cohesion")).alias("avg_cohesion"))


@query
def confidence_bucket(spark, folder):
    found = metrics.cohesion(_similar(spark, folder), [])
    return found.select("label", pipelines.confidence(F.col("size"), F.round("cohesion", 9)).alias("confidence"))


@query
def rubric_score(spark, folder):
    rows = _judged(spark, folder).withColumn("schema", F.col("parsed")).withColumn("cited", F.size("invalid_citations") == 0)
    return topics.rubric(rows, {"soft_score": 0.7, "overall": 0.15}, ["schema", "cited"]).select("doc_id", r6(F.col("rubric")).alias("rubric"))


@query
def rich_pack(spark, folder):
    members = _ranked(spark, folder).withColumnRenamed("paper_id", "doc_id").join(papers(spark, folder), "doc_id")
    found = pipelines.rich_pack(members, [], cues=r"[0-9]", n=3)
    return found.select("label", "paper_id", "rank_in_cluster", "highlights")
