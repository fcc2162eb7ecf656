"""Groups and periods larger than a task: ranks by ranges, ordered writers, flat payloads, k-means starts."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from topicmill.operators import packing, ranking
from topicmill.plans import topics
from topicmill.sources import readers, sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ranks ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crowded(spark):
    """One label holds nearly all rows, others few; a null label; ties of similarity, and in them repeated ids."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, (F.col("id") % 7).cast("int")).when(F.col("id") % 997 == 1, F.lit(None).cast("int")).otherwise(F.lit(3)).alias("label"),
        (F.col("id") - F.col("id") % 3).alias("paper_id"), F.round(F.abs(F.sin(F.col("id") / 40)), 2).alias("sim"), F.lit("x").alias("rank_in_cluster"), F.lit(1).alias("_n"),
    )
    return rows


@pytest.mark.parametrize("parts", [1, 20])
def test_full_ranks_equal_a_window(spark, crowded, parts):
    found = ranking.member_rank(crowded.repartition(7), ["label"], parts=parts)
    assert "Window" not in plan_of(found)
    w = Window.partitionBy("label").orderBy(F.desc("sim"), "paper_id")
    wanted = crowded.withColumn("rank_in_cluster", (F.row_number().over(w) - 1).cast("bigint"))
    assert found.columns == ["label", "paper_id", "sim", "_n", "rank_in_cluster"]
    order = ["label", "rank_in_cluster", "paper_id", "sim"]
    assert found.select(order).orderBy(order).collect() == wanted.select(order).orderBy(order).collect()


def test_one_label_is_ranked_in_many_tasks(spark, crowded):
    one = crowded.where("label = 3").dropDuplicates(["paper_id"])
    found = topics.novelty(one, [], parts=20)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < one.count() / 5
    ranks = [r.novelty_rank for r in found.orderBy("sim", "paper_id").collect()]
    assert ranks == list(range(one.count()))
    assert found.limit(0).count() == 0 and ranking.full_ranks(one.limit(0), ["label"], ["sim"]).count() == 0
    assert sorted(r["rank"] for r in ranking.full_ranks(one.limit(50), [], ["sim"], parts=4).collect()) == list(range(50))


# --- reports ----------------------------------------------------------------------------------


def test_a_period_over_a_files_size_reads_back_in_order(spark, tmp_path):
    members = spark.range(3000).select(
        F.when(F.col("id") < 2900, F.lit("month=2025-01")).otherwise(F.lit("2025-02-01")).alias("month"), (F.col("id") % 3).cast("int").alias("label"), (F.col("id") / 3).cast("bigint").alias("rank_in_cluster"),
        F.concat(F.lit("p"), F.col("id")).alias("paper_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("T\r"), F.col("id"))).alias("title"), F.when(F.col("id") % 2 == 0, F.lit("two\nlines")).alias("summary"), F.lit("u").alias("url"),
    )
    lines = sinks.report_lines(members, ["month"], "Head")
    sinks.write_lines(lines, str(tmp_path / "r"), ["month"], parts=6, lines_per_file=400)
    files = sorted(p.name for p in (tmp_path / "r").rglob("part-*") if "2025-01" in str(p.parent) and "02-01" not in str(p.parent))
    assert len(files) > 20
    read = readers.text_lines(spark, str(tmp_path / "r"), ["month"])
    whole = {r["month"]: r["report"] for r in sinks.text_report(members, ["month"], "Head").collect()}
    for month in ("month=2025-01", "2025-02-01"):
        own = [r["line"] for r in read.where(F.col("month") == month).orderBy("place").collect()]
        assert "\n".join(own) + "\n" == whole[month]
    assert whole["2025-02-01"].startswith("\n" + "=" * 90 + "\nHead\n\n" + "-" * 90 + "\nCluster ")


def test_lines_of_odd_members(spark, tmp_path):
    rows = [(None, 1, 0, "a", None, None, None), ("m", None, 1, "b", "", "", ""), ("m", None, 0, "c", "t", "s", None), ("m", 2, None, None, "t", "s", "u"), ("m", 2, None, None, "t", "s", "u")]
    members = spark.createDataFrame(rows, "month string, label int, rank_in_cluster long, paper_id string, title string, summary string, url string")
    lines = sinks.report_lines(members, ["month"])
    sinks.write_lines(lines, str(tmp_path / "odd"), ["month"])
    read = readers.text_lines(spark, str(tmp_path / "odd"), ["month"])
    assert read.count() == lines.count() == 24 and lines.where("month IS NULL").count() == 5
    assert sinks.report_lines(members.limit(0), ["month"], "h").count() == 0 and sinks.month_lines(spark.createDataFrame([], "month_key string, pos int, id string, title string, summary string, ai_summary string")).count() == 0


# --- flat payloads ----------------------------------------------------------------------------


def nested_and_flat(spark, tmp_path):
    from tests.test_operators import load, payload
    from topicmill.operators import memory

    nested = load(spark, tmp_path, payload(), payload("k5", ("p2",)) | {"role": "other"})
    return nested, memory.flatten(nested)


def test_typed_rows_round_trip(spark, tmp_path):
    from topicmill.operators import packing

    _, flat = nested_and_flat(spark, tmp_path)
    sinks.write_payload_rows(packing.typed_rows(flat).repartition(5), str(tmp_path / "rows"))
    back = packing.flat_of(readers.payload_rows(spark, str(tmp_path / "rows")))
    for kind in flat:
        own = flat[kind].select(back[kind].columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, back[kind].collect())), kind
    with pytest.raises(Exception, match="unknown kind"):
        packing.flat_of(spark.createDataFrame([("x", "y")], "kind string, payload_id string").select("*", *[F.lit(None).cast("struct<a:int>").alias(k) for k in flat]))["papers"].collect()


def test_flat_payloads_ingest_like_nested_ones(spark, tmp_path):
    from topicmill.operators import memory
    from topicmill.sources.schemas import TABLES

    nested, flat = nested_and_flat(spark, tmp_path)
    empty = {n: spark.createDataFrame([], s) for n, (s, _) in TABLES.items()}
    at = F.lit("2025-03-01 00:00:00").cast("timestamp")
    one, other = memory.ingest(empty, nested, at), memory.ingest(empty, flat, at)
    again = memory.ingest(other, flat, at)
    for name in TABLES:
        assert sorted(map(str, one[name].collect())) == sorted(map(str, other[name].collect())) == sorted(map(str, again[name].collect())), name
    stray = flat | {"members": flat["members"].union(flat["members"].limit(1).withColumn("cluster_index", F.lit(77).cast("bigint")))}
    with pytest.raises(ValueError, match="member without cluster"):
        memory.ingest(empty, stray)


def test_a_monthly_run_is_ingested(spark):
    from topicmill.operators import memory
    from topicmill.plans import pipelines
    from topicmill.sources.schemas import TABLES

    rows = [(f"month=2025-0{1 + i % 2}", f"p{i}", f"T{i}.", "graph node edge" if i % 3 else "image pixel colour", ["graph"] if i % 3 else ["image"], "", "") for i in range(16)]
    papers = spark.createDataFrame(rows, "month_key string, paper_id string, title string, summary string, keywords array<string>, url string, published_at string")
    found = pipelines.run_monthly(papers, modes=("B",), ks=(2,), max_iter=5)
    tables = memory.ingest({n: spark.createDataFrame([], s) for n, (s, _) in TABLES.items()}, pipelines.monthly_payload(found["members"]))
    assert {n: tables[n].count() for n in ("embed_config", "cluster_config", "source_snapshot", "paper", "cluster_run", "cluster", "cluster_member")} == {
        "embed_config": 1, "cluster_config": 1, "source_snapshot": 2, "paper": 16, "cluster_run": 2, "cluster": 4, "cluster_member": 16
    }
    assert tables["cluster_config"].first()["json_payload"] == json.dumps({"k": 2}, separators=(",", ":"))
    assert sorted(r.period_end for r in tables["source_snapshot"].collect()) == ["2025-01-31", "2025-02-28"]
    assert tables["cluster"].agg(F.sum("size")).first()[0] == 16 and tables["cluster_member"].agg(F.min("rank_in_cluster")).first()[0] == 0


# --- k-means ----------------------------------------------------------------------------------


def brute_kmeans(rows, ks, hashes, uniforms, max_iter=300, together=4, tol=1e-4):
    """Labels of one group by (k, id): ``rows`` are (id, vector); ``hashes`` and ``uniforms`` by turn are those of the ids."""
    from topicmill.operators.clustering import weighted_centers

    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    apart = lambda c: np.square(x[:, None] - np.asarray(c)[None]).sum(axis=2)
    found = [x[min(range(len(ids)), key=lambda i: (hashes[ids[i]], ids[i]))]]
    for turn in range(3):
        d = apart(found).min(axis=1)
        keys = sorted((-np.log(uniforms[turn][ids[i]]) / d[i], ids[i], i) for i in range(len(ids)) if d[i] > 0)
        found += [x[i] for _, _, i in keys[: 2 * max(ks)]]
    found = np.array(found)
    weights = np.bincount(apart(found).argmin(axis=1), minlength=len(found)).astype(float)
    out = {}
    for k in ks:
        centers = weighted_centers(found, weights, k)
        for done in range(max_iter):
            label = apart(centers).argmin(axis=1)
            new = np.array([x[label == j].mean(axis=0) if (label == j).any() else centers[j] for j in range(k)])
            shift, centers = np.square(new - centers).sum(), new
            if (done + 1) % together == 0 and shift <= tol:
                break
        label = apart(centers).argmin(axis=1)
        out |= {(k, i): int(j) for i, j in zip(ids, label, strict=True)}
    return out


def test_kmeans_equals_numpy(spark):
    from topicmill.operators import clustering

    rng = np.random.default_rng(8)
    rows = [(g, int(100 * g + i), (rng.normal(size=5) + 3 * (i % 4)).round(3).tolist()) for g in (1, 2) for i in range(90)]
    rows += [(3, 900 + i, [1.0] * 5) for i in range(6)] + [(3, 950, [2.0] * 5)]
    df = spark.createDataFrame(rows, "g int, paper_id long, embedding array<double>")
    hashed = df.select("paper_id", F.xxhash64("paper_id", F.lit(42)).alias("h"), *[clustering.uniform(43 + t).alias(f"u{t}") for t in range(3)]).toPandas()
    hashes, uniforms = dict(zip(hashed.paper_id, hashed.h, strict=True)), [dict(zip(hashed.paper_id, hashed[f"u{t}"], strict=True)) for t in range(3)]
    found = clustering.kmeans_groups(df.repartition(9), ["g"], [2, 4])
    for g in (1, 2, 3):
        wanted = brute_kmeans([r[1:] for r in rows if r[0] == g], [2, 4], hashes, uniforms)
        assert {(r.k, r.paper_id): r.label for r in found.where(F.col("g") == g).collect()} == wanted


def test_starts_take_few_passes(spark, monkeypatch):
    from topicmill.operators import clustering

    count, kept = [], clustering.checkpointed
    monkeypatch.setattr(clustering, "checkpointed", lambda df: count.append(1) or kept(df))
    df = spark.range(4000).select(F.lit("all").alias("g"), F.col("id").alias("paper_id"), F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("embedding"))
    starts = clustering.first_centers(df, ["g"], [40], seed=1).first()["centers"]
    assert len(count) == 4 and len(starts) == 40 and len({tuple(c["centroid"]) for c in starts}) == 40
    far = clustering.assign(clustering.metrics.as_double(df), clustering.first_centers(df, ["g"], [40]).select("g", "k", "centers"), ["g"])
    one = clustering.assign(clustering.metrics.as_double(df), clustering.first_centers(df, ["g"], [1]).select("g", "k", "centers"), ["g"])
    assert far.agg(F.sum("d")).first()[0] < one.agg(F.sum("d")).first()[0] / 10


# --- topics -----------------------------------------------------------------------------------


def test_topic_match_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 8))
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    topics_ = [(f"t{i:04d}", "a" if i % 20 else "b", unit(middles[i % 30] + rng.normal(size=8) / 10), i % 5) for i in range(1500)]
    topics_ += [("t9998", "a", topics_[3][2], 7), ("t9999", "a", topics_[3][2], 8), ("zero", "a", [0.0] * 8, 0)]
    clusters = [(i, "a" if i % 9 else "b", unit(middles[i % 30] + rng.normal(size=8) / 10)) for i in range(120)] + [(200, "a", topics_[3][2]), (201, "none", topics_[3][2]), (202, "a", [0.0] * 8)]
    given = spark.createDataFrame(clusters, "cluster_id int, embed_config_id string, direction array<double>"), spark.createDataFrame(topics_, "topic_id string, embed_config_id string, direction array<double>, depth int")
    found = {r.cluster_id: r for r in topics.nearest_topics(*given, pivots=30, block=16).collect()}
    assert len(found) == len(clusters)
    pairs = 0
    for i, config, v in clusters:
        own = [t for t in topics_ if t[1] == config]
        pairs += len(own)
        if not own:
            assert found[i].best is None and found[i].scored == 0
            continue
        scores = [float(np.dot(v, t[2])) for t in own]
        assert found[i].best.score == pytest.approx(max(scores), abs=1e-12)
        assert found[i].best.topic_id in {t[0] for t, s in zip(own, scores, strict=True) if s > max(scores) - 1e-12}
    assert found[200].best.topic_id == "t9999"
    assert sum(r.scored for r in found.values()) < pairs / 3
    decided = {r.cluster_id: r for r in topics.match_topics(*given, 0.5, pivots=3).collect()}
    assert decided[201].decision == "new" and decided[201].depth == 0 and decided[200].decision == "attach" and decided[200].depth == 9
    assert topics.match_topics(given[0].limit(0), given[1], 0.5).count() == 0 and topics.match_topics(given[0], given[1].limit(0), 0.5).where("decision = 'new'").count() == len(clusters)


# --- evaluation -------------------------------------------------------------------------------


def test_evaluation_is_written_with_counts_and_summary(spark, tmp_path):
    from tests.test_operators import report
    from topicmill.plans import pipelines

    packed = spark.createDataFrame([(c, [("p1", "t")]) for c in (0, 1)], "cluster_index int, papers array<struct<paper_id:string,title:string>>").withColumn("g", F.lit(1))
    rows = [("r1", "m", 0, report(), 10, 12), ("r1", "m", 1, "{", 11, 15), ("r1", "n", 0, None, None, None), ("r2", "m", 0, None, 5, 6), ("r2", "other", 0, report(), 5, 6)]
    given = spark.createDataFrame(rows, "run_id string, model string, cluster_index int, raw_text string, s int, e int").select("*", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("ended_at")).withColumn("g", F.lit(1))
    runs = spark.createDataFrame([(r, "hf|a|b", "2025-01", "p0", "v1", "Sum {{CLUSTER_JSON}}", models) for r, models in (("r1", ["n", "m"]), ("r2", ["m", "none"]), ("r3", []))], "run_id string, snapshot_id string, month string, packing_variant string, prompt_variant string, template string, models array<string>")
    for _ in range(2):  # again: each run replaces itself
        out = pipelines.write_evaluation(packed, given, runs, ["g"], str(tmp_path / "runs"))
        assert out["counts"]["n"] == 5 and out["counts"]["failed"] == 2 and out["counts"]["parsed"] == 2
        assert set(out["seconds"]) == {"judged", "summary"} and out["judged"].count() == 5
        found = {r.run_id: r for r in out["summary"].collect()}
        assert set(found) == {"r1", "r2", "r3"} and found["r3"].model_results == [] and found["r3"].models_evaluated == []
        n, m = found["r1"].model_results
        assert (n.model, n.parsed_output, n.duration, n.missing_report, n.missing_response, n.error) == ("n", False, 0.0, [0], [0], None)
        assert (m.model, m.parsed_output, m.duration, m.missing_report, m.missing_response, m.response_file) == ("m", True, 5.0, [1], [], "responses/m.json")
        assert m.scores.overall == out["judged"].where("run_id = 'r1' AND model = 'm' AND parsed").agg(F.avg("overall")).first()[0]
        assert [x.error for x in found["r2"].model_results] == [None, "no responses"] and len(found["r1"].prompt_hash) == 16
        assert (found["r1"].snapshot_id, found["r1"].month, found["r1"].packing_variant, found["r1"].prompt_variant) == ("hf|a|b", "2025-01", "p0", "v1") and found["r1"].timestamp


def test_payload_queries_gather_no_texts(spark, monkeypatch):
    """unify_clusters and payload_json once held all texts of a month in one row."""
    from tests.helpers import DATA
    from topicmill.plans.queries import QUERIES

    for name in ("unify_clusters", "payload_json"):
        lists = [line for line in plan_of(QUERIES[name](spark, DATA)).split("\n") if "collect_list" in line]
        assert not any("summary" in line or "title" in line for line in lists), name


@pytest.mark.parametrize("parts", [1, 9])
def test_unified_rows_equal_the_nested_form(spark, parts):
    payload = spark.createDataFrame([("a", "hf", "1", "2"), ("b", "hf", "3", "4")], "payload_id string, source string, period_start string, period_end string")
    papers = spark.createDataFrame([("a", k, f"p{k % 40}", f"t{k}", f"s{k}", ["x"]) for k in range(50)] + [("b", 0, "p1", "other", None, None)], "payload_id string, pos long, paper_id string, title string, summary string, keywords array<string>")
    members = spark.createDataFrame([("a", k % 3, f"p{k}", k) for k in range(60)] + [("b", 0, "p1", 3), ("b", 0, "p2", 4), ("b", 1, "zz", 0)], "payload_id string, cluster_index long, paper_id string, rank_in_cluster long")
    flat = {"payload": payload, "papers": papers.repartition(parts), "members": members.repartition(parts)}
    listed = papers.groupBy("payload_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paper_id", "title", "summary", "keywords"))), lambda p: p.dropFields("pos")).alias("papers"))
    one = members.groupBy("payload_id", "cluster_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_cluster", "paper_id"))), lambda m: F.struct(m["paper_id"].alias("paper_id"), m["rank_in_cluster"].alias("rank_in_cluster"))).alias("members"))
    nested = payload.join(listed, "payload_id").join(one.groupBy("payload_id").agg(F.collect_list(F.struct("cluster_index", "members")).alias("clusters")), "payload_id")
    wanted = packing.unify(nested).select("cluster_id", F.posexplode("papers").alias("pos", "p")).select("cluster_id", "pos", "p.*")
    assert sorted(map(str, packing.unify_rows(flat).collect())) == sorted(map(str, wanted.collect())) and wanted.count() > 30
