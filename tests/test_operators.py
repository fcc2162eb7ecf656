import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicmill.functions import text as T
from topicmill.operators import clustering, judging, memory, metrics, packing, ranking
from topicmill.plans import pipelines, topics
from topicmill.sources import readers, sinks
from topicmill.sources.schemas import TABLES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(v):
    return F.lit(v)


def test_dates_keep_the_day_as_written(spark):
    assert one(spark, T.iso_date(lit("2025-01-22T23:30:00-05:00"))) == "2025-01-22"
    assert one(spark, T.iso_date(lit("soon"))) == "" and one(spark, T.iso_date(lit(None).cast("string"))) == ""
    assert one(spark, T.is_date(lit("2025-01-01"))) and not one(spark, T.is_date(lit("2025-13-01"))) and not one(spark, T.is_date(lit("2025/01/01")))


def test_period_bounds(spark):
    first, last = T.period_bounds(lit("month=2024-02"))
    assert (one(spark, first), one(spark, last)) == ("2024-02-01", "2024-02-29")
    with pytest.raises(Exception, match="bad month key"):
        one(spark, T.period_bounds(lit("2024-02"))[0])


def test_embedding_text(spark):
    words = F.array(*map(F.lit, ["k1", "k2", "k3"]))
    assert one(spark, T.embedding_text(lit("t"), lit("s\n"), words, "A")) == "TITLE: t\nSUMMARY: s"
    assert one(spark, T.embedding_text(lit("t"), lit("s"), words, "B", 2)).endswith("KEYWORDS: k1, k2")
    assert one(spark, T.embedding_text(lit("t"), lit("s"), words, "C")).endswith("KEYWORDS: k1, k2, k3")
    with pytest.raises(ValueError):
        T.embedding_text(lit("t"), lit("s"), words, "D")


@pytest.mark.parametrize("n", [350, 351])
def test_truncate(spark, n):
    got = one(spark, T.truncate(lit(" " + "x" * n + "\n")))
    assert got == ("x" * 350 + "…" if n > 350 else "x" * 350)


@pytest.mark.parametrize(("title", "good"), [("Deep Learning of the World", True), ("deep Learning", False), ("Deep learning", False), ("A View: B", False), ("", False), ("A The B", False), ("3D Models", False)])
def test_title_case(spark, title, good):
    assert one(spark, T.title_case(lit(title))) is good


@pytest.mark.parametrize("title", ["Deep Learning 3D", "Deep Learning 3d", "Don't Stop", "Don'T Stop", "ABC", "A B", "a B", ""])
def test_strict_title_case_is_pythons(spark, title):
    assert one(spark, T.title_case_strict(lit(title))) is (title == title.title())


def test_short_links_are_read_from_their_text(spark):
    page = '<a href="https://arxiv.org/abs/2512.23705">x</a><a href="https://t.co/ab"><b>https://arxiv.org/</b>abs/2512. 11111...</a><a href="https://arxiv.org/abs/2512.23705">again</a><a href="/local">y</a>'
    assert one(spark, T.links(lit(page), T.PAPER_LINK)) == ["https://arxiv.org/abs/2512.23705", "https://arxiv.org/abs/2512.11111"]


def test_links_without_scheme_are_rebuilt(spark):
    page = '<a href="https://t.co/ab">huggingface.co/papers/x/2512.<span>23705</span>...</a><a href="https://t.co/cd">nothing here</a>'
    assert one(spark, T.links(lit(page), T.PAPER_LINK, T.PARTIAL_LINK)) == ["https://huggingface.co/papers/2512.23705"]


def test_responses_of_all_shapes(spark):
    bodies = ['{"paper": [{"paper": {"id": "1"}}, {"id": "2"}]}', '[{"id": "3"}]', '{"other": 1}', "broken"]
    found = readers.item_fields(readers.responses(spark.createDataFrame([(b,) for b in bodies], "body string")))
    assert sorted(r["id"] for r in found.collect()) == ["1", "2", "3"]


def test_cluster_lists(spark):
    frame = lambda *b: spark.createDataFrame([(x,) for x in b], "body string")
    assert readers.cluster_lists(frame('[{"a": 1}, {"a": 2}]', '{"clusters": [{"a": 3}]}')).count() == 3
    with pytest.raises(Exception, match="expected a list"):
        readers.cluster_lists(frame('{"x": 1}')).collect()


def test_month_dump_and_text(spark, tmp_path):
    dump = {"papers": {"month=2025-01": [{"paper": {"id": "a", "title": "T", "publishedAt": "2025-01-22T23:30:00-05:00"}}], "month=2025-02": []}}
    (tmp_path / "d.json").write_text(json.dumps(dump))
    papers = readers.normal_papers(readers.month_dump(spark, str(tmp_path / "d.json"), "month=2025-01")).collect()
    assert [(p["pid"], p["keywords"], p["published_at"]) for p in papers] == [("a", [], "2025-01-22")]
    with pytest.raises(ValueError):
        readers.month_dump(spark, str(tmp_path / "d.json"), "month=2025-03")
    flat = readers.month_dump(spark, str(tmp_path / "d.json")).select("month_key", "pos", "paper.*")
    assert "id: a" in sinks.month_text(flat).first()["report"] and "summary: N/A" in sinks.month_text(flat).first()["report"]


def make_points(spark, rows):
    return spark.createDataFrame(rows, "g int, paper_id int, label int, embedding array<double>")


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x, labels = rng.standard_normal((30, 4)), np.array([*([0] * 12), *([1] * 17), 2])
    df = make_points(spark, [(g, i, int(labels[i]), x[i].tolist()) for g in (0, 1) for i in range(30)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, s = 1 - u @ u.T, []
    for i in range(30):
        own = (labels == labels[i]) & (np.arange(30) != i)
        a, b = (d[i][own].mean() if own.any() else None), min(d[i][labels == c].mean() for c in set(labels) - {labels[i]})
        s.append(0 if a is None else (b - a) / max(a, b))
    got = {r["g"]: r["silhouette"] for r in metrics.silhouette(df, ["g"]).collect()}
    assert math.isclose(got[0], np.mean(s), rel_tol=1e-9) and math.isclose(got[1], got[0])
    c = np.array([x[labels == k].mean(axis=0) for k in range(3)])
    spread = [np.linalg.norm(x[labels == k] - c[k], axis=1).mean() for k in range(3)]
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert math.isclose(metrics.davies_bouldin(df, ["g"]).first()["davies_bouldin"], db, rel_tol=1e-9)
    w = sum(((x[labels == k] - c[k]) ** 2).sum() for k in range(3))
    b = sum((labels == k).sum() * ((c[k] - x.mean(axis=0)) ** 2).sum() for k in range(3))
    assert math.isclose(metrics.calinski_harabasz(df, ["g"]).first()["calinski_harabasz"], (b / 2) / (w / 27), rel_tol=1e-9)


def test_metrics_of_odd_clusterings(spark):
    single = make_points(spark, [(0, 0, 0, [1.0, 0.0]), (0, 1, 0, [0.0, 1.0])])
    assert all(math.isnan(f(single, ["g"]).first()[1]) for f in (metrics.silhouette, metrics.davies_bouldin, metrics.calinski_harabasz))
    alone = make_points(spark, [(0, 0, 0, [1.0, 0.0]), (0, 1, 1, [0.0, 1.0])])
    assert math.isnan(metrics.silhouette(alone, ["g"]).first()[1]) and metrics.davies_bouldin(alone, ["g"]).first()[1] == 0
    same = make_points(spark, [(0, i, i % 2, [1.0, 0.0]) for i in range(4)])
    assert metrics.davies_bouldin(same, ["g"]).first()[1] == 0 and metrics.calinski_harabasz(same, ["g"]).first()[1] == 1
    words = spark.createDataFrame([(0, ["a", "b", " A "]), (1, [])], "label int, keywords array<string>")
    found = {r["label"]: r["entropy"] for r in metrics.keyword_entropy(words, []).collect()}
    assert math.isclose(found[0], -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)), rel_tol=1e-9) and math.isnan(found[1])


def test_kmeans_settles_and_is_repeatable(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, 0, (rng.standard_normal(3) * 0.1 + 5 * np.eye(3)[i % 3]).tolist()) for g in (0, 1) for i in range(30)]
    df = make_points(spark, rows).drop("label")
    found = clustering.kmeans_groups(df, ["g"], [2, 3], max_iter=10)
    again = clustering.kmeans_groups(df.repartition(7), ["g"], [2, 3], max_iter=10)
    key = lambda d: sorted((r["g"], r["k"], r["paper_id"], r["label"]) for r in d.collect())
    assert key(found) == key(again)
    three = [r for r in found.where("k = 3 AND g = 0").collect()]
    assert len({(r["label"], r["paper_id"] % 3) for r in three}) == 3
    with pytest.raises(ValueError, match="exceeds"):
        clustering.kmeans_groups(df.where("paper_id < 2"), ["g"], [3])


def test_ranks(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.9)], "label int, paper_id int, sim double")
    assert [(r["paper_id"], r["rank_in_cluster"]) for r in ranking.member_rank(df, ["label"]).orderBy("rank_in_cluster").collect()] == [(3, 0), (1, 1), (2, 2)]
    ranks = F.create_map(lit("a"), lit(0), lit("b"), lit(1))
    assert one(spark, ranking.ranks_rise(F.array(lit("a")), ranks)) and one(spark, ranking.ranks_rise(F.array(lit("a"), lit("zz")), ranks)) and not one(spark, ranking.ranks_rise(F.array(lit("b"), lit("a")), ranks))


def payload(config="k4", members=("p1", "p2"), index=(0,)):
    papers = [{"paper_id": p, "title": t, "summary": "", "keywords": [], "url": "", "published_at": None} for p, t in (("p1", "old"), ("p2", "b"), ("p1", "new"))]
    clusters = [{"cluster_index": i, "size": len(members), "centroid": None, "cohesion": 0.5, "members": [{"paper_id": m, "rank_in_cluster": k, "sim_to_centroid": 0.1} for k, m in enumerate(members)]} for i in index]
    return {"source": "hf", "period_start": "2025-01-01", "period_end": "2025-01-31", "embed_config": {"embed_config_id": "e", "json_payload": "{}"}, "cluster_config": {"cluster_config_id": config, "json_payload": "{}"}, "papers": papers, "clusters": clusters}


def load(spark, tmp_path, *payloads):
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, payloads)))
    from topicmill.sources.schemas import PAYLOAD

    return spark.read.schema(PAYLOAD).json(str(tmp_path / "p.json"))


def test_ingest_twice_and_best_run(spark, tmp_path):
    empty = {n: spark.createDataFrame([], s) for n, (s, _) in TABLES.items()}
    once = memory.ingest(empty, load(spark, tmp_path, payload()))
    once = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in once.items()}
    twice = memory.ingest(once, load(spark, tmp_path, payload()))
    assert {n: twice[n].count() for n in ("paper", "snapshot_paper", "cluster_run", "cluster", "cluster_member")} == {"paper": 2, "snapshot_paper": 2, "cluster_run": 1, "cluster": 1, "cluster_member": 2}
    assert twice["paper"].where("paper_id = 'p1'").first()["title"] == "new"
    assert twice["paper"].select("ingested_at").first() == once["paper"].select("ingested_at").first()
    other = memory.ingest(twice, load(spark, tmp_path, payload("k5", ("p2",))))
    assert {r["cluster_config_id"]: r["selected_best"] for r in other["cluster_run"].collect()} == {"k4": False, "k5": True}
    card = memory.best_run(other, "hf", "2025-01-01", "2025-01-31", 1).first()
    assert card["cluster_config_id"] == "k5" and [p["paper_id"] for p in card["clusters"][0]["papers"]] == ["p2"]
    with pytest.raises(ValueError):
        memory.best_run(other, "hf", "2024-01-01", "2024-01-31")
    sinks.write_memory(other, str(tmp_path / "m"), "1")
    assert readers.memory(spark, str(tmp_path / "m" / "1"))["paper"].count() == 2 and readers.memory_table(spark, str(tmp_path / "none"), "paper").count() == 0


@pytest.mark.parametrize("bad", [payload(members=("zz",)), payload(index=(0, 0))])
def test_ingest_refuses_faults(spark, tmp_path, bad):
    empty = {n: spark.createDataFrame([], s) for n, (s, _) in TABLES.items()}
    with pytest.raises(ValueError):
        memory.ingest(empty, load(spark, tmp_path, bad))


def test_streamed_payloads(spark, tmp_path):
    from topicmill.streaming.ingest import follow_payloads

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(payload()))
    run = follow_payloads(spark, str(tmp_path / "in"), str(tmp_path / "memory"), str(tmp_path / "cp"))
    run.awaitTermination(120)
    assert readers.memory(spark, str(tmp_path / "memory" / "1"))["paper"].count() == 2


def test_pack_keeps_empty_clusters_and_unify_drops_them(spark, tmp_path):
    members = spark.createDataFrame([(0, 0, "p1", None, 0.1), (0, 1, "zz", 0, 0.2), (0, 2, "", 1, 0.2), (1, 0, "zz", 0, 0.3)], "cluster_index long, seq long, paper_id string, rank_in_cluster long, sim_to_centroid double").withColumn("g", lit(0))
    papers = spark.createDataFrame([(0, "p1", "old", 0), (0, "p1", "new", 1)], "g int, paper_id string, title string, pos long").withColumns({"summary": lit(None).cast("string"), "keywords": lit(None).cast("array<string>"), "url": lit(None).cast("string")})
    packed = {r["cluster_index"]: r["papers"] for r in packing.pack(members, papers, ["g"]).collect()}
    assert [p["title"] for p in packed[0]] == ["new"] and packed[0][0]["rank_in_cluster"] == 0 and packed[1] == []
    assert packing.pack_warnings(members, papers, ["g"]).count() == 3
    assert [r["cluster_id"] for r in packing.unify(load(spark, tmp_path, payload(index=(0,)), payload(members=("zz",), index=(1,)))).collect()] == ["hf|2025-01-01|2025-01-31|0"]


def report(**changes):
    words = lambda n: " ".join(["word"] * n)
    base = {
        "title": "Deep Topic Models", "one_liner": words(25), "what_this_cluster_is_about": words(100) + " [p1]", "why_it_matters": words(60), "confidence": "HIGH",
        "confidence_rationale": [words(18), "b"], "representative_papers": [{"paper_id": "p1", "title": "t"}, {"paper_id": "p2", "title": "u"}],
        "reading_order": [{"paper_id": p, "why_read_now": words(12)} for p in ("p1", "p2", "p1")], "search_query_seed": "a b", "notes": [], "keyword_list": ["a", "b", "c", "d", "e"], "extra": 1,
    }
    return json.dumps(base | changes)


W = lambda n: " ".join(["w"] * n)
CASES = [
    (report(), 2.0), (report(title="Deep " + " ".join(["Word"] * 12)), 1 + 10 / 11), (report(one_liner=W(26)), 1 + 10 / 11), (report(why_it_matters=W(121)), 1 + 10 / 11),
    (report(what_this_cluster_is_about=W(78) + " [p1]"), 1 + 10 / 11), (report(search_query_seed="a"), 1 + 10 / 11), (report(search_query_seed="a\nb"), 1 + 10 / 11), (report(notes=[W(21)]), 1 + 10 / 11),
    (report(keyword_list=["a", "A", "c", "d", "e"]), 1 + 10 / 11), (report(title="AI"), 1 + 10 / 11), (report(confidence_rationale=["a", W(19)]), 1 + 10 / 11),
    (report(title="a lower title"), 0), (report(what_this_cluster_is_about=W(100)), 0), (report(keyword_list=["#a", "b", "c", "d", "e"]), 0), (report(keyword_list=[" ", "b", "c", "d", "e"]), 0),
    (report(title=None), 0), (report(title=5), 0), (report(confidence="SURE"), 0), (report(notes=["x"] * 6), 0), (report(keyword_list=["a"] * 4), 0), ("```json\n" + report() + "\n```", 0), ("{", 0),
    (report(representative_papers=[{"paper_id": "zz", "title": "t"}, {"paper_id": "p2", "title": "u"}]), 0), (report(representative_papers=[{"paper_id": 1, "title": "t"}, {"paper_id": "p2", "title": "u"}]), 0),
]


def test_judge_cases(spark):
    df = spark.createDataFrame([(i, text, ["p1", "p2"]) for i, (text, _) in enumerate(CASES)], "i int, raw_text string, input_ids array<string>")
    got = {r["i"]: r for r in judging.judge(df).collect()}
    for i, (_, overall) in enumerate(CASES):
        assert math.isclose(got[i]["overall"], overall, abs_tol=1e-9), (i, CASES[i][0][:80], got[i]["reasons"])
    assert got[2]["reasons"]["soft_schema_valid"] == "one_liner: one_liner has 26 words, allowed are 1 to 25"
    assert got[10]["reasons"]["soft_schema_valid"] == "confidence_rationale: confidence_rationale[1] has 19 words, allowed are 18"
    assert got[len(CASES) - 2]["reasons"]["hard_schema_valid"].startswith("Invalid citations: zz")


@pytest.mark.parametrize(("n", "score"), [(0, 0), (1, 0.5), (2, 1), (4, 1), (5, 0.5), (6, 0)])
def test_cross_links(spark, n, score):
    assert one(spark, judging.cross_links(lit(" ".join(["See [a] and [b]."] * n + ["Only [a]."])))) == score


def test_leaderboard_counts_parsed_reports_only(spark):
    df = spark.createDataFrame([("m", 0, "x", True, 1.5), ("m", 1, "y", False, 0.0), ("m", 2, None, False, 0.0), ("n", 0, "z", False, 0.0)], "model string, cluster_index int, raw_text string, parsed boolean, overall double")
    got = {r["model"]: r for r in judging.leaderboard(df, ["model"]).collect()}
    assert got["m"]["overall"] == 1.5 and got["m"]["missing_report"] == [1, 2] and got["m"]["missing_response"] == [2] and got["n"]["overall"] == 0


def test_monthly_run(spark):
    rows = [("month=2025-01", f"p{i}", f"T{i}.", "graph node edge" if i % 2 else "image pixel colour", ["graph"] if i % 2 else ["image"], "", "") for i in range(12)]
    papers = spark.createDataFrame(rows, "month_key string, paper_id string, title string, summary string, keywords array<string>, url string, published_at string")
    found = pipelines.run_monthly(papers, modes=("A", "B"), ks=(2, 3), max_iter=5)
    assert found["scores"].count() == 4 and found["best"].count() == 1
    members = found["members"].collect()
    assert len(members) == 12 and found["payloads"].count() == 1 and "Cluster" in found["reports"].first()["report"]


def test_evaluate_runs(spark):
    packed = spark.createDataFrame([(0, [("p1", "t")])], "cluster_index int, papers array<struct<paper_id:string,title:string>>").withColumn("g", lit(1))
    assert set(pipelines.evaluate(packed, None, ["g"], dry_run=True)) == {"prompts"}
    responses = spark.createDataFrame([("r", "m", 0, report()), ("r", "n", 0, None)], "run_id string, model string, cluster_index int, raw_text string").withColumn("g", lit(1))
    found = pipelines.evaluate(packed, responses, ["g"])
    assert found["leaderboard"].count() == 2 and found["summary"].count() == 1


def test_topics_rubric_and_cards(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False)], "a double, ok boolean")
    assert sorted(r["rubric"] for r in topics.rubric(df, {"a": 2.0}, ["ok"]).collect()) == [0.0, 1.0]
    cards = spark.createDataFrame([(0, "T", 1, 0.5, [("p", "x")])], "label int, title string, size int, cohesion double, papers array<struct<paper_id:string,title:string>>")
    assert "- [p] x" in topics.markdown_cards(cards).first()["card"]
