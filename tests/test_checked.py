"""Model encoders, readers that keep bad input, and checks generated from JSON schemas."""

import copy
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicmill.functions import encoders
from topicmill.operators import json_checks
from topicmill.sources import checked, readers, sinks

TEXTS = ["Deep topics, deep models", "", None, "Über 3 Modelle", "deep", "x " * 3000]


def plain_vectors(texts, dims):
    """The term model by plain Python, a text at a time."""
    import re

    terms = [re.findall(encoders.TERM, (t or "").translate(str.maketrans(*encoders.A_Z))) for t in texts]
    n, out = len(texts), np.zeros((len(texts), dims))
    where = [{encoders.term_digest(t)[0] for t in row} for row in terms]
    for i, row in enumerate(terms):
        for t in row:
            bucket, bits = encoders.term_digest(t)
            weight = np.log((1 + n) / (1 + sum(bucket in w for w in where))) + 1
            out[i] += [weight * (-1 if bits >> p & 1 else 1) for p in range(dims)]
        out[i] /= np.linalg.norm(out[i]) + 1e-12
    return out


@pytest.mark.parametrize("batch_size", [1, 4, 1000])
def test_model_vectors_equal_numpy_at_any_batch_size(spark, batch_size):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(2)
    encode = encoders.model_encoder(encoders.term_model(encoders.fit_term_weights(docs), 16), batch_size, precise=True)
    found = {r["doc_id"]: r["embedding"] for r in encode(docs).collect()}
    assert np.allclose([found[i] for i in range(len(TEXTS))], plain_vectors(TEXTS, 16), atol=1e-12)
    assert encoders.model_encoder(encoders.term_model(np.ones(encoders.BUCKETS)))(docs).schema["embedding"].dataType.simpleString() == "array<float>"


def test_terms_are_counted_before_vectors_are_summed(monkeypatch):
    """A text's repeated terms were looked up and added one by one."""
    asked, digest = [], encoders.term_digest
    monkeypatch.setattr(encoders, "term_digest", lambda term: asked.append(term) or digest(term))
    monkeypatch.setattr(encoders, "KNOWN", 2)
    texts = ["a B b É é a_a " * 500, "", "A b c d"] * 2
    got = encoders.term_model(np.ones(encoders.BUCKETS), 8)()(np.array(texts, object))
    signs = lambda t: 1 - 2 * ((digest(t)[1] >> np.arange(8)) & 1)
    one = sum(signs(t) * n for t, n in (("a", 1500), ("b", 1000), ("É", 500), ("é", 500)))
    assert np.array_equal(got[0], one) and np.array_equal(got[3], one) and not got[1].any() and len(asked) < 40


def test_a_model_is_loaded_once_a_worker_and_called_in_batches(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def predict(texts):
            open(f"{folder}/call-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return np.ones((len(texts), 2))

        return predict

    rows = spark.range(400).select("id", F.lit("t").alias("text")).repartition(8)
    encode = encoders.model_encoder(load, batch_size=7)
    assert encode(rows).where(F.abs(F.col("embedding")[0] - 0.5**0.5) < 1e-6).count() == 400
    names = os.listdir(folder)
    loads = [n.split("-")[1] for n in names if n.startswith("load")]
    calls = [int(n.split("-")[1]) for n in names if n.startswith("call")]
    assert len(loads) == len(set(loads)) and max(calls) <= 7 and sum(calls) >= 400


def test_an_encoder_serves_the_monthly_run(spark):
    from topicmill.plans import pipelines

    papers = spark.createDataFrame([("p", "t", "s", ["k"])], "paper_id string, title string, summary string, keywords array<string>")
    found = pipelines.encode_papers(papers, ["A", "C"], encoder=encoders.model_encoder(encoders.term_model(np.ones(encoders.BUCKETS)))).collect()
    assert sorted(r["mode"] for r in found) == ["A", "C"] and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in found)


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, body in files.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(body if isinstance(body, str) else json.dumps(body))
    return str(folder)


def test_dumps_keep_what_is_broken_beside_the_good(spark, tmp_path):
    paper = lambda i, **more: {"paper": {"id": i, "title": f"t{i}", "ai_keywords": ["k"]} | more}
    path = write(tmp_path / "in", {
        "good.json": {"papers": {"month=2025-01": [paper("a"), paper("b")], "month=2025-02": []}},
        "mixed.json": {"papers": {"month=2025-03": [paper("c"), 7, {"other": 1}, paper(5), paper("d", title=["x"]), paper("e", ai_keywords=[1]), paper("f", summary=None)], "month=2025-04": {"no": "list"}}},
        "broken.json": '{"papers": {', "empty.json": "", "list.json": [1],
    })
    rows = checked.dumps(spark, path)
    good, bad = sinks.write_checked(rows, str(tmp_path / "out"))
    assert sorted((r["file"], r["month_key"], r["pos"], r["paper"]["id"], r["paper"]["title"]) for r in good.collect()) == [
        ("good.json", "month=2025-01", 0, "a", "ta"), ("good.json", "month=2025-01", 1, "b", "tb"), ("mixed.json", "month=2025-03", 0, "c", "tc"), ("mixed.json", "month=2025-03", 6, "f", "tf"),
    ]
    told = {(r["file"], r["pos"]): (r["fault"], r["value"]) for r in bad.collect()}
    assert told[("broken.json", None)] == ("not JSON", '{"papers": {') and told[("list.json", None)] == ("no papers", "[1]")
    assert told[("mixed.json", None)] == ("month is not a list", '{"no":"list"}')
    assert [told[("mixed.json", k)][0] for k in (1, 2, 3, 4, 5)] == ["no paper", "no paper", "no id", "wrong type: title", "wrong type: ai_keywords"]
    assert told[("mixed.json", 1)][1] == "7" and json.loads(told[("mixed.json", 4)][1]) == paper("d", title=["x"])
    # what is good is what the plain readers say of the good files
    plain = readers.month_dump(spark, f"{path}/good.json").select("month_key", "pos", "paper")
    assert sorted(checked.good(rows).where("file = 'good.json'").select("month_key", "pos", "paper").collect()) == sorted(plain.collect())
    assert rows.count() == good.count() + bad.count() == checked.rejected(rows).count() + 4


def test_payloads_keep_what_is_broken_beside_the_good(spark, tmp_path):
    right = {"source": "hf", "period_start": "2025-01-01", "period_end": "2025-01-31", "embed_config": {"embed_config_id": "e", "json_payload": "{}"}, "cluster_config": {"cluster_config_id": "c", "json_payload": "{}"}, "papers": [{"paper_id": "p"}], "clusters": []}
    path = write(tmp_path / "in", {
        "a.json": right, "b.json": right | {"period_start": "2025-02-30"}, "c.json": '{"source": ', "d.json": right | {"papers": "none"}, "e.json": {k: v for k, v in right.items() if k != "embed_config"},
        "f.json": right | {"source": ""}, "g.json": right | {"period_end": "2024-01-01"}, "h.json": {k: v for k, v in right.items() if k != "clusters"},
    })
    rows = checked.payloads(spark, path)
    told = {r["file"][0]: r["fault"] for r in rows.collect()}
    assert told == {"a": None, "b": "bad period", "c": "not of the schema", "d": "not of the schema", "e": "no configuration", "f": "no source", "g": "bad period", "h": "no clusters"}
    good, bad = sinks.write_checked(rows, str(tmp_path / "out"))
    assert good.collect()[0]["papers"][0]["paper_id"] == "p" and good.count() == 1
    kept = {r["file"][0]: r["value"] for r in bad.collect()}
    assert kept["c"] == '{"source": ' and json.loads(kept["d"])["papers"] == "none" and json.loads(kept["b"])["period_start"] == "2025-02-30"


def test_lines_of_payload_rows_fail_alone(spark, tmp_path):
    lines = [json.dumps({"kind": "papers", "payload_id": "m", "papers": {"pos": 0, "paper_id": "p"}}), "{broken", json.dumps({"kind": "members", "payload_id": "m"}), json.dumps({"kind": "papers", "papers": {"paper_id": "q"}}), json.dumps({"kind": "papers", "payload_id": "m", "papers": {"pos": "x"}})]
    rows = checked.payload_rows(spark, write(tmp_path / "in", {"a.json": "\n".join(lines)}))
    assert sorted(str(r["fault"]) for r in rows.collect()) == ["None", "no payload_id", "no row of its kind", "not of the schema", "not of the schema"]
    assert checked.good(rows).collect()[0]["papers"]["paper_id"] == "p"


def test_lists_of_clusters_and_responses(spark):
    texts = spark.createDataFrame([(1, '[{"a": 1}, 2]'), (2, '{"clusters": [{"b": 1}]}'), (3, "{"), (4, None), (5, "{}"), (6, "[]")], "n int, body string")
    found = checked.cluster_lists(texts).collect()
    assert sorted((r["n"], r["pos"], r["fault"], r["value"]) for r in found if r["fault"]) == [(1, 1, "not an object", "2"), (3, None, "not JSON", "{"), (4, None, "not JSON", ""), (5, None, "no list of clusters", "{}")]
    assert sorted((r["n"], r["pos"]) for r in found if not r["fault"]) == [(1, 0), (2, 0)]
    told = [(r["n"], r["fault"]) for r in checked.responses(texts).orderBy("n", "pos").collect()]
    assert told == [(1, "no id"), (1, "not an object"), (2, "no list of papers"), (3, "not JSON"), (4, "not JSON"), (5, "no list of papers")]
    assert checked.responses(texts.limit(0)).count() == checked.cluster_lists(texts.limit(0)).count() == 0


def sample(schema):
    """A value that keeps a schema."""
    kind = schema.get("type")
    if "enum" in schema:
        return schema["enum"][0]
    if kind == "string":
        return "x" * max(1, schema.get("minLength", 0))
    if kind == "array":
        return [sample(schema["items"]) for _ in range(max(1, schema.get("minItems", 0)))]
    return {n: sample(s) for n, s in schema["properties"].items()}


def broken(value, schema, path="$"):
    """Each way to break one rule: (path, rule, how to change the value at its place)."""
    kind = schema["type"]
    yield path, "type", 5
    if "enum" in schema:
        yield path, "enum", "none of them"
    if schema.get("minLength"):
        yield path, "minLength", ""
    if "maxLength" in schema:
        yield path, "maxLength", "x" * (schema["maxLength"] + 1)
    if kind == "array":
        if schema["minItems"]:
            yield path, "minItems", value[:1] * (schema["minItems"] - 1)
        if "maxItems" in schema:
            yield path, "maxItems", value[:1] * (schema["maxItems"] + 1)
        for rest, rule, new in broken(value[0], schema["items"], f"{path}[0]"):
            yield rest, rule, [new, *value[1:]]
    if kind == "object":
        yield f"{path}.more", "additionalProperties", value | {"more": 1}
        for name, inner in schema["properties"].items():
            if name in schema["required"]:
                yield f"{path}.{name}", "required", {n: v for n, v in value.items() if n != name}
            for rest, rule, new in broken(value[name], inner, f"{path}.{name}"):
                yield rest, rule, value | {name: new}


@pytest.mark.parametrize("schema", [json_checks.PLAIN_CARDS, json_checks.RICH_CARDS], ids=["plain", "rich"])
def test_each_bound_of_the_cards_broken_once(spark, schema):
    value = sample(schema)
    cases = list(broken(copy.deepcopy(value), schema))
    rows = [(k, json.dumps(new)) for k, (_, _, new) in enumerate(cases)] + [(-1, json.dumps(value)), (-2, "{"), (-3, None), (-4, "```json\n{}\n```"), (-5, "")]
    found = json_checks.checked(spark.createDataFrame(rows, "k int, raw_text string"), schema).collect()
    told = {r["k"]: [(v["path"], v["rule"]) for v in r["violations"]] for r in found}
    assert len(cases) > 60 and told[-1] == [] and all(told[k] == [("$", "json")] for k in (-2, -3, -4, -5))
    for k, (path, rule, _) in enumerate(cases):
        assert told[k] == [(path, rule)], cases[k][:2]


def test_numbers_patterns_and_unknown_keywords(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0, "maximum": 9}, "x": {"type": "number"}, "s": {"type": "string", "pattern": "^a"}, "b": {"type": "boolean"}, "z": {"type": "null"}}}
    rows = ['{"n": 3, "x": 1.5, "s": "ab", "b": true, "z": null, "free": 1}', '{"n": -1}', '{"n": 10}', '{"n": 1.5}', '{"x": "1"}', '{"s": "b"}', '{"b": 0}', '{"z": 0}']
    found = json_checks.checked(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw_text string"), schema).orderBy("i").collect()
    assert [[v["rule"] for v in r["violations"]] for r in found] == [[], ["minimum"], ["maximum"], ["type"], ["type"], ["pattern"], ["type"], ["type"]]
    with pytest.raises(ValueError, match="oneOf"):
        json_checks.violations(F.lit(None).cast("variant"), {"oneOf": []})


def test_a_text_is_parsed_once_however_many_fields(spark):
    """Every bound of every field parsed the text anew."""
    found = json_checks.checked(spark.createDataFrame([(1, "{}")], "k int, raw_text string"), json_checks.RICH_CARDS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    with_map = plan.count("map<string,variant>") or plan.count("MapType(StringType,VariantType")
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2, with_map
