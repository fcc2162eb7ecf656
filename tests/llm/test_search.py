"""Ranked search, exact inner products and spelling variants against brute force, and on odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.helpers import DATA
from topicmill.llm import lexical, licenses, neardup, quality, runs, simhash, spelling, topk, urls
from topicmill.llm.queries import QUERIES
from topicmill.sources import table

CLASHING = ("row", "n", "terms", "tfs", "term", "item", "place", "rank", "score", "number", "word", "near", "form", "root", "sig", "vector", "dims", "group", "kind", "part", "query", "floor", "v", "count")


def widened(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING if c not in df.columns})


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


# --- earlier operators ------------------------------------------------------------------------


def test_a_url_of_many_folders_is_mined_quickly(spark):
    """30 folders of one page, and 30 that four bad pages share: all sets of them would be 2**30."""
    deep = "http://deep.example.com/" + "".join(f"f{k}/" for k in range(30)) + "x.html"
    shared = "http://bad.example.org/" + "".join(f"g{k}/" for k in range(30))
    rows = [(0, deep)] + [(i, f"{shared}{i}.html") for i in (1, 2, 3, 4, 61, 62)] + [(i, f"http://n{i % 3}.example.com/a/{i}.html") for i in range(5, 61)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 5 else 1, 0) for i in range(61)], "doc_id long, quality int, toxic int")
    rules = urls.mine(pages, labels).collect()
    assert {tuple(r.rule_tokens) for r in rules} >= {(f"dir:g{k}",) for k in range(30)} and all(len(r.rule_tokens) == 1 and r.support == 4 for r in rules)
    told = {r.page_id: r.verdict for r in urls.judge(pages, labels, rules=()).collect()}
    assert {i for i, v in told.items() if v == "block"} == {1, 2, 3, 4, 61, 62}


INTERNAL = ("id", "_id", "license", "shingles", "_cleaned", "code", "root", "_row", "_code", "_text", "_n", "a", "b", "x", "band", "value", "print", "least", "hub", "component_id", "_tokens", "_words", "_t", "text_", "first_word", "_at", "kept", "node", "cleaned_text")


def test_columns_of_internal_names_are_kept_apart(spark):
    line = "one two three four five six seven eight nine ten eleven twelve."
    rows = [(1, line), (2, line), (3, "Other words stand here, and there are more than ten of them in this line."), (4, next(iter(licenses.TEMPLATES.values()))), (None, line)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = plain.withColumns({c: F.lit(f"own {c}") for c in INTERNAL})
    for f in (lambda d: licenses.scan(d), lambda d: simhash.components(d), lambda d: neardup.components(d)):
        assert found_of(f(clashing)) == found_of(f(plain))
    for f in (simhash.keep_one, neardup.keep_one, quality.keep_good):
        kept = f(clashing)
        assert kept.columns == clashing.columns
        assert found_of(kept.select("doc_id", "text")) == found_of(f(plain).select("doc_id", "text"))
        assert all(r[c] == f"own {c}" for r in kept.collect() for c in INTERNAL)


# --- runs -------------------------------------------------------------------------------------


def test_runs_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "ab", "Cd é1", "ünï" * 9, " ", "x" * 50] + ["".join(rng.choice("abÉé 1-\n漢") for _ in range(rng.randrange(40))) for _ in range(200)]
    wanted = [(i, w) for i, t in enumerate(texts) for w in re.findall("[A-Za-zÀ-ÿ]+", low(t))]
    for size in (1, 2, 3, 7, 16, 1 << 20):
        monkeypatch.setattr(runs, "SEGMENT", size)
        found = [(int(r), w) for words, rows in runs.runs(pa.array(texts), spelling.inside) for w, r in zip(words.to_pylist(), rows, strict=True)]
        assert found == wanted, size
    sliced = pa.array(texts)[5:60]
    assert [w for words, _ in runs.runs(sliced, spelling.inside) for w in words.to_pylist()] == [w for i, w in wanted if 5 <= i < 60]


# --- ranked search ----------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, k):
    """Rows of ``docs`` and ``items`` are (id, text)."""
    tfs = [collections.Counter(TERM.findall(low(t))) for _, t in docs]
    full = [c for c in tfs if c]
    total, length = len(full), sum(sum(c.values()) for c in full)
    df = collections.Counter(t for c in full for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(TERM.findall(low(text)))
        scored = []
        for (doc, _), c in zip(docs, tfs, strict=True):
            score = 0
            m = 25 + (75 * sum(c.values()) * total) // length if c else 0
            for t, times in asked.items():
                if c[t]:
                    score += times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_equals_brute_force(spark):
    given = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()], [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    assert found_of(QUERIES["op11_lexical_search"](spark, DATA)) == brute_search(*given, 10)


@pytest.mark.parametrize("few", [True, False])
def test_search_on_odd_rows(spark, few, monkeypatch):
    """Copies, ties, repeated and missing ids, blanks and long texts; any first round; few terms or many."""
    if not few:
        monkeypatch.setattr(lexical, "FEW", 3)
    rng = random.Random(7)
    vocabulary = ["a", "B", "é", "漢字", "w1", "w2", "x9", "long" * 30, *[f"t{i}" for i in range(40)]]
    said = lambda n: " ".join(rng.choice(vocabulary[: rng.randrange(2, len(vocabulary))]) for _ in range(n))
    docs = [(i, said(rng.randrange(1, 30))) for i in range(60)]
    docs += [(7, docs[7][1]), (70, docs[7][1]), (71, docs[7][1]), (None, docs[7][1]), (72, None), (73, ""), (74, " ,;\n"), (75, said(40000))]
    items = [(1, docs[7][1]), (1, docs[7][1]), (2, said(50)), (3, None), (4, ""), (5, "unheard of"), (6, "a a a B"), (None, said(12)), (8, " ".join(vocabulary))]
    frames = [widened(spark.createDataFrame(rows, f"{key} long, text string")) for rows, key in ((docs, "doc_id"), (items, "item_id"))]
    for first, k in ((4, 10), (1, 3), (100, 5)):
        assert found_of(lexical.search(*frames, k, first)) == brute_search(docs, items, k)
    assert lexical.search(frames[0].limit(0), frames[1]).count() == 0
    assert lexical.search(frames[0], frames[1].limit(0)).count() == 0


def test_search_stops_creating_accumulators(spark, monkeypatch):
    """With ten good copies of an item, documents of common terms alone get no accumulator."""
    docs = [(i, "rare1 rare2 rare3 rare4 the of and to") for i in range(10)] + [(100 + i, "the of and to in by") for i in range(300)]
    seen = []
    keep = lexical.stored

    def spy(df):
        out = keep(df)
        if out.columns == ["item", "row", "score"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(lexical, "stored", spy)
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, docs[0][1])], "item_id long, text string"))
    assert [r.doc_id for r in found.orderBy("rank").collect()] == list(range(10))
    assert seen and max(seen) == 10


# --- exact top-k ------------------------------------------------------------------------------


def brute_top(rows, k, mod):
    """Rows are (id, vector or None)."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(whole):
        if i is not None and i % mod == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for n, (j, v) in enumerate(whole) if n != at and len(v) == len(q))
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_top_k_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").collect()]
    assert found_of(QUERIES["op12_exact_top_k"](spark, DATA)) == brute_top(rows, 5, 50)


@pytest.mark.parametrize("settings", [{}, {"shard": 640, "group": 2}, {"shard": 64 * 8 * 20, "group": 1}])
def test_top_k_on_odd_rows(spark, settings, monkeypatch):
    """Ties, copies, repeated and missing ids, other dimensions, null and non-finite parts, whatever shards, leaves and blocks."""
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=8).round(2).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 520)] + [(i, [-0.001, 1.0, 0.0, 0.25]) for i in range(520, 540)] + [(i, []) for i in range(540, 560)]
    rows += [(10, rows[10][1]), (10, rows[11][1]), (None, rows[20][1]), (600, None), (610, [None] * 8), (620, [float("nan")] * 8), (630, [float("inf")] * 8), (640, [1.0])]
    df = widened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found_of(topk.top_k(df, F.col("vec_id") % 10 == 0, 5, **settings)) == brute_top(rows, 5, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_scores_are_exact(spark):
    rows = [(0, [2.0**21 + 3, 1.0, 5.0]), (1, [2.0**22 + 1, 7.0, 1.0]), (2, [2.0**22 + 1, 7.0, 2.0]), (3, [2.0**22, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_of(topk.top_k(df, F.col("vec_id") == 0, 3)) == [x for x in brute_top(rows, 3, 7)]


def test_tree_opens_few_nodes_of_clustered_vectors():
    rng = np.random.default_rng(1)
    vectors = np.floor(np.repeat(rng.normal(size=(40, 16)), 200, axis=0) * 256 + rng.normal(size=(8000, 16)))
    tree = topk.Tree(vectors, np.arange(8000), np.arange(8000))
    assert tree.end[tree.leaves :].sum() - tree.begin[tree.leaves :].sum() == 8000
    for node in range(1, 2 * tree.leaves):
        own = tree.vectors[tree.begin[node] : tree.end[node]]
        assert np.sqrt(np.square(own - tree.centers[node]).sum(axis=1)).max() <= tree.radii[node] + 1e-6
    scored = []
    block = topk.Block(vectors[:1], np.array([0]), np.array([np.iinfo(np.int64).min]), np.array([topk.LAST]), 5)
    products = topk.products
    topk.products = lambda a, b: scored.append(len(b)) or products(a, b)
    try:
        topk.branch_and_bound([tree], block)
    finally:
        topk.products = products
    assert sum(scored) < 4000
    exact = np.delete((vectors[:1] @ vectors.T)[0], 0)
    assert sorted(block.score.tolist()) == sorted(np.sort(exact)[-5:].astype(int).tolist())


# --- spelling variants ------------------------------------------------------------------------


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def brute_variants(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", low(text)):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if within_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    found = found_of(QUERIES["op13_spelling_variants"](spark, DATA))
    assert found == brute_variants(docs)
    assert any(r[1] for r in found)


@pytest.mark.parametrize("settings", [{}, {"hot": 1, "many": 0}, {"hot": 3, "many": 4, "parts": 4}])
def test_variants_on_odd_rows(spark, settings):
    """Chains of forms, ties, anagrams, long words, letters beyond ASCII, repeated and missing ids, whatever is refined."""
    rng = random.Random(11)
    words = ["banana", "bananas", "banané", "Écoleßa", "écoleßa", "x" * 3000, "x" * 3001, "listen", "silent", "enlist", "silenx", "abcdef"]
    words += ["".join(p) for p in ("abcdeg", "abcdfe", "bacdef", "abcdeff", "abcdeffg", "abcdef×")] + ["".join(rng.choice("ab") for _ in range(rng.randrange(6, 9))) for _ in range(60)]
    docs = []
    for k, w in enumerate(words):
        docs += [(k, f"{w.upper() if k % 3 == 0 and w.isascii() else w}, {w}1{w}")] * (2 if k % 5 else 70)
    docs += [(None, "banana bananas " * 3), (5000, None), (5001, ""), (5002, "12 34"), (5003, "listen " * 9000)]
    df = widened(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found_of(spelling.variants(df, **settings)) == brute_variants(docs)
    assert spelling.variants(df.limit(0)).count() == 0


def test_checksums_go_on_from_their_seeds():
    words = ["abcdef", "ététét", "x" * 200, "y" * 64, "z" * 65, "q"]
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in range(6)], np.uint32)
    found = spelling.checksums(pa.array(words, pa.large_string()), seeds)
    assert found.tolist() == [zlib.crc32(f"{i}:{w}".encode()) for i, w in enumerate(words)]


def test_forms_lead_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5"), ("b", "c")]
    found = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert found == {**{f"w{i}": "w37" for i in range(37)}, "a": "w37", "b": "c"}
