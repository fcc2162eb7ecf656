"""Each operator against a brute-force version, and on odd rows."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.helpers import DATA, database, same
from topicmill.llm import chat, components, hashing, leaks, licenses, neardup, ngrams, pieces, pii, quality, sharding, simhash, urls
from topicmill.llm.queries import ORACLES, QUERIES
from topicmill.sources import table

LINE = "one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (1, LINE + ".", "en"), (1, LINE + ".", "en"), (2, None, None), (3, "", "de"), (4, "  \n\t ", None), (None, "a null id has words like any other text has them too.", "en"),
    (5, "word", ""), (6, "x" * 5000, "fr"), (7, " ".join(f"w{i}" for i in range(30000)), "en"), (8, "É Ünïcode 漢字 😀 text\u00a0here", "zz"), (8, "same id, other text", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    extra = {c: F.lit(1) for c in ("_text", "_words", "_row", "_t", "code", "block", "n_words", "shard", "token_ids", "spans")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def words(text):
    return [w for w in re.split(r"[ \t-\r]+", text or "") if w]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, DATA).toPandas(), database().sql(ORACLES[name]).df())


# --- quality ----------------------------------------------------------------------------------


def brute_quality(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = collections.defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    held = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(held)


def test_quality_counts(spark, odd):
    texts = ["a b c d e a b c d e f", "x\nx\n y\n\n\nx", LINE + "\n" + LINE, "a a a a a a a", "home | about | more\n" + LINE, None, ""]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for frame in (df, odd.where("doc_id <> 8 AND doc_id <> 1")):
        given = {r["doc_id"]: r["text"] for r in frame.collect()}
        for r in quality.judge(frame).collect():
            counts = brute_quality(given[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
            assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
            assert not (r["base_failed"] and r["kept"])


def test_quality_lines_and_filter(spark, odd, nothing):
    other = " ".join(LINE.split()[::-1])
    text = f"Home | About | Contact\n{LINE}.\n{other}!! a.\nWow!! so!! much!!\nAll rights reserved"
    kept = quality.keep_good(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")).first()
    assert kept["text"] == f"{LINE}.\n{other}!! a." and kept["n_chars"] == len(kept["text"])
    junk = spark.createDataFrame([(1, "\n".join(["a | b | c | d"] * 9) + "\n" + LINE)], "doc_id long, text string")
    assert quality.keep_good(junk).count() == 0
    found = quality.keep_good(odd)
    assert found.columns == odd.columns and found.where("doc_id = 1").count() == 2 and found.where("doc_id IN (2, 3, 4, 5)").count() == 0
    assert quality.keep_good(nothing).count() == 0


# --- sharding ---------------------------------------------------------------------------------


def test_sharding(spark, odd, nothing):
    first = sharding.start_map(spark, 24)
    grown = sharding.grow(first, 24)
    assert {r["count"] for r in first.groupBy("shard").count().collect()} <= {170, 171}
    for frame, n in ((odd, len(ODD)), (table(spark, DATA, "documents"), 200), (nothing, 0)):
        got = sharding.place(frame, first, grown).collect()
        assert len(got) == n
        places = collections.defaultdict(list)
        for r in got:
            places[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by_id = {(r["doc_id"], r["text_crc32"]): r["size"] for r in sharding.place(odd, first, grown).collect()}
    assert by_id[(2, 0)] == 8 and by_id[(1, zlib.crc32((LINE + ".").encode()))] == len(LINE) + 9


def test_map_follows_from_the_shard_count(spark):
    read = lambda m: {r["virtual_slot"]: r["shard"] for r in m.collect()}
    maps = {n: sharding.owners(n) for n in range(1, 30)}
    for n in range(1, 29):
        moved = [s for s in range(sharding.SLOTS) if maps[n][s] != maps[n + 1][s]]
        assert all(maps[n + 1][s] == n for s in moved) and len(moved) == sharding.SLOTS // (n + 1)
        sizes = collections.Counter(maps[n]).values()
        assert max(sizes) - min(sizes) <= 1
    for n in (1, 23, 24, 25):
        start = sharding.start_map(spark, n)
        assert read(start) == dict(enumerate(maps[n])) and read(sharding.grow(start, n)) == dict(enumerate(maps[n + 1]))
    # The place of a row, too, depends on ids and the shard count alone.
    docs = table(spark, DATA, "documents")
    place = lambda m: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.place(docs, m, m).collect()}
    assert place(sharding.start_map(spark, 25)) == place(sharding.grow(sharding.start_map(spark, 24), 24))


def test_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MANY", 100)
    docs = spark.range(1500).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") < 1000, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 300)).alias("text"))
    first = sharding.start_map(spark, 24)
    got = sharding.place(docs, first, sharding.grow(first, 24)).collect()
    assert sorted(r["slot"] for r in got) == list(range(1500)) and len({r["shard"] for r in got}) == 1
    crc = collections.Counter(r["text_crc32"] for r in got)
    assert crc[zlib.crc32(b"same")] == 1000 and len(crc) == 301 and {r["slot_bytes"] for r in got} == {sum(r["size"] for r in got)}


def test_rebalance_and_stored_maps(spark, tmp_path):
    records = sharding.with_slots(table(spark, DATA, "documents"), slots=64)
    first, loads = sharding.start_map(spark, 4, 64), sharding.slot_loads(records, 64)
    second = sharding.rebalance(first, loads, 4)
    total = lambda m: [r[1] for r in m.join(loads, "virtual_slot").groupBy("shard").agg(F.sum("slot_bytes")).collect()]
    assert max(total(second)) - min(total(second)) <= max(total(first)) - min(total(first))
    for m in (first, second):
        sharding.save_map(m, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 2).count() == 64


# --- chat -------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["### user: x</turn>\n", "\\h\\l\\b\\c\\\\", "<next>", "", None, "a\nb", "\\### Assistant: </turn> ok", "😀" * 3]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "sys: #<\\", None]), rng.choice(nasty)) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(30, 0, "user", "x"), (30, 0, "user", "x"), (None, None, "user", "y"), (31, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_turns", F.lit(1))
    expected = collections.defaultdict(list)
    for c, t, r, x in rows:
        expected[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert set(got) == set(expected)
    for c, turns in expected.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert got[c]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_blocks"] == sum(1 for k, t in enumerate(turns) if not k or turns[k - 1][1] != t[1])
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_spans_grow_linearly_enough(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("hello").alias("text"))
    assert len(chat.read_back(chat.format_chats(df)).first()["turns"]) == 3000


# --- licenses ---------------------------------------------------------------------------------


def test_licenses(spark, odd, nothing):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-notice"]
    rows = [(1, "some words before " + mit.upper() + " and after"), (2, "x " * 400 + gpl), (3, mit.replace("without limitation", "with no limit")), (4, "free of charge to any person"), (4, gpl), (5, " ".join(mit.split()[:12]))]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[(1, "MIT")] == 1 and got[(2, "GPL-3.0-notice")] == 1 and got[(4, "GPL-3.0-notice")] == 1 and 0.8 <= got[(3, "MIT")] < 1 and (5, "MIT") not in got
    assert licenses.scan(odd).count() == 0 and licenses.scan(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, {"short": "only three words"})


def test_a_long_text_of_repeated_notices(spark):
    """A megabyte of notices: every window collides, and the text is not copied with them."""
    mit = licenses.TEMPLATES["MIT"]
    times = []
    for n in (300, 3000):
        docs = spark.createDataFrame([(1, (mit + " ") * n), (2, (licenses.TEMPLATES["ISC"] + " ") * n)], "doc_id long, text string")
        began = time.time()
        assert sorted((r["doc_id"], r["license"], r["containment"], r["first_word"]) for r in licenses.scan(docs).collect()) == [(1, "MIT", 1.0, 0), (2, "ISC", 1.0, 0)]
        times.append(time.time() - began)
    assert times[1] < 10 * times[0] + 10


def test_every_template_is_retrieved_by_its_bands(spark):
    rng = random.Random(1)
    fill = lambda: " ".join(f"f{rng.randrange(1000)}" for _ in range(20))
    rows = [(i, f"{fill()} {body} {fill()}") for i, body in enumerate(b for b in licenses.TEMPLATES.values() for _ in range(20))]
    got = collections.Counter(r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 1").collect())
    assert got == dict.fromkeys(licenses.TEMPLATES, 20)


# --- urls -------------------------------------------------------------------------------------


def given(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    raw = [
        None, "", "no scheme", "http://", "http://EXAMPLE.com", "https://a.example.com/en/7x?q#f", "http://xcom/en/", "http://x.com/en/1", "http://ÀB.Net/de/?", "https://example.net/de/8",
        "ftp://a.example.net/de/9", "http://b.org?x=/es/", "http://b.org/es/#", "http://h/p://q", "http://u.com/en/7?a=1&b=2&&=3", "//com/en/", "http://com/en/a\nb",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(raw)] + [(None, raw[7], None)], "page_id long, url string, html string").withColumn("host", F.lit(9))
    labels = spark.createDataFrame([(7, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    got = urls.judge(df, labels).collect()
    assert len(got) == len(raw) + 1
    for r in got:
        if r["page_id"] is None:
            continue
        u, host, path = raw[r["page_id"]], "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        assert (r["host"], r["path"]) == (host, path), u
        rule, verdict = given(host, path)
        assert r["rule"] == rule and r["verdict"] == (verdict or "allow")
    assert urls.judge(df.limit(0), labels).count() == 0 and urls.judge(df, labels.limit(0)).count() == len(raw) + 1


def test_mined_rules_are_those_of_brute_force(spark):
    """All sets of tokens counted one by one: supports, confidences, pruning and verdicts."""
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randint(0, 2)}.{rng.choice(['x', 'y'])}.com/{rng.choice(['a', 'b'])}/{rng.choice(['c', 'd'])}/e/f/{i}.html?k{rng.randint(0, 1)}=1") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    sets = {r["page_id"]: frozenset(r["_tokens"]) for r in urls.read_pages(pages).collect()}
    assert {"dir:e", "dir:f", "host:com"} <= sets[0] and any(t.startswith("key:k") for t in sets[0])
    bad = {i: int(("dir:a" in sets[i] and "host:x.com" in sets[i]) != (rng.random() < 0.05)) for i in range(300)}
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    seen, hit = collections.Counter(), collections.Counter()
    for i, b in bad.items():
        for n in range(1, len(sets[i]) + 1):
            for own in itertools.combinations(sorted(sets[i]), n):
                seen[own] += 1
                hit[own] += b
    low = lambda k, n, z=1.64: (k / n + z * z / (2 * n) - z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = {own: hit[own] / seen[own] for own in seen if hit[own] >= 0.05 * 300 and low(hit[own], seen[own]) > 0.5}
    less = lambda own: [own[:k] + own[k + 1 :] for k in range(len(own))]
    want = {own: c for own, c in good.items() if not any(good.get(x, -1) >= c for x in less(own))}
    got = {tuple(r["rule_tokens"]): r for r in urls.mine(pages, labels, min_support=0.05).collect()}
    assert set(got) == set(want) and want and all(math.isclose(got[o]["confidence"], c) and got[o]["support"] == hit[o] for o, c in want.items())
    told = {r["page_id"]: r for r in urls.judge(pages, labels, rules=(), min_support=0.05).collect()}
    for i, own in sets.items():
        fits = [c for rule, c in want.items() if own.issuperset(rule)]
        assert told[i]["verdict"] == ("block" if fits else "allow") and (not fits or math.isclose(told[i]["mined_confidence"], max(fits)))
    held = [i for i in range(300, 400)]
    right = [("dir:a" in sets[i] and "host:x.com" in sets[i]) for i in held if told[i]["verdict"] == "block"]
    assert len(right) > 10 and sum(right) >= 0.8 * len(right)  # labels are wrong in one of twenty


def test_mined_rules_block(spark):
    rng = random.Random(0)
    rows = [(i, f"http://h{rng.randint(0, 3)}.example.com/{'spam' if i % 5 == 0 else 'news'}/{i}.html") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if "spam" in u else 1, 0) for i, u in rows[:300]], "doc_id long, quality int, toxic int")
    rules = urls.mine(pages, labels).collect()
    assert any(r["rule_tokens"] == ["dir:spam"] and r["confidence"] == 1 for r in rules)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if "spam" in u else "allow") for i, u in rows)


# --- near-duplicates --------------------------------------------------------------------------


def brute_fingerprint(text):
    t = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = words(t)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def union(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark, odd):
    for text in ("", " ", "A b", "a b C d e f a b c", "É é x\u00a0y z\x1cq", LINE):
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    got = simhash.with_codes(odd).collect()
    assert sorted(r["code"] % (1 << 64) for r in got) == sorted(brute_fingerprint(t) for _, t, _ in ODD)


@pytest.mark.parametrize("hot", [0, 3, 64])
def test_links_connect_as_all_pairs_do(spark, hot):
    rng = np.random.default_rng(hot)
    base = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    codes = {int(x) for x in base}
    for x in base[:6]:
        y = int(x)
        for _ in range(40):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                y ^= 1 << int(b)
            codes.add(y)
    nodes = sorted(np.array(sorted(codes), np.uint64).view(np.int64).tolist())
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 2]
    df = spark.createDataFrame([(n,) for n in nodes], "code long")
    plan = simhash.fit(df, hot=hot)
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    assert (plan.thresholds(np.array(nodes, np.int64).view(np.uint64)).sum(axis=1) == simhash.RADIUS - simhash.PARTS + 1).all()
    found = simhash.links(df, plan)
    assert all(bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= 2 for r in found.collect())
    roots = union(nodes, pairs)
    got = {r["node"]: r["root"] for r in components.roots(found).collect()}
    assert {n: got.get(n, n) for n in nodes} == roots


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots_over_many_tasks(spark):
    """Links of one component in different tasks need several rounds: a chain, a star and random links, repeated and reversed."""
    rng = np.random.default_rng(5)
    chain = [(int(a), int(b)) for a, b in zip(*(lambda p: (p[:-1], p[1:]))(rng.permutation(300)), strict=True)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    loose = [(int(a), int(b)) for a, b in rng.integers(-900, -1, (300, 2)) if a != b]
    pairs = chain + star + loose + [(b, a) for a, b in loose]
    nodes = sorted({n for pair in pairs for n in pair})
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        spark.conf.set(setting, before)
    assert {n: got.get(n, n) for n in nodes} == union(nodes, pairs)
    alone = components.forest(*(np.array(ends) for ends in zip(*pairs, strict=True)))
    assert dict(zip(*(ends.tolist() for ends in alone), strict=True)) == got


def test_near_duplicates(spark, odd, nothing):
    got = simhash.components(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 1 and ids[3] == ids[4] == 0 and ids[None] == 1 and ids[5] == 1
    assert simhash.components(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_one_row_stays_where_ids_repeat(spark):
    a, b, c = LINE, "the house on the hill was green and old and so it stayed for long", "nothing of this is like anything said before in these rows at all"
    kept = lambda rows, module: sorted((r["doc_id"] or 0, r["text"]) for r in module.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for module in (simhash, neardup):
        assert kept([(3, b), (8, a), (8, b)], module) == [(3, b), (8, a)]
        assert kept([(8, a), (8, c), (8, c)], module) == sorted([(8, a), (8, c)])
        assert kept([(None, a), (None, a), (None, b), (9, b)], module) == [(0, a), (9, b)]
        assert kept([(2, a), (2, a), (1, a), (1, a)], module) == [(1, a)]


def five_words(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stage_links_all_at_the_threshold(spark, odd, nothing):
    import corpus_pipeline

    rng = random.Random(8)
    texts = []
    for n in (6, 12, 30, 60, 120) * 4:
        base = [f"b{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                copy[rng.randrange(n)] = f"c{rng.randrange(10**6)}"
            texts.append(" ".join(copy[: n - rng.randint(0, n // 6)]).upper())
    line = " ".join(f"common{i}" for i in range(20))
    texts += [line + f" own{i} own{i + 1}" for i in range(60)] + [line + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r["doc_id"] + 10**6, r["text"]) for r in table(spark, DATA, "documents").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: five_words(t) for d, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = union(ids, pairs)
    codes = {d: simhash.fingerprint(t) for d, t in rows}
    assert sum((codes[a] ^ codes[b]).bit_count() > 2 for a, b in pairs) > 50
    assert {r["doc_id"]: r["component_id"] for r in neardup.components(df).collect()} == roots
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, DATA).collect()} == set(roots.values())
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 2: 1, None: 1, 5: 1, 6: 1, 7: 1, 8: 2}
    assert neardup.keep_one(nothing).count() == 0


def test_texts_around_one_passage_meet_by_their_rarest_shingles(spark):
    rng = random.Random(5)
    passage, rows = [f"common{i}" for i in range(90)], []
    for i in range(240):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 9, 12, 14, 15, 16, 30]))]
        at = rng.randrange(len(own))
        copy = own[:at] + passage + own[at:]
        if rows and i % 6 == 5:
            copy = rows[-1][1].split()
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy)))
    sets = {d: five_words(t) for d, t in rows}
    pairs = [(a, b) for a in sets for b in range(a + 1, 240) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    found = neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == union(list(sets), pairs)
    # Texts with the passage and 16 words of their own meet nowhere but with their near copies.
    apart = [(i, " ".join(passage + [f"o{i}w{j}" for j in range(16)])) for i in range(100)]
    apart.append((100, apart[7][1].replace("o7w12", "changed")))
    code = {neardup.code_of(s): i for i, s in enumerate(neardup.sets_of(pa.array([t for _, t in apart]))[0])}
    spots = neardup.rarest(neardup.with_sets(spark.createDataFrame(apart, "doc_id long, text string")), 0.8).collect()
    assert spots and {code[r["code"]] for r in spots} == {7, 100}


def test_texts_just_below_the_threshold_become_few_pairs(spark, monkeypatch):
    rng, given, plain = random.Random(12), [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *rest: given.append(pairs.count()) or plain(pairs, *rest))
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(5, 145), rng.choice([1, 2, 3, 3, 4, 4])):
            copy[at] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sets = {d: five_words(t) for d, t in rows}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in range(a + 1, 160)}
    pairs = [p for p, x in share.items() if x >= 0.8]
    assert sum(0.6 < x < 0.8 for x in share.values()) > 5000
    found = neardup.components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == union(list(sets), pairs)
    # What is compared in full is mostly near; before, it was most of the pairs above.
    assert sum(given) < 2 * len(pairs) + 160


def test_small_tables_are_not_read_by_a_task_for_each_partition(spark):
    rows = [(i, " ".join([*(f"p{i % 2}w{w}" for w in range(60)), *(f"t{i}w{w}" for w in range(i % 3 * 4))])) for i in range(90)]
    frame, parts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), 24
    few = {r["doc_id"]: r["component_id"] for r in neardup.components(frame).collect()}
    given = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("many partitions", "")
        assert {r["doc_id"]: r["component_id"] for r in neardup.components(frame).collect()} == few
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("many partitions") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    # With a checkpoint for each table it was 72 tasks a partition.
    assert 0 < tasks < 40 * parts, tasks / parts


def test_parity_bits_differ_no_more_than_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 1, 2, 40, 700, 5000)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 1 << 62, 3).astype(np.uint64)]) for s in sets]
    bits = neardup.parity_of(sets)
    for i, j in itertools.combinations(range(len(sets)), 2):
        assert sum(int(x).bit_count() for x in bits[i] ^ bits[j]) <= len(np.setxor1d(sets[i], sets[j]))
    assert neardup.parity_of([]).shape == (0, 8) and not neardup.parity_of(sets[:1]).any()


# --- hashes of words ---------------------------------------------------------------------------


def test_word_hashes_part_and_fold_as_bytes_do(monkeypatch):
    texts = ["A b", "", "  ", None, "a  b\tC\n", "é É x y", "abc", "ABC d", "x" * 700_000 + " " + "y " * 10, "a\x0bb\x1cc", "\U0001f600 a"]
    for piece in (hashing.PIECE, 4):
        monkeypatch.setattr(hashing, "PIECE", piece)
        found, sizes = hashing.word_hashes(pa.array(texts))
        flat = [w for t in texts for w in (t or "").encode().lower().split()]
        assert sizes.tolist() == [len((t or "").encode().lower().split()) for t in texts]
        by_word = dict(zip(flat, found.tolist(), strict=True))
        assert [by_word[w] for w in flat] == found.tolist() and len(set(by_word.values())) == len(by_word)
        part, n = hashing.word_hashes(pa.array(texts).slice(4, 3))
        assert (part == found[sizes[:4].sum() : sizes[:7].sum()]).all() and n.tolist() == sizes[4:7].tolist()


def test_shingle_hashes_stay_within_rows():
    texts = ["a b c d e f", "a b", None, "b c d e f", "a b c d e", "x"]
    found, counts = hashing.shingle_hashes(*hashing.word_hashes(pa.array(texts)), 5)
    assert counts.tolist() == [2, 1, 0, 1, 1, 1] and found[0] == found[4] and found[1] == found[3] and len(set(found.tolist())) == 4


# --- n-grams ----------------------------------------------------------------------------------


START, END = " start", " end"


def brute_scores(given, held, order=ngrams.ORDER):
    """Each text's tokens, known tokens, base score and score, by dictionaries of counts."""
    low = {d: [START, *words("".join(c.lower() if c.isascii() else c for c in t or "")), END] for d, t in given.items()}
    counts = [collections.Counter() for _ in range(order + 1)]
    for d, w in low.items():
        if not held[d]:
            for n in range(1, order + 1):
                counts[n].update(tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w)))
    starts = counts[1].pop((START,), 0)
    total, distinct = sum(counts[1].values()), len(counts[1])
    counts[1][(START,)] = starts

    def probability(history, w):
        if not history:
            return (counts[1][(w,)] + 1) / (total + distinct + 1)
        c, lower = counts[len(history)][history], probability(history[1:], w)
        k = ngrams.STRENGTH * max(c, 1) ** ngrams.GROWTH
        return (counts[len(history) + 1][(*history, w)] + k * lower) / (c + k) if c else lower

    for d, w in low.items():
        at = range(1, len(w))
        yield d, len(at), sum(counts[1][(w[i],)] > 0 for i in at), total, sum(math.log10(probability((), w[i])) for i in at), sum(math.log10(probability(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in at)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(spark, odd, nothing, order, monkeypatch):
    monkeypatch.setattr(ngrams, "RANGE_BYTES", 60_000)
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    frames = (docs, odd.where("doc_id <> 1 AND doc_id <> 8 OR doc_id IS NULL")) if order == 3 else (odd.where("doc_id > 1 AND doc_id <> 8"),)
    for frame in frames:
        given = {r["doc_id"]: r["text"] for r in frame.collect()}
        held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in given}
        want = {d: rest for d, *rest in brute_scores(given, held, order)}
        got = ngrams.score(frame, order=order, block_bytes=1 << 18).collect()
        assert len(got) == len(given)
        for r in got:
            *whole, base, score = want[r["doc_id"]]
            assert [r["n_tokens"], r["n_known"], r["train_tokens"]] == whole and r["held_out"] == held[r["doc_id"]]
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert ngrams.score(nothing, order=order).count() == 0 and ngrams.score(odd, order=order).count() == len(ODD)


def test_automaton_states_and_arcs():
    block = ngrams.Block.read(pa.array(["a b c", "a b d", None, "q a b"]), 3)
    counts = block.counts(np.array([True, True, True, False]))
    total, distinct = 3 + 1 + 3 + 1 + 1, 5
    made = ngrams.Automaton(block, counts, total, distinct, 3.0, 0.85)
    label = {w: int(np.flatnonzero(block.hashes == hashing.word_hashes(pa.array([w]))[0])[0]) for w in ("a", "b", "c", "d", "q")}
    start = made.first[ngrams.START_LABEL]
    read = lambda state, *names: [state := int(made.step(np.array([state]), np.array([label[n]]))[0][0]) for n in names][-1]
    assert start > 0 and made.first[label["q"]] == 0
    assert read(start, "a") == read(start, "q", "a") or made.fails[read(start, "a")] == read(start, "q", "a")
    assert made.fails[read(0, "a", "b")] == read(0, "b") and made.fails[read(0, "b")] == 0
    # From any state the arcs' probabilities add up to one over all known words, the end, and all unknown words together.
    for state in range(len(made.fails)):
        names = [ngrams.END_LABEL, *(label[w] for w in "abcd"), label["q"]]
        _, weight = made.step(np.full(len(names), state), np.array(names))
        assert math.isclose((10**weight).sum(), 1)
    assert (np.diff(made.keys) > 0).all()


def test_counts_beyond_four_bytes_are_exact():
    keys, big = ngrams.pack(np.array([7], np.uint64)), ngrams.pack(np.array([2**53 + 1], np.uint64))
    told = ngrams.answer(ngrams.as_table([(0, 5, 0, keys, big, None, 0, 0), (0, 6, 0, keys, big, None, 0, 0)]), 0)
    assert [int(ngrams.unpack(x.as_py(), np.uint64)[0]) for x in told.column("one")] == [2**54 + 2] * 2


# --- decontamination --------------------------------------------------------------------------


def test_leaks(spark, odd, nothing):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((3, 8, 15, 33, 59, 120, 400))] + [(90, None), (91, " ")]
    rows, expected = [], set()
    for i, t in items[:7]:
        rows.append((100 + i, text(rng.randint(0, 90)) + " " + t.upper() + "\n" + text(rng.randint(0, 90))))
        if i:
            expected.add((100 + i, i))
    rows.append((200, text(50) + " " + " ".join(items[6][1].split()[:380]) + " " + text(70)))
    expected |= {(200, 6), (202, 3)}
    rows += [(201, text(300)), (202, items[3][1]), (203, " ".join(items[4][1].split()[:25]) + " " + text(100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and all(r["similarity"] >= 0.8 for r in got)
    assert {r["doc_id"] for r in leaks.clean(df, bench).collect()} == {100, 201, 203}
    assert leaks.find(odd, bench).count() == 0 and leaks.clean(odd, bench).count() == len(ODD) and leaks.clean(odd, bench).columns == odd.columns
    assert leaks.find(nothing, bench).count() == 0 and leaks.find(df, bench.limit(0)).count() == 0 and leaks.clean(df, bench.limit(0)).count() == len(rows)


def brute_items(items):
    """(id, shingles, weight of each) of different items, as the operator's own counting gives them."""
    cut = [(i, leaks.shingles_of(pa.array([t]))[0]) for i, t in items]
    holders = collections.Counter(h for own in {tuple(s.tolist()) for _, s in cut} for h in set(own))
    return [(i, s, np.array([1 / holders[h] for h in s.tolist()])) for i, s in cut if len(s)]


def brute_similarity(item, window):
    _, shingles, weights = item
    weight, a, b = dict(zip(shingles.tolist(), weights.tolist())), collections.Counter(shingles.tolist()), collections.Counter(window)
    w = lambda h: weight.get(h, weights.mean())
    return sum(w(h) * min(a[h], b[h]) for h in a) / sum(w(h) * max(a[h], b[h]) for h in a.keys() | b.keys())


def brute_found(text, item):
    """The best similarity over all windows of the item's size, or of the whole text if that is shorter."""
    own, n = leaks.shingles_of(pa.array([text]))[0].tolist(), len(item[1])
    return max((brute_similarity(item, own[p : p + n]) for p in range(max(1, len(own) - n + 1)) if own), default=0.0)


def leaks_in(texts, items, radius=leaks.RADIUS):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    return [own for _, found in leaks.hits(iter([batch]), [items], 0.8, radius) for own in found]


def test_shortened_items_are_found():
    rng = random.Random(3)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    for n in (5, 9, 24, 43, 120, 230, 399):
        item = text(n + 4).split()
        least = math.ceil(0.8 * n - 1e-9)
        cuts = [item[: m + 4] for m in range(least, n + 1)] + [item[n - m :] for m in range(least, n + 1)] + [item[: least + 3]]
        found = leaks_in([" ".join(c) for c in cuts], brute_items([(5, " ".join(item)), (6, text(60))]))
        assert [[(i, round(s, 9)) for i, s, _ in own] for own in found[:-1]] == [[(5, round((len(c) - 4) / n, 9))] for c in cuts[:-1]], n
        assert found[-1] == []


def test_found_similarity_is_the_best_of_all_windows():
    """Items with edits, scattered or together, inside texts: recall against all windows, and exact similarities."""
    rng = random.Random(11)
    text = lambda n: [f"v{rng.randrange(10**4)}" for _ in range(n)]
    stem = text(12)
    items = [(i, " ".join((stem if i % 4 == 0 else []) + text(n))) for i, n in enumerate([6, 12, 18, 25, 40, 60, 90, 130, 399] * 4)]
    known = brute_items(items)
    texts = []
    for _, t in items:
        for scattered in (False, True, True):
            w = t.split()
            spot = rng.randrange(len(w))
            for k in range(rng.randint(0, max(1, len(w) // (30 if scattered else 12)))):
                w[rng.randrange(len(w)) if scattered else (spot + k) % len(w)] = "edited"
            texts.append(" ".join(text(rng.randint(0, 60)) + w + text(rng.randint(0, 60))))
    found = leaks_in(texts, known)
    # Texts share no more than a stem with other items, so only their own can be similar.
    want = {(k, k // 3): s for k, t in enumerate(texts) if (s := brute_found(t, known[k // 3])) >= 0.8}
    got = {(k, i): s for k, own in enumerate(found) for i, s, _ in own}
    assert set(got) <= set(want) and len(want) > 60
    assert len(got) >= 0.95 * len(want), (len(got), len(want))
    assert [(x, s, want[x]) for x, s in got.items() if s > want[x] + 1e-9] == []
    assert sum(math.isclose(s, want[x], rel_tol=1e-9) for x, s in got.items()) >= 0.95 * len(got)


def test_items_do_not_depend_on_the_others_in_their_block(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    items = [(i, text(rng.randint(8, 40))) for i in range(300)]
    items += [(300 + i, items[i][1]) for i in range(20)] + [(5, items[5][1])]  # the same text under another id, and a row twice
    more = [(1000 + i, text(20)) for i in range(450)]
    docs = spark.createDataFrame([(i, text(20) + " " + items[i][1] + " " + text(9)) for i in range(100)], "doc_id long, text string")
    read = lambda frame: sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in frame.collect())
    table_of = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    one = read(leaks.find(docs, table_of(items)))
    assert {(d, i) for d, i, _, _ in one} == {(d, d) for d in range(100)} | {(d, 300 + d) for d in range(20)}
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 100)
    monkeypatch.setattr(leaks, "ROUND", 3)
    assert read(leaks.find(docs, table_of(items + more))) == one
    assert leaks.clean(docs, table_of(items + more)).count() == 0 and leaks.clean(docs, table_of(more)).count() == 100


def test_long_items_have_a_piece_at_their_end():
    for n in (231, 300, 399, 450):
        bench = leaks.Benchmark(brute_items([(0, " ".join(f"v{i}" for i in range(n + 4)))]), 0.8, 15)
        offsets = sorted(offset for _, own, _, _ in bench.groups for _, offset, _ in own)
        assert offsets[0] == 0 and offsets[-1] == n - 200 and all(b - a <= 200 for a, b in zip(offsets, offsets[1:], strict=False))


def test_block_tables_list_all_within_the_radius():
    bench = leaks.Benchmark(brute_items([(0, LINE)]), 0.8, 15)
    (size, own, tables, codes), rng = bench.groups[0], np.random.default_rng(0)
    for _ in range(300):
        x = int(codes[0])
        for b in rng.choice(64, rng.integers(0, 16), replace=False):
            x ^= 1 << int(b)
        blocks = np.array([x], np.uint64).view(np.uint16)
        assert any(int(tables[b][blocks[b]]) & 1 for b in range(4))


def test_long_texts_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK", 64)
    item = " ".join(f"q{i}" for i in range(30))
    for shift in range(0, 130, 7):
        text = " ".join(f"a{i}" for i in range(shift)) + " " + item + " " + " ".join(f"b{i}" for i in range(100))
        assert leaks_in([text], brute_items([(5, item)])) == [[(5, 1.0, shift)]]


def test_few_links_settle_without_rounds(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200) if i % 50] + [(7, 7), (3, 2)], "a long, b long").repartition(9)
    wanted = sorted(map(tuple, components.roots(links).collect()))
    monkeypatch.setattr(components, "MOST", 20)
    assert sorted(map(tuple, components.roots(links).collect())) == wanted and len(wanted) == 196
    monkeypatch.undo()
    monkeypatch.setattr(components, "_large_star", lambda links: pytest.fail("a round for few links"))
    assert sorted(map(tuple, components.roots(links).collect())) == wanted and components.roots(links.limit(0)).count() == 0


@pytest.mark.parametrize("ordered", [1 << 18, 3, 0])
def test_rarest_shingles_are_ordered_without_a_join_of_all(spark, monkeypatch, ordered):
    common, plans = list(range(1000, 1050)), []
    sets = spark.createDataFrame([(i, sorted([*common, *range(i * 10, i * 10 + 6), *([5000 + i // 10] if i < 40 else [])])) for i in range(60)], "code long, shingles array<long>")
    monkeypatch.setattr(neardup, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    monkeypatch.setattr(neardup, "ORDERED", ordered)
    neardup.rarest(sets, 0.8)
    assert plans and not any("LeftOuter" in p for p in plans)
    monkeypatch.setattr(neardup, "checkpointed", lambda df: plans.append(df.collect()) or df)
    neardup.rarest(sets, 0.8)
    for code in range(60):
        held = [r["value"] for r in sorted((r for r in plans[-1] if r["code"] == code), key=lambda r: r["at"])]
        n = 57 if code < 40 else 56
        assert len(held) == n - -(-n * 4 // 5) + 1 and len(set(held)) == len(held)
        if ordered > 50:
            assert not set(held[:6]) & set(common), held


# --- personal data ----------------------------------------------------------------------------

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(pii.digits(m)) <= 19 and pii.luhn(pii.digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(pii.digits(m)) <= 15),
]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    alphabet = ["a", "b.c", "@", "@x.y", ".", "1", "23", "255", "256", "-", " ", "+", "(", ")", "_", "%", "4539578763621486", "é", "\n", "1.2.3.4", "+1 (555) 123-4567", "a.b@c-d.e.f"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m[0]))
        assert pii.base_spans(text) == want, text


def test_long_runs_are_fast():
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_gradients():
    t, rng = pii.Tagger(size=3, hidden=2), np.random.default_rng(0)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    ids, tags = rng.integers(0, 99, (3, 7)), rng.integers(0, 9, (3, 7))
    _, g = t.loss(ids, tags)
    for k, w in t.w.items():
        at = (ids[0, 3], 1) if k == "E" else tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-4
        a, _ = t.loss(ids, tags)
        w[at] -= 2e-4
        b, _ = t.loss(ids, tags)
        w[at] += 1e-4
        assert math.isclose((a - b) / 2e-4, g[k][at], rel_tol=1e-3, abs_tol=1e-6)


def test_viterbi_is_the_best_path():
    t, rng = pii.Tagger(), np.random.default_rng(1)
    t.w["A"] = rng.standard_normal(t.w["A"].shape).astype(np.float32)
    e = rng.standard_normal((4, pii.TAGS)).astype(np.float32)
    value = lambda p: t.w["s"][p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(t.w["A"][a, b] for a, b in itertools.pairwise(p))
    assert tuple(t.viterbi([e, e[:2]])[0]) == max(itertools.product(range(pii.TAGS), repeat=4), key=value)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(9)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = digit(15)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    kinds = [lambda: f"{rng.choice('abcd')}{digit(2)}@mail{digit(1)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, lambda: f"+1 ({digit(3)}) 555-{digit(4)}"]
    fill = lambda: " ".join(rng.choice(["the", "and", "house", "went", "green"]) for _ in range(rng.randint(3, 12)))
    rows = [(i, f"{fill()} {kinds[i % 4]()} {fill()} version {digit(1)}.{digit(1)}") for i in range(500)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_tagger_finds_held_out_and_rewritten_spans(people):
    tagger = pii.Tagger(pii.fit(people.where("doc_id < 400"), 600))
    texts = [r["text"] for r in people.where("doc_id >= 400").collect()]
    base = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(tagger, texts, [[] for _ in texts])
    hit = sum(len(set(a) & set(b)) for a, b in zip(alone, base, strict=True))
    assert hit >= 0.7 * sum(map(len, base))
    fresh = [f"we went and call ({i}55) 123-45{i}7 the green house" for i in range(1, 9)]
    assert sum(bool(a) for a in pii.added_spans(tagger, fresh, [[] for _ in fresh])) >= 4


@pytest.mark.parametrize("labelled", [1, 5, 19])
def test_tagger_is_trained_on_few_spans_too(spark, people, labelled):
    given = people.where(f"doc_id < {labelled}").union(spark.createDataFrame([(-i, f"we went in {1900 + i} and saw 3 of {i} houses, 12.5 each") for i in range(1, 60)], "doc_id long, text string"))
    tagger = pii.Tagger(pii.fit(given))
    clean = [f"the house of {i} green rooms was sold in {1950 + i} for 2.5" for i in range(40)]
    assert pii.added_spans(tagger, clean, [[] for _ in clean]) == [[] for _ in clean]
    assert pii.fit(people.where("doc_id < 0")) is None and pii.fit(given.where("doc_id < 0")) is None


def test_spans_at_the_edges_of_long_stretches(monkeypatch):
    number = "(555) 123-4567"

    def tags(tagger, parts):
        out = [np.zeros(len(p), np.int64) for p in parts]
        for t, p in zip(out, parts):
            for m in re.finditer(re.escape(number), p):
                t[m.start() : m.end()] = 8
                t[m.start()] = 7
        return out

    monkeypatch.setattr(pii, "decode", tags)
    for fill in ("", "1 a " * 50, "1 a " * 8000):
        text = f"{'word ' * 40}{number} {fill}{number} {fill}{number}{' word' * 40}"
        want = [(m.start(), 3, m.end()) for m in re.finditer(re.escape(number), text)]
        assert pii.added_spans(None, [text], [[]]) == [want] and len(want) == 3


def test_every_position_of_a_text_is_decoded(monkeypatch):
    seen, text = [], "call john at example.com or mary (at) host.org now " + "plain words only, " * 700

    def tags(tagger, parts):
        seen.extend(parts)
        out = [np.zeros(len(p), np.int64) for p in parts]
        for t, p in zip(out, parts):
            for m in re.finditer(r"john at example|mary \(at\) host", p):
                t[m.start() : m.end()] = 2
        return out

    monkeypatch.setattr(pii, "decode", tags)
    found = pii.added_spans(None, [text, ""], [[], []])
    assert [text[s:e] for s, _, e in found[0]] == ["john at example.com", "mary (at) host.org"] and found[1] == []
    assert sum(map(len, seen)) >= len(text) and all(text[k : k + pii.WINDOW] in "\0".join(seen) for k in range(0, len(text), 50))


@pytest.mark.parametrize("scale", [0.2, 1, 3, 8])
def test_fast_scores_and_paths_equal_the_plain_ones(scale):
    rng, t = np.random.default_rng(3), pii.Tagger()
    for k in ("A", "s", "O", "o"):
        t.w[k] = (rng.standard_normal(t.w[k].shape) * scale).astype(np.float32)
    t.w["o"][0] += 4 * scale
    ids = rng.integers(0, 99, (5, 64))
    assert np.allclose(t.scores(ids), t.emissions(ids)[0], atol=1e-4)
    scores = [t.emissions(rng.integers(0, 99, (1, n)))[0][:, 0] for n in (1, 2, 3, 64, 300, 700)]
    assert all((a == b).all() for a, b in zip(t.best(scores), t.viterbi(scores), strict=True))
    assert any(t.outside(e).any() for e in scores) and t.best([]) == []


def odd_tagger(scale, lead):
    rng, t = np.random.default_rng(4), pii.Tagger()
    for k in ("A", "s", "O", "o"):
        t.w[k] = (rng.standard_normal(t.w[k].shape) * scale).astype(np.float32)
    t.w["o"][0] += lead * scale
    return t


def mixed_texts():
    rng = random.Random(6)
    some = ["(555) 123-4567", "joe.b at host dot org", "ann [at] my-host (dot) co.uk", "1 2 3 4", "4111/1111/1111/1111", "a@b.c", "at", "10.0.0", "@", "\u0660\u0663"]
    texts = ["", "7", "x" * 32 + "5", "1" * 64, "a@" + "b" * 31, " ".join(some) * 9]
    for n in (10, 60, 400, 3000):
        texts.append(" ".join(rng.choice(some) if rng.random() < 20 / n else rng.choice(["plain", "words", "here"]) for _ in range(n)))
    return [*texts, *(texts[-1][k : k + 64] for k in range(0, 640, 16))]


@pytest.mark.parametrize(("scale", "lead"), [(0.2, 0), (0.2, 2), (0.2, 6), (1, 1), (1, 3), (3, 2)])
def test_spans_are_those_of_decoding_every_position(scale, lead):
    t, texts = odd_tagger(scale, lead), mixed_texts()
    some = False
    for text, own, every in zip(texts, pii.decode(t, texts), pii.decode_all(t, texts), strict=True):
        asked = pii.deciding(text, pii.char_ids(text))
        held = [x for x in pii.tagged(every) if asked[x[0] : x[2]].any()]
        assert [x for x in pii.tagged(own) if asked[x[0] : x[2]].any()] == held
        some |= bool(held)
    assert some and pii.decode(t, []) == []


def test_every_plausible_span_holds_a_deciding_position():
    for text in [*mixed_texts()[:-40], "x at at y.com", "x at dot dot at y.com", "a(at)b.c at d.e", "me\n( AT )\thost\n[Dot]  org"]:
        asked = pii.deciding(text, pii.char_ids(text))
        for low in range(min(300, len(text))):
            for m in pii.SPELT.finditer(text, low, low + 90):
                assert asked[m.start() : m.end()].all(), (text, m)
        for m in re.finditer("[0-9]", text):
            assert asked[m.start()]


def test_windows_are_scored_where_a_span_can_be_only(monkeypatch):
    t, scored, plain = odd_tagger(0.2, 9), [], pii.Tagger.scores
    monkeypatch.setattr(pii.Tagger, "scores", lambda self, ids: scored.append(len(ids)) or plain(self, ids))
    texts = ["only plain words and 7 more, " + "then plain words only, " * 300 for _ in range(20)]
    assert pii.added_spans(t, texts, [[] for _ in texts]) == [[] for _ in texts]
    assert sum(scored) < sum(map(len, texts)) / pii.STEP / 10


def test_spelt_addresses_are_plausible():
    assert all(pii.plausible(0, t) for t in ("a.b at host dot org", "a [at] b [dot] co [dot] uk", "A@B.COM", "x(at)y(dot)z"))
    assert not any(pii.plausible(0, t) for t in ("at dot", "look at this", "a@b", "1.5"))


def test_pii_rows(spark, people, odd, nothing):
    both = people.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = pii.find(both, 300).collect()
    assert len(got) == 500 + len(ODD)
    given = {r["doc_id"]: r["text"] for r in people.collect()}
    for r in got:
        if (r["doc_id"] or 0) > 8:
            base = pii.base_spans(given[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and set(pii.joined(base).split(",")) <= set(r["spans"].split(","))
    plain = pii.find(odd).collect()
    assert len(plain) == len(ODD) and all(r["spans"] == "" for r in plain if r["doc_id"] != 7) and pii.find(nothing).count() == 0
    clean = pii.redact(people.withColumn("n_chars", F.length("text").cast("long")), 300).collect()
    assert all(not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in clean)
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).where("text IS NULL").count() == 1


# --- pieces -----------------------------------------------------------------------------------


def test_pieces(spark, odd, nothing):
    model = pieces.read_model()
    vocabulary = pieces.Vocabulary(model)
    texts = ["", " ", "  a  b ", "\n\n", "▁ is a mark", "😀́ 漢字 \x00", "don't", LINE, "a" * 300, *[r["text"] for r in table(spark, DATA, "documents").collect()]]
    ids = vocabulary.encode(texts)
    assert [vocabulary.decode(i) for i in ids] == texts
    whole = sum(1 / (2 - s) for p, s, _ in model if p)
    score = {p: -math.log((2 - s) * whole) for p, s, _ in model if p}

    def brute(w):
        best = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - vocabulary.longest), j):
                s = score.get(w[i:j], pieces.BYTE_SCORE * len(w[i:j].encode()) if j - i == 1 else -math.inf)
                best[j] = max(best[j], best[i] + s)
        return best[-1]

    for w in random.Random(1).sample(sorted(vocabulary.known), 400):
        own = np.frombuffer(vocabulary.known[w], np.int32)
        assert math.isclose(sum(score.get(model[i][0], pieces.BYTE_SCORE) for i in own), brute(w), rel_tol=1e-9)
    got = pieces.decode(pieces.encode(odd)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((d or 0, t or "") for d, t, _ in ODD)
    assert pieces.encode(nothing).count() == 0


def test_pieces_of_long_parts_are_exact(monkeypatch):
    rng = random.Random(3)
    model = pieces.read_model()
    draw = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    texts = [draw("etaoinshrdlu", n) for n in (1024, 1025, 1279, 1280, 1281, 3000)] + [draw("的一是在不了有和人这中大为上个国", 4000)]
    texts += ["a" * 2500, draw("abcé😀的-=/1", 3000), "http://x.org/" + "the-quick-brown-fox/" * 90 + " and " + draw("=_", 2000) + "\n" + "\x00" * 1500]
    vocabulary = pieces.Vocabulary(model)
    found = vocabulary.encode(texts)
    assert [vocabulary.decode(i) for i in found] == texts
    # The same parts, uncut and unjoined.
    monkeypatch.setattr(pieces, "LONG", 1 << 30)
    plain = pieces.Vocabulary(model)
    score = dict(zip(plain.ids.tolist(), plain.scores.tolist(), strict=True))
    total = lambda ids: sum(score.get(i, pieces.BYTE_SCORE) for i in ids.tolist())
    for ids, own in zip(found, plain.encode(texts), strict=True):
        assert math.isclose(total(ids), total(own), rel_tol=1e-9)
    assert sum(np.array_equal(a, b) for a, b in zip(found, plain.encode(texts), strict=True)) >= 7


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == before.columns, name
    good = {r["doc_id"] for r in quality.judge(table(spark, DATA, "documents")).where("kept").collect()}
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept <= good
    bench = [" ".join(r["text"].lower().split()) for r in table(spark, DATA, "benchmark").collect()]
    assert not any(b in " ".join(r["text"].lower().split()) for r in docs.collect() for b in bench)
    assert not any(pii.base_spans(r["text"]) for r in docs.collect())
    codes = sorted({simhash.fingerprint(unicodedata.normalize("NFC", r["text"])) for r in quality.keep_good(table(spark, DATA, "documents")).collect()})
    roots = union(codes, [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if bin(a ^ b).count("1") <= 2])
    final = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in final.collect()} == kept and len(kept) <= len(set(roots.values()))
    assert json.dumps(sorted(final.columns)) == '["doc_id", "n_tokens", "token_ids"]'
