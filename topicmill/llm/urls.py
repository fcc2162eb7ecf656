"""URL filter by association rules, mined with FP-growth and matched by inverted index.

A URL becomes a set of tokens (host suffixes, path directories, query keys,
file ending). Over the labelled pages, sets that also hold the label "bad" are
mined, tokens of the same rows as one; rules set -> bad are pruned by support,
confidence and lift, and by shorter rules that are as sure. A page meets a rule by
the rule's rarest token, then the rest of its tokens is checked, so pages are not
paired with all rules.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, if_few

BAD = "label:bad"
#: Verdict, host, path start.
GIVEN = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def given_rule(host: Column, path: Column, rules=GIVEN) -> Column:
    """The longest fitting rule as struct (rule, verdict), else null; ties go to the rule given first."""
    fitting = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: all ends of its host, directories, query keys, its ending, and whether it has an anchor."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    folders = F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda s: s != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda s: F.substring_index(s, "=", 1)), lambda s: s != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    found = F.concat(
        suffixes,
        F.transform(folders, lambda s: F.concat(F.lit("dir:"), s)),
        F.transform(keys, lambda s: F.concat(F.lit("key:"), s)),
        F.when(ending != "", F.array(F.concat(F.lit("end:"), ending))).otherwise(F.array().cast("array<string>")),
        F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.array(F.lit("part:anchor"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def read_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path`` and ``_tokens`` of each row."""
    named = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("_url"))
    host, path = split_url(F.col("_url"))
    return named.select("page_id", "_url", host.alias("host"), path.alias("path")).select(
        "page_id", "host", "path", tokens(F.col("_url"), F.col("host"), F.col("path")).alias("_tokens")
    )


def at_least(good: Column, all: Column, z: float) -> Column:
    """The lower end of Wilson's interval for a share, at ``z`` standard deviations."""
    p = good / all
    return (p + z * z / (2 * all) - z * F.sqrt(p * (1 - p) / all + z * z / (4 * all * all))) / (1 + z * z / all)


def least_rows(n: int, min_support: float, min_confidence: float, z: float) -> int:
    """Rows that a rule needs: ``min_support`` of ``n``, and so many that even without a good page among them its interval is above ``min_confidence``.

    A set in fewer rows can be no rule, so leaving those out changes no result.
    """
    return max(1, math.ceil(min_support * n - 1e-9), math.floor(min_confidence * z * z / (1 - min_confidence)) + 1)


def mined(pages: DataFrame, labels: DataFrame, min_support: float, min_confidence: float, z: float) -> tuple[DataFrame, DataFrame]:
    """Rules over classes of tokens, and the classes (``token``, ``class``: the least token of it) that tell apart labelled rows.

    Tokens that the same labelled rows have are one class: they make the same
    rules, and so many folders that always come together cost no more than one.
    """
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("_bad"))
    marks = marks.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("_bad").alias("_bad"))
    known = checkpointed(read_pages(pages).join(marks, "page_id").select(F.monotonically_increasing_id().alias("_row"), "_tokens", "_bad"))
    n, n_bad = known.agg(F.count("*"), F.coalesce(F.sum("_bad"), F.lit(0))).first()
    least = least_rows(n, min_support, min_confidence, z)
    # A set of rows by its size and two sums of hashes.
    told = known.select("_row", F.explode("_tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_row")).alias("_a"), F.bit_xor(F.xxhash64("_row", F.lit(7))).alias("_b")
    ).where(F.col("_n") >= least)
    reps = told.groupBy("_n", "_a", "_b").agg(F.min("token").alias("class"))
    classes = checkpointed(told.join(reps, ["_n", "_a", "_b"]).select("token", "class"))
    some = if_few(classes.where("token = class"))
    held = known.select("_row", F.explode("_tokens").alias("token")).join(some, "token").groupBy("_row").agg(F.collect_list("class").alias("_own"))
    own = F.coalesce("_own", F.array().cast("array<string>"))
    baskets = known.join(held, "_row", "left").select(F.when(F.col("_bad") == 1, F.concat(own, F.array(F.lit(BAD)))).otherwise(own).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, n)), minConfidence=1.0).fit(baskets).freqItemsets
    sure = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("rule_tokens"), F.col("freq").alias("support"))
    body = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("rule_tokens"), F.col("freq").alias("_seen"))
    confidence = F.col("support") / F.col("_seen")
    rated = sure.join(body, "rule_tokens").select("rule_tokens", "support", confidence.alias("confidence"), (confidence * n / max(1, n_bad)).alias("lift"))
    good = rated.where(at_least(F.col("support"), F.col("support") / F.col("confidence"), z) > min_confidence)
    # A rule is spare if dropping one token leaves a rule that is as sure.
    shorter = good.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("_one")).select(
        "rule_tokens", "confidence", F.array_remove("rule_tokens", F.col("_one")).alias("_less")
    )
    spare = shorter.join(good.select(F.col("rule_tokens").alias("_less"), F.col("confidence").alias("_sure")), "_less").where("_sure >= confidence")
    return good.join(spare.select("rule_tokens"), "rule_tokens", "left_anti"), classes


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.005, min_confidence: float = 0.5, z: float = 1.64) -> DataFrame:
    """Rules (``rule_tokens``, ``support`` as rows, ``confidence``, ``lift``) that point to bad pages.

    ``labels.doc_id`` is taken as the ``page_id`` of the same number. A page is bad
    if a label says quality 0 or toxic 1. All labelled pages count; a page with
    several labels is bad if one is. Nulls count as good. A rule needs
    ``min_support`` of the labelled pages, and a share of bad pages that is over
    ``min_confidence`` even at the lower end of its interval, so that few pages
    make no rule by chance; none may hold in the data. No labels, no rules.
    Tokens that the same labelled pages have make rules that differ in them alone;
    ``judge`` does not spell these out.
    """
    rules, classes = mined(pages, labels, min_support, min_confidence, z)
    members = classes.groupBy("class").agg(F.array_sort(F.collect_list("token")).alias("_members"))
    parts = rules.select("*", F.explode("rule_tokens").alias("class")).join(members, "class")
    gathered = parts.groupBy("rule_tokens", "support", "confidence", "lift").agg(F.collect_list("_members").alias("_parts"))
    longer = lambda made, part: F.flatten(F.transform(made, lambda own: F.transform(part, lambda t: F.concat(own, F.array(t)))))
    every = F.aggregate("_parts", F.array(F.array().cast("array<string>")), longer)
    return gathered.select(F.explode(every).alias("_rule"), "support", "confidence", "lift").select(F.array_sort("_rule").alias("rule_tokens"), "support", "confidence", "lift")


def rule_index(rules: DataFrame, read: DataFrame) -> DataFrame:
    """Each rule under the rarest of its classes, by their counts over all pages."""
    counts = read.select(F.explode("_classes").alias("class")).groupBy("class").agg(F.count("*").alias("_n"))
    placed = rules.select("*", F.explode("rule_tokens").alias("class")).join(counts, "class")
    return placed.groupBy("rule_tokens", "confidence").agg(F.min_by("class", F.struct("_n", "class")).alias("class"))


def judge(pages: DataFrame, labels: DataFrame, rules=GIVEN, **mining: float) -> DataFrame:
    """All pages with ``host``, ``path``, ``rule``, ``verdict``, and ``mined_confidence`` of the surest mined rule that fits.

    A given rule decides where one fits (``rule``, like ``net/de/``); else a
    mined rule blocks; else the page is allowed. Null urls have no host, no
    path and no tokens, so are allowed. Pages are judged row by row: repeated
    ids and rows each keep theirs. Other columns are not read.
    """
    read = read_pages(pages)
    defaults = {"min_support": 0.005, "min_confidence": 0.5, "z": 1.64}
    found, classes = mined(pages, labels, **(defaults | mining))
    found = checkpointed(found)
    used = found.select(F.explode("rule_tokens").alias("class")).distinct()
    named = if_few(checkpointed(classes.join(used, "class")))
    urls = read.select("_tokens").where(F.size("_tokens") > 0).distinct()
    held = checkpointed(urls.select("_tokens", F.explode("_tokens").alias("token")).join(named, "token").groupBy("_tokens").agg(F.collect_set("class").alias("_classes")))
    index = if_few(checkpointed(rule_index(found, held)))
    met = held.select("_tokens", "_classes", F.explode("_classes").alias("class")).join(index, "class")
    fits = met.where(F.size(F.array_except("rule_tokens", "_classes")) == 0)
    sure = if_few(checkpointed(fits.groupBy("_tokens").agg(F.max("confidence").alias("mined_confidence"))))
    given = given_rule(F.col("host"), F.col("path"), rules)
    return (
        read.join(sure, "_tokens", "left").withColumn("_given", given)
        .select(
            "page_id", "host", "path", F.col("_given")["rule"].alias("rule"),
            F.coalesce(F.col("_given")["verdict"], F.when(F.col("mined_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "mined_confidence",
        )
    )
