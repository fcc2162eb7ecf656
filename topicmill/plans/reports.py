"""Report JSON derived from documents, with planted faults, for queries over the judges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles and keyword lists by remainder of the id.
TITLES = ["Deep Topic Models", "deep topic models", "AI", "The Graph of Things", "Graphs: A View"]
KEYWORDS = [
    ["Alpha", "alpha", "b", "c", "d"], ["#tag", "b", "c", "d", "e"], ["one two three four", "b", "c", "d", "e"], [" ", "b", "c", "d", "e"],
    ["a1", "b", "c", "d", "e"], ["a1", "b", "c", "d", "e"], ["a1", "b", "c", "d", "e"],
]


def _pick(values: list, by: str):
    n, out = len(values), None
    for k, v in enumerate(values):
        c = F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
        out = F.when(F.col("doc_id") % n == k, c) if out is None else out.when(F.col("doc_id") % n == k, c)
    return out


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.regexp_extract_all(F.col("text"), F.lit(r"\p{L}+"), 0).alias("w"), F.col("doc_id").cast("string").alias("s"))


def take(n):
    return F.array_join(F.slice("w", F.lit(1), n if not isinstance(n, int) else F.lit(n)), " ")


def rest(n: int):
    """``n`` plus the id's remainder, as an integer column."""
    return lambda m: (F.lit(n) + F.col("doc_id") % m).cast("int")


def flat_reports(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``raw_text`` and ``input_ids``."""
    d = _words(docs)
    own = F.concat(F.lit("d"), F.col("s"))
    near = F.concat(F.lit("d"), (F.col("doc_id") % 9).cast("string"))
    about = F.concat(take(rest(70)(80)), F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit(" ["), own, F.lit("]"))), F.when(F.col("doc_id") % 11 == 0, F.lit(" cluster")).otherwise(F.lit("")))
    paper = lambda i, t: F.struct(i.alias("paper_id"), t.alias("title"))
    read = lambda i, t: F.struct(i.alias("paper_id"), t.alias("why_read_now"))
    report = F.struct(
        _pick(TITLES, "doc_id").alias("title"), take(rest(5)(30)).alias("one_liner"), about.alias("what_this_cluster_is_about"), take(rest(50)(80)).alias("why_it_matters"),
        F.lit("HIGH").alias("confidence"), F.array(take(5), take(rest(10)(12))).alias("confidence_rationale"),
        F.array(paper(own, F.lit("t")), paper(near, F.lit("u"))).alias("representative_papers"),
        F.array(read(own, take(3)), read(F.lit("d0"), take(rest(8)(7))), read(F.lit("d1"), F.lit("x"))).alias("reading_order"),
        take(rest(1)(6)).alias("search_query_seed"), F.array(take(rest(15)(8))).alias("notes"), _pick(KEYWORDS, "doc_id").alias("keyword_list"),
    )
    raw = F.when(F.col("doc_id") % 13 == 0, F.lit('{"title": ')).when(F.col("doc_id") % 17 == 0, F.lit('{"title": 5}')).otherwise(F.to_json(report))
    raw = F.when(F.col("doc_id") % 19 == 0, F.lit(None)).otherwise(raw)
    return d.select("doc_id", "lang", raw.alias("raw_text"), F.array(own, *[F.lit(f"d{k}") for k in range(5)]).alias("input_ids"))


def section_reports(docs: DataFrame, shift: int = 0) -> DataFrame:
    """``doc_id``, ``raw_text`` and ``ranks`` for the two-section judge; ``shift`` moves the faults."""
    d = _words(docs).withColumn("f", F.col("doc_id") + shift)
    fault = lambda n: F.col("f") % n == 0
    cite = lambda text, n: F.concat(text, F.when(fault(n), F.lit(" [zz].")).otherwise(F.lit(" [a] [b].")))
    fill = lambda n: F.concat_ws(" ", F.array_repeat(F.lit("word"), n))
    about = F.concat(cite(fill(40), 7), F.lit(" "), fill(30), F.when(fault(4), F.lit(". ")).otherwise(F.lit(" [a] [b]. ")), fill(20), F.lit(" [b]."))
    title = F.lit("Deep Topic Models")
    report = F.struct(
        F.struct(
            title.alias("title"), take(8).alias("one_liner"), about.alias("what_this_topic_is_about"),
            F.struct(F.concat(fill(35), F.lit(" [a].")).alias("practical_significance"), F.concat(fill(30), F.lit(" [b].")).alias("research_significance")).alias("why_it_matters"),
            F.lit("LOW").alias("confidence"), F.array(F.lit("one reason"), F.lit("another")).alias("confidence_rationale"),
            F.when(fault(3), F.array(F.lit("[b] two"), F.lit("[a] one"))).otherwise(F.array(F.lit("[a] one"), F.lit("[b] two"))).alias("representative_papers"),
            F.array(F.lit("[a] first"), F.lit("[b] then"), F.lit("[c] last")).alias("reading_order"), F.lit("deep topics").alias("search_query_seed"), F.array(F.lit("a note")).alias("notes"),
        ).alias("section_a"),
        F.struct(
            F.when(fault(5), F.lit("Other Title")).otherwise(title).alias("title"), F.concat(fill(70), F.lit(" [a].")).alias("summary"),
            F.when(fault(11), F.array(*map(F.lit, ["a", "a", "c", "d", "e"]))).otherwise(F.array(*map(F.lit, ["a", "b", "c", "d", "e"]))).alias("keyword_list"),
        ).alias("section_b"),
    )
    ranks = F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(1), F.lit("c"), F.lit(2))
    raw = F.when(fault(13), F.lit("not json")).otherwise(F.to_json(report))
    return d.select("doc_id", "lang", raw.alias("raw_text"), F.when(~fault(23), ranks).alias("ranks"))
