"""Checking and scoring report JSON with named column expressions, up to leaderboards.

A check is a function from a report (struct column) to a boolean column.
``register_check`` adds one to the soft rules of a session's scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import ranks_rise

Check = Callable[[Column], Column]


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _type(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(v, path, "variant")), F.lit(""))


def _strings(v: Column, path: str, low: int, high: int) -> Column:
    kinds = ["ARRAY<STRING>"] + (["ARRAY<VOID>"] if low == 0 else [])
    n = F.coalesce(F.size(_get(v, path, "array<variant>")), F.lit(-1))
    return _type(v, path).isin(kinds) & n.between(low, high)


def _objects(v: Column, path: str, fields: list[str], low: int, high: int) -> Column:
    items = _get(v, path, "array<variant>")
    good = F.forall(items, lambda e: _and(*[_type(e, f) == "STRING" for f in fields]))
    return F.coalesce(F.size(items), F.lit(-1)).between(low, high) & F.coalesce(good, F.lit(False))


def _and(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def within(c: Column, low: int, high: int) -> Column:
    """``c`` (an integer) from ``low`` to ``high``; unlike ``between`` it computes ``c`` once."""
    return F.array_contains(F.sequence(F.lit(low), F.lit(high)), c)


#: List bounds, word bounds and generic titles of the report contract.
BOUNDS = {"confidence_rationale": (2, 4), "representative_papers": (2, 5), "reading_order": (3, 7), "notes": (0, 5), "keyword_list": (5, 12)}
GENERIC = ["ai", "llm", "vision", "machine learning", "deep learning", "neural network", "nlp", "computer vision", "ml", "dl"]
LEVELS = ["HIGH", "MEDIUM", "LOW"]
FLAT = ["title", "one_liner", "what_this_cluster_is_about", "why_it_matters", "search_query_seed"]


def parse_reports(df: DataFrame, raw: str = "raw_text") -> DataFrame:
    """``df`` with ``parsed``, and ``report``, null unless all fields have the right types, values and numbers of items.

    Numbers are not taken for strings; extra keys are ignored; fenced or broken JSON fails.
    """
    v = F.col("_v")
    right = _and(
        *[_type(v, f) == "STRING" for f in FLAT], F.coalesce(_get(v, "confidence", "string").isin(LEVELS), F.lit(False)) & (_type(v, "confidence") == "STRING"),
        *[_strings(v, f, *BOUNDS[f]) for f in ("confidence_rationale", "notes", "keyword_list")],
        _objects(v, "representative_papers", ["paper_id", "title"], *BOUNDS["representative_papers"]),
        _objects(v, "reading_order", ["paper_id", "why_read_now"], *BOUNDS["reading_order"]),
    )
    fields = [_get(v, f, "string").alias(f) for f in [*FLAT, "confidence"]] + [_get(v, f, "array<string>").alias(f) for f in ("confidence_rationale", "notes", "keyword_list")]
    fields += [
        _get(v, "representative_papers", "array<struct<paper_id:string,title:string>>").alias("representative_papers"),
        _get(v, "reading_order", "array<struct<paper_id:string,why_read_now:string>>").alias("reading_order"),
    ]
    rows = df.withColumn("_v", F.try_parse_json(F.col(raw))).withColumn("parsed", F.coalesce(right, F.lit(False)))
    return rows.withColumn("report", F.when(F.col("parsed"), F.struct(*fields))).drop("_v")


def words_between(field: str, low: int, high: int) -> Check:
    return lambda r: within(T.word_count(T.strip(r[field])), low, high)


def all_words_at_most(field: str, high: int, part: str | None = None) -> Check:
    return lambda r: F.forall(r[field], lambda x: T.word_count(x[part] if part else x) <= high)


def cleaned(c: Column) -> Column:
    return F.filter(F.transform(c, T.strip), lambda x: x != "")


HARD: dict[str, Check] = {
    "title_format": lambda r: T.title_case(T.strip(r["title"])),
    "about_citations": lambda r: T.has_citation(r["what_this_cluster_is_about"]) & ~F.contains(F.lower(r["what_this_cluster_is_about"]), F.lit("cluster")),
    "keyword_list_format": lambda r: F.forall(r["keyword_list"], lambda k: (T.strip(k) != "") & ~F.contains(k, F.lit("#"))),
}
SOFT: dict[str, Check] = {
    "title_word_count": words_between("title", 1, 12),
    "one_liner": words_between("one_liner", 1, 25),
    "about_word_count": words_between("what_this_cluster_is_about", 80, 140),
    "why_it_matters_word_count": words_between("why_it_matters", 60, 120),
    "confidence_rationale": all_words_at_most("confidence_rationale", 18),
    "search_query_seed": lambda r: ~F.contains(T.strip(r["search_query_seed"]), F.lit("\n")) & within(F.size(T.terms(r["search_query_seed"])), 2, 5),
    "notes": all_words_at_most("notes", 20),
    "reading_order_item_reasons": all_words_at_most("reading_order", 12, "why_read_now"),
    "keyword_word_counts": lambda r: F.forall(cleaned(r["keyword_list"]), lambda k: within(F.size(T.terms(k)), 1, 3)),
    "keyword_list_count": lambda r: within(T.unique_ignoring_case(cleaned(r["keyword_list"])), 5, 12),
    "name_generic": lambda r: ~F.lower(T.strip(r["title"])).isin(["", *GENERIC]),
}


def _count_text(field: str, low: int, high: int) -> Check:
    return lambda r: F.format_string(f"{field} has %d words, allowed are {low} to {high}", T.word_count(T.strip(r[field])))


def _first_text(field: str, high: int, part: str | None = None) -> Check:
    """Names the first item with too many words, counted from 0."""

    def told(r: Column) -> Column:
        counts = F.transform(r[field], lambda x: T.word_count(x[part] if part else x))
        at = F.array_position(F.transform(counts, lambda n: n > high), F.lit(True))
        return F.format_string(f"{field}[%d] has %d words, allowed are {high}", (at - 1).cast("int"), F.get(counts, (at - 1).cast("int")))

    return told


#: What a failing rule says about a report; rules without an entry say "failed".
MESSAGES: dict[str, Check] = {
    "title_format": lambda r: F.format_string("'%s' is not in title case or holds a colon", r["title"]),
    "about_citations": lambda r: F.when(T.has_citation(r["what_this_cluster_is_about"]), F.lit("the text speaks of a cluster, not a topic")).otherwise(F.lit("the text cites no paper")),
    "keyword_list_format": lambda r: F.when(F.exists(r["keyword_list"], lambda k: T.strip(k) == ""), F.lit("a keyword is blank")).otherwise(F.lit("a keyword holds a hash sign")),
    "title_word_count": _count_text("title", 1, 12), "one_liner": _count_text("one_liner", 1, 25), "about_word_count": _count_text("what_this_cluster_is_about", 80, 140),
    "why_it_matters_word_count": _count_text("why_it_matters", 60, 120), "confidence_rationale": _first_text("confidence_rationale", 18), "notes": _first_text("notes", 20),
    "reading_order_item_reasons": _first_text("reading_order", 12, "why_read_now"),
    "search_query_seed": lambda r: F.format_string("%d terms, allowed are 2 to 5 on one line", F.size(T.terms(r["search_query_seed"]))),
    "keyword_word_counts": lambda r: F.format_string("'%s' has more than 3 words", F.get(F.filter(cleaned(r["keyword_list"]), lambda k: F.size(T.terms(k)) > 3), F.lit(0))),
    "keyword_list_count": lambda r: F.format_string("%d different keywords, allowed are 5 to 12", T.unique_ignoring_case(cleaned(r["keyword_list"]))),
    "name_generic": lambda r: F.lit("the title is empty or a generic term"),
}


def register_check(name: str, check: Check, hard: bool = False, message: Check | None = None) -> None:
    (HARD if hard else SOFT)[name] = check
    if message:
        MESSAGES[name] = message


def run_checks(report: Column, checks: dict[str, Check]) -> Column:
    """Array of (rule, ok)."""
    return F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(check(report), F.lit(False)).alias("ok")) for name, check in checks.items()])


def messages(report: Column, checks: dict[str, Check]) -> Column:
    """Map of what each rule says when it fails."""
    known = {name: MESSAGES[name](report) for name in checks if name in MESSAGES}
    return F.create_map(*[c for name, told in known.items() for c in (F.lit(name), told)])


def pass_rate(results: Column) -> Column:
    return F.size(F.filter(results, lambda x: x["ok"])) / F.greatest(F.lit(1), F.size(results))


def reasons(results: Column, told: Column) -> Column:
    """A line for each failed rule."""
    line = lambda x: F.concat(x["rule"], F.lit(": "), F.coalesce(F.try_element_at(told, x["rule"]), F.lit("failed")))
    return F.array_join(F.transform(F.filter(results, lambda x: ~x["ok"]), line), "\n")


def invalid_citations(report: Column, input_ids: Column) -> Column:
    """Cited ids that are not in the input, sorted."""
    cited = F.array_union(F.transform(report["representative_papers"], lambda p: p["paper_id"]), F.transform(report["reading_order"], lambda p: p["paper_id"]))
    return F.array_sort(F.array_except(F.filter(cited, lambda x: x != ""), input_ids))


def invalid_reason(bad: Column) -> Column:
    more = F.when(F.size(bad) > 5, F.concat(F.lit(" (and "), (F.size(bad) - 5).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.when(F.size(bad) > 0, F.concat(F.lit("Invalid citations: "), F.array_join(F.slice(bad, 1, 5), ", "), more)).otherwise(F.lit(""))


def unknown_links(text: Column, known: Column, pattern: str = r"https?://[^\s)\]>\"]+") -> Column:
    """URLs in ``text`` that are not among ``known``."""
    return F.array_except(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0), known)


def judge(df: DataFrame, raw: str = "raw_text", input_ids: str = "input_ids") -> DataFrame:
    """``df`` with ``parsed``, ``report``, rule results, ``sub_scores``, ``overall`` (0, or 1 + soft score) and ``reasons``."""
    p = parse_reports(df, raw)
    r = F.col("report")
    none = F.array().cast("array<struct<rule:string,ok:boolean>>")
    p = p.withColumn("hard_checks", F.when(F.col("parsed"), run_checks(r, HARD)).otherwise(none)).withColumn("soft_checks", F.when(F.col("parsed"), run_checks(r, SOFT)).otherwise(none))
    p = p.withColumn("invalid_citations", F.when(F.col("parsed"), invalid_citations(r, F.col(input_ids))).otherwise(F.array().cast("array<string>")))
    hard = F.col("parsed") & F.forall("hard_checks", lambda x: x["ok"]) & (F.size("invalid_citations") == 0)
    p = p.withColumn("hard_valid", hard).withColumn("soft_score", F.when(F.col("parsed"), pass_rate(F.col("soft_checks"))).otherwise(F.lit(0.0)))
    p = p.withColumn("overall", F.when(~F.col("hard_valid"), F.lit(0.0)).otherwise(1 + F.col("soft_score")))
    scores = F.create_map(F.lit("json_valid"), F.col("parsed").cast("double"), F.lit("hard_schema_valid"), F.col("hard_valid").cast("double"), F.lit("soft_schema_valid"), F.col("soft_score"))
    skipped = F.lit("Skipped (no report)")
    hard_text = F.array_join(F.filter(F.array(reasons(F.col("hard_checks"), messages(r, HARD)), invalid_reason(F.col("invalid_citations"))), lambda x: x != ""), "\n")
    told = F.array(
        F.struct(F.lit("json_valid").alias("k"), F.when(F.col("parsed"), F.lit("OK")).otherwise(F.lit("JSON parse error")).alias("v")),
        F.struct(F.lit("hard_schema_valid").alias("k"), F.when(F.col("parsed"), hard_text).otherwise(skipped).alias("v")),
        F.struct(F.lit("soft_schema_valid").alias("k"), F.when(F.col("parsed"), reasons(F.col("soft_checks"), messages(r, SOFT))).otherwise(skipped).alias("v")),
    )
    return p.withColumn("sub_scores", scores).withColumn("reasons", F.map_from_entries(F.filter(told, lambda x: x["v"] != "")))


def leaderboard(judged: DataFrame, keys: list[str], item: str = "cluster_index") -> DataFrame:
    """Mean overall of the parsed reports (0 if none), and what is missing. A null ``raw_text`` is a failed call, missing in both lists."""
    failed = F.col("raw_text").isNull()
    gather = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col(item))))
    return judged.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("parsed"), F.col("overall"))), F.lit(0.0)).alias("overall"), F.count("*").alias("n_reports"),
        gather(~F.col("parsed")).alias("missing_report"), gather(failed).alias("missing_response"),
    )


def rule_averages(scored: DataFrame, keys: list[str], scores: str = "sub_scores") -> DataFrame:
    """Mean of each rule over all rows; a row without the rule counts as 0."""
    n = scored.groupBy(*keys).agg(F.count("*").alias("n"))
    # explode_outer: explode would test the map in a filter of its own, and so compute all scores twice
    rules = scored.select(*keys, F.explode_outer(scores).alias("rule", "score")).where("rule IS NOT NULL").groupBy(*keys, "rule").agg(F.sum("score").alias("total"))
    joined = rules.join(n, keys) if keys else rules.crossJoin(n)  # n has one row without keys
    return joined.select(*keys, "rule", (F.col("total") / F.col("n")).alias("average"))


def compare_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules that both tables have, with the change."""
    return before.select("rule", F.col("average").alias("before")).join(after.select("rule", F.col("average").alias("after")), "rule").withColumn("change", F.col("after") - F.col("before"))


def run_summary(boards: DataFrame, keys: list[str]) -> DataFrame:
    """One row a run with its models, best first."""
    entry = F.struct((-F.col("overall")).alias("order"), "model", "overall", "n_reports", "missing_report", "missing_response")
    rows = boards.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("models"))
    return rows.withColumn("models", F.transform("models", lambda m: m.dropFields("order"))).withColumn("created_at", F.current_timestamp())


def full_summary(judged: DataFrame, runs: DataFrame, item: str = "cluster_index", now: Column | None = None) -> DataFrame:
    """One row a run, as it is filed: what was run, and a result for each of its models in the order given.

    ``runs``: ``run_id``, ``snapshot_id``, ``month``, ``packing_variant``, ``prompt_variant``, ``template`` and ``models``.
    ``judged``: ``run_id``, ``model``, ``item``, ``raw_text`` (null: the call failed), ``parsed``, ``overall``, and
    ``started_at`` and ``ended_at`` of its call. A model's duration is the time from its first call to the end of
    its last, 0 if none is known. A model without any response has an ``error``; responses of other runs or models are left out.
    """
    seconds = F.coalesce(F.max(F.unix_micros("ended_at")) - F.min(F.unix_micros("started_at")), F.lit(0)) / 1e6
    times = judged.groupBy("run_id", "model").agg(seconds.alias("duration"), F.coalesce(F.max("parsed"), F.lit(False)).alias("parsed_output"))
    results = leaderboard(judged, ["run_id", "model"], item).join(times, ["run_id", "model"])
    asked = runs.select("run_id", F.posexplode("models").alias("_at", "model"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(results.schema[c].dataType)).alias(c)
    one = F.struct(
        "_at", "model", F.struct(F.coalesce("overall", F.lit(0.0)).alias("overall")).alias("scores"), F.coalesce("duration", F.lit(0.0)).alias("duration"),
        F.coalesce("parsed_output", F.lit(False)).alias("parsed_output"), none("missing_report"), none("missing_response"),
        F.concat(F.lit("responses/"), F.replace("model", F.lit("/"), F.lit("_")), F.lit(".json")).alias("response_file"), F.when(F.col("n_reports").isNull(), F.lit("no responses")).alias("error"),
    )
    filed = asked.join(results, ["run_id", "model"], "left").groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("model_results"))
    return runs.join(filed, "run_id", "left").select(
        "run_id", "snapshot_id", "month", "packing_variant", "prompt_variant", T.template_hash(F.col("template")).alias("prompt_hash"), F.col("models").alias("models_evaluated"),
        F.transform(F.coalesce("model_results", F.array().cast(filed.schema["model_results"].dataType)), lambda m: m.dropFields("_at")).alias("model_results"),
        (F.current_timestamp() if now is None else now).alias("timestamp"),
    )


# --- two-section reports ----------------------------------------------------------------------

A_STRINGS = ["title", "one_liner", "what_this_topic_is_about", "confidence", "search_query_seed"]
A_LISTS = {"confidence_rationale": (2, 4), "representative_papers": (2, 5), "reading_order": (3, 7), "notes": (0, 5)}
#: Weights of valid JSON, equal titles, cross links, and the mean of the rest.
SECTION_WEIGHTS = (0.35, 0.35, 0.20, 0.10)


def parse_sections(df: DataFrame, raw: str = "raw_text") -> DataFrame:
    """``df`` with ``json_ok``, ``schema_ok``, and structs ``a`` and ``b``, null unless the schema is met."""
    v, path = F.col("_v"), "section_a."
    typed = _and(
        *[_type(v, path + f) == "STRING" for f in A_STRINGS], *[_strings(v, path + f, *b) for f, b in A_LISTS.items()],
        *[_type(v, f"{path}why_it_matters.{f}") == "STRING" for f in ("practical_significance", "research_significance")],
        _type(v, "section_b.title") == "STRING", _type(v, "section_b.summary") == "STRING", _strings(v, "section_b.keyword_list", 5, 12),
    )
    a = F.struct(
        *[_get(v, path + f, "string").alias(f) for f in A_STRINGS], *[_get(v, path + f, "array<string>").alias(f) for f in A_LISTS],
        *[_get(v, f"{path}why_it_matters.{f}", "string").alias(f) for f in ("practical_significance", "research_significance")],
    )
    b = F.struct(_get(v, "section_b.title", "string").alias("title"), _get(v, "section_b.summary", "string").alias("summary"), _get(v, "section_b.keyword_list", "array<string>").alias("keyword_list"))
    rows = df.withColumn("_v", F.try_parse_json(F.col(raw))).withColumn("json_ok", F.col("_v").isNotNull())
    rows = rows.withColumn("_typed", F.coalesce(typed, F.lit(False))).withColumn("a", F.when(F.col("_typed"), a)).withColumn("b", F.when(F.col("_typed"), b))
    rows = rows.withColumn("schema_ok", F.col("_typed") & F.coalesce(section_rules(F.col("a"), F.col("b")), F.lit(False)))
    return rows.drop("_v", "_typed")


def section_rules(a: Column, b: Column) -> Column:
    count = lambda c: T.plain_word_count(T.strip(c))
    every = lambda c, high: F.forall(c, lambda x: T.plain_word_count(x) <= high)
    item = lambda x: (T.item_id(x) != "") & (T.item_rest(x) != "")
    keys = cleaned(b["keyword_list"])
    return _and(
        count(a["title"]) <= 12, T.title_case_strict(T.strip(a["title"])), count(a["one_liner"]) <= 25, within(count(a["what_this_topic_is_about"]), 80, 140),
        T.strip(a["practical_significance"]) != "", T.strip(a["research_significance"]) != "",
        within(count(a["practical_significance"]) + count(a["research_significance"]), 60, 120), a["confidence"].isin(LEVELS),
        every(a["confidence_rationale"], 18), F.forall(a["representative_papers"], item),
        F.forall(a["reading_order"], lambda x: item(x) & (T.plain_word_count(T.item_rest(x)) <= 12)),
        ~F.contains(T.strip(a["search_query_seed"]), F.lit("\n")) & within(F.size(T.terms(a["search_query_seed"])), 2, 5), every(a["notes"], 20),
        F.length(b["title"]) > 0, F.length(b["summary"]) > 0, within(count(b["summary"]), 60, 110), within(F.size(keys), 5, 12),
        F.size(F.array_distinct(keys)) == F.size(keys), F.forall(keys, lambda k: within(F.size(T.terms(k)), 1, 3) & ~F.contains(k, F.lit("#"))),
    )


def link_sentences(about: Column) -> Column:
    """The number of sentences that cite two papers or more."""
    return F.size(F.filter(T.sentences(about), lambda s: F.size(F.array_distinct(T.citations(s))) >= 2))


def cross_links(about: Column) -> Column:
    n = link_sentences(about)
    return F.when(n.between(2, 4), F.lit(1.0)).when(n.isin(1, 5), F.lit(0.5)).otherwise(F.lit(0.0))


def fields_cite(fields: list[Column], ids: Column) -> Column:
    """Every field cites at least one paper, and only given ones."""
    return _and(*[(F.size(T.citations(f)) >= 1) & (F.size(F.array_except(F.array_distinct(T.citations(f)), ids)) == 0) for f in fields])


def heuristic(df: DataFrame, raw: str = "raw_text", ranks: str = "ranks") -> DataFrame:
    """``df`` with ``sub_scores`` and ``overall`` of two-section reports; ``ranks`` maps the cluster's ids to ranks.

    A null map (bad input) scores 0, broken JSON 0, a broken schema 0.35.
    """
    p = parse_sections(df, raw)
    a, b, known = F.col("a"), F.col("b"), F.col(ranks)
    order = lambda c: F.when(ranks_rise(F.transform(c, T.item_id), known), F.lit(1.0)).otherwise(F.lit(0.7))
    cites = fields_cite([a["what_this_topic_is_about"], a["practical_significance"], a["research_significance"], b["summary"]], F.map_keys(known))
    p = p.withColumns({
        "title_match": (T.strip(a["title"]) == T.strip(b["title"])).cast("double"), "citations_ok": F.coalesce(cites, F.lit(False)).cast("double"),
        "cross_links": cross_links(a["what_this_topic_is_about"]), "rep_order": order(a["representative_papers"]), "reading_order_ok": order(a["reading_order"]),
    })
    rest = (1 + F.col("citations_ok") + F.col("rep_order") + F.col("reading_order_ok")) / 4
    w = SECTION_WEIGHTS
    full = w[0] + w[1] * F.col("title_match") + w[2] * F.col("cross_links") + w[3] * rest
    overall = F.when(known.isNull() | ~F.col("json_ok"), F.lit(0.0)).when(~F.col("schema_ok"), F.lit(w[0])).otherwise(full)
    names = ["title_match", "citations_ok", "cross_links", "rep_order", "reading_order_ok"]
    ok = F.col("schema_ok") & known.isNotNull()
    entries = F.array(
        F.struct(F.lit("valid_json_format").alias("k"), F.when(known.isNotNull(), F.col("json_ok").cast("double")).alias("v")),
        F.struct(F.lit("schema_valid").alias("k"), F.when(known.isNotNull() & F.col("json_ok"), F.col("schema_ok").cast("double")).alias("v")),
        *[F.struct(F.lit(n).alias("k"), F.when(ok, F.col(n)).alias("v")) for n in names],
    )
    return p.withColumn("sub_scores", F.map_from_entries(F.filter(entries, lambda x: x["v"].isNotNull()))).withColumn("overall", overall).drop(*names)
