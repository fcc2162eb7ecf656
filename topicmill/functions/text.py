"""Text rules as column expressions. "Strip" means all white space, as in most scripting languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a word (with inner apostrophes and hyphens), and as a plain word.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
PLAIN_WORD = r"[\p{L}\p{N}_]+"
SMALL_WORDS = ["a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with"]
INLINE = r"\[[^\[\]]+\]"
CITED = r"\[([A-Za-z0-9._:-]+)\]"
ITEM = r"(?s)^\[([A-Za-z0-9._:-]+)\]\s+(.+)$"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def embedding_text(title: Column, summary: Column, keywords: Column, mode: str, top_n: int = 10) -> Column:
    """Mode A: title and summary; B: with the first ``top_n`` keywords; C: with all of them."""
    base = strip(F.concat(F.lit("TITLE: "), F.coalesce(title, F.lit("")), F.lit("\nSUMMARY: "), F.coalesce(summary, F.lit(""))))
    if mode == "A":
        return base
    if mode not in ("B", "C"):
        raise ValueError(f"unknown text mode {mode!r}")
    words = F.coalesce(keywords, F.array().cast("array<string>"))
    chosen = F.slice(words, 1, top_n) if mode == "B" else words
    return F.when(F.size(words) > 0, F.concat(base, F.lit("\nKEYWORDS: "), F.array_join(chosen, ", "))).otherwise(base)


def iso_date(c: Column) -> Column:
    """The date as written in an ISO time, without a shift of time zone; '' if missing or bad."""
    return F.when(F.try_to_timestamp(c).isNotNull(), F.substring(c, 1, 10)).otherwise(F.lit(""))


def is_date(c: Column) -> Column:
    """Whether ``c`` is a date written YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def period_bounds(month_key: Column) -> tuple[Column, Column]:
    """First and last day of ``month=YYYY-MM``, as text; an error for any other key."""
    good = month_key.rlike(r"^month=\d{4}-(0[1-9]|1[0-2])$")
    first = F.to_date(F.substring(F.when(good, month_key).otherwise(F.raise_error(F.concat(F.lit("bad month key: "), F.coalesce(month_key, F.lit("null"))))), 7, 7), "yyyy-MM")
    return F.date_format(first, "yyyy-MM-dd"), F.date_format(F.last_day(first), "yyyy-MM-dd")


def paper_id(c: Column, prefix: str = "hf") -> Column:
    return F.concat(F.lit(prefix + ":"), c)


def piped(*parts: Column | str) -> Column:
    """Ids of snapshots, runs and variants: parts joined by bars."""
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def cluster_id(run_id: Column, index: Column) -> Column:
    return F.concat(run_id, F.lit("|c"), index.cast("string"))


def config_id(name: str, version: str) -> str:
    return f"{name}|{version}"


def keywords_normal(c: Column) -> Column:
    """Stripped, lower case, without empty ones."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x != "")


def truncate(c: Column, n: int = 350) -> Column:
    s = strip(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def keywords_to_json(c: Column) -> Column:
    return F.to_json(c)


def keywords_from_json(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), 0))


def plain_word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PLAIN_WORD), 0))


def terms(c: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def title_case(c: Column) -> Column:
    """No colon; the first word and all later big words begin in upper case, later small words in lower case."""
    words = terms(c)

    def fits(w: Column) -> Column:
        upper = w.rlike(r"^\p{Lu}")
        return F.when(F.lower(w).isin(SMALL_WORDS), ~upper).otherwise(upper)

    rest = F.slice(words, 2, 1 << 30)
    return F.when(F.size(words) == 0, F.lit(False)).otherwise(
        ~F.contains(F.coalesce(c, F.lit("")), F.lit(":")) & F.get(words, F.lit(0)).rlike(r"^\p{Lu}") & F.forall(rest, fits)
    )


def title_case_strict(c: Column) -> Column:
    """No colon; every letter that follows a letter is in lower case, every other one is not."""
    t = F.coalesce(c, F.lit(""))
    return ~F.contains(t, F.lit(":")) & ~t.rlike(r"(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}") & ~t.rlike(r"(?<=[\p{Lu}\p{Ll}\p{Lt}])[\p{Lu}\p{Lt}]")


def has_citation(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(INLINE)


def citations(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITED), 1)


def item_id(c: Column) -> Column:
    """The id of '[id] rest', else ''."""
    return F.regexp_extract(strip(c), ITEM, 1)


def item_rest(c: Column) -> Column:
    return strip(F.regexp_extract(strip(c), ITEM, 2))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def names_cluster(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)\b(cluster|clustering)\b")


def unique_ignoring_case(c: Column) -> Column:
    """The number of distinct items, whatever their case."""
    return F.size(F.array_distinct(F.transform(c, F.lower)))


def distinct_first(c: Column) -> Column:
    """Items in order of their first occurrence."""
    return F.array_distinct(c)


def prompt(template: str, **parts: Column) -> Column:
    """``template`` with each ``{{NAME}}`` replaced by the column of that name."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def template_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def token_estimate(c: Column, expected_output: int = 512) -> Column:
    return (F.greatest(F.lit(1), F.floor(F.length(c) / 4)) + expected_output).cast("bigint")


def run_id(month: Column, pack: Column, prompt_name: Column, model: Column, temperature: Column, digest: Column) -> Column:
    return F.concat_ws(
        "__", month, pack, prompt_name, F.replace(model, F.lit("/"), F.lit("_")),
        F.concat(F.lit("t"), F.replace(temperature.cast("string"), F.lit("."), F.lit("_"))), F.substring(digest, 1, 8),
    )


def links(html: Column, pattern: str, partial: str | None = None) -> Column:
    """Targets of a page's anchors that match ``pattern``, each once, in order.

    The target of a shortened link is read from the anchor's text, without its
    blanks and dots of truncation. If that has no full address, one is built of
    the groups of ``partial``: scheme (https if absent), host, and id.
    """
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), 0)

    def target(a: Column) -> Column:
        href = F.regexp_extract(a, ANCHOR, 1)
        shown = F.replace(F.replace(F.regexp_replace(F.regexp_extract(a, ANCHOR, 2), "<[^>]*>", ""), F.lit("...")), F.lit(" "))
        read = F.regexp_extract(shown, pattern, 0)
        if partial:
            scheme, host, key = (F.regexp_extract(shown, partial, k) for k in (1, 2, 3))
            built = F.concat(F.when(scheme == "", F.lit("https://")).otherwise(scheme), host, F.lit("/"), key)
            read = F.when((read == "") & (key != ""), built).otherwise(read)
        return F.when(F.contains(href, F.lit("t.co/")), read).otherwise(F.when(href.rlike(pattern), href).otherwise(F.lit("")))

    return F.array_distinct(F.filter(F.transform(anchors, target), lambda x: x != ""))


#: Anchors, and addresses of papers, whole or without scheme.
ANCHOR = r'(?s)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
PAPER_LINK = r"https?://(?:arxiv\.org|huggingface\.co/papers)/[^\s]*\d{4}\.\d{5}"
PARTIAL_LINK = r"(https?://)?(arxiv\.org|huggingface\.co/papers)/[^\s]*?(\d{4}\.\d{5,})"
