"""Checks of JSON values generated from a JSON schema, as column expressions; the card schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "array<struct<path:string,rule:string>>"
#: JSON types and what Spark calls a variant that holds one.
KINDS = {"object": r"^OBJECT\b", "array": r"^ARRAY\b", "string": "^STRING$", "boolean": "^BOOLEAN$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$", "null": "^VOID$"}
KNOWN = {"type", "required", "properties", "additionalProperties", "minItems", "maxItems", "items", "minLength", "maxLength", "enum", "pattern", "minimum", "maximum", "description", "title", "$schema"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def violations(v: Column, schema: dict, path: Column | None = None) -> Column:
    """What a variant column violates of ``schema``: structs of ``path`` and ``rule`` (the keyword), [] if nothing.

    A null column, which no JSON text parses to, violates ``json``. Of a value of the wrong
    type only ``type`` is told. Lengths count code points; ``integer`` takes no fractions.
    A keyword that is not in ``KNOWN`` raises an error. A text is parsed, and each
    value in it taken from what holds it, once.
    """
    return _let(v, lambda own: _violations(own, schema, path))


def _violations(v: Column, schema: dict, path: Column | None) -> Column:
    at = F.lit("$") if path is None else path
    if unknown := set(schema) - KNOWN:
        raise ValueError(f"unknown keywords {sorted(unknown)}")
    one = lambda rule, where=at: F.array(F.struct(where.alias("path"), F.lit(rule).alias("rule")))
    none = F.array().cast(FAULT)
    found: list[Column] = []

    def unless(good: Column, rule: str, where: Column = at) -> None:
        found.append(F.when(good, none).otherwise(one(rule, where)))

    kind = schema.get("type")
    text = F.try_variant_get(v, "$", "string")
    if "enum" in schema:
        unless(text.isin(*schema["enum"]), "enum")
    if kind == "string":
        bounds = [(n, rule) for rule in ("minLength", "maxLength") if (n := schema.get(rule)) is not None]
        fits = lambda size, n, rule: F.when(size >= n if rule == "minLength" else size <= n, none).otherwise(one(rule))
        if bounds:
            found.append(_let(F.length(text), lambda size: F.concat(none, *[fits(size, n, rule) for n, rule in bounds])))
        if "pattern" in schema:
            unless(text.rlike(schema["pattern"]), "pattern")
    if kind in ("integer", "number"):
        number = F.try_variant_get(v, "$", "double")
        if "minimum" in schema:
            unless(number >= schema["minimum"], "minimum")
        if "maximum" in schema:
            unless(number <= schema["maximum"], "maximum")
    if kind == "array":
        inner = lambda e, i: _violations(e, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))

        def of_items(items: Column) -> Column:
            parts = [none]
            if "minItems" in schema:
                parts.append(F.when(F.size(items) >= schema["minItems"], none).otherwise(one("minItems")))
            if "maxItems" in schema:
                parts.append(F.when(F.size(items) <= schema["maxItems"], none).otherwise(one("maxItems")))
            if "items" in schema:
                parts.append(F.flatten(F.transform(items, inner)))
            return F.concat(*parts)

        found.append(_let(F.try_variant_get(v, "$", "array<variant>"), of_items))
    if kind == "object":
        fields = schema.get("properties", {})

        def of_fields(held: Column) -> Column:
            parts = [none]
            for name in sorted(set(schema.get("required", [])) | set(fields)):
                where, value = F.concat(at, F.lit(f".{name}")), F.try_variant_get(v, f"$['{name}']", "variant")
                missing = one("required", where) if name in schema.get("required", []) else none
                parts.append(F.when(~F.array_contains(held, name), missing).otherwise(violations(value, fields.get(name, {}), where)))
            if schema.get("additionalProperties") is False:
                extra = F.filter(held, lambda k: ~k.isin(*fields)) if fields else held
                parts.append(F.transform(extra, lambda k: F.struct(F.concat(at, F.lit("."), k).alias("path"), F.lit("additionalProperties").alias("rule"))))
            return F.concat(*parts)

        found.append(_let(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), of_fields))
    inside = F.concat(*found) if found else none
    if kind is not None:
        inside = F.when(F.schema_of_variant(v).rlike(KINDS[kind]), inside).otherwise(one("type"))
    return F.when(v.isNull(), one("json")).otherwise(inside) if path is None else inside


def checked(df: DataFrame, schema: dict, raw: str = "raw_text", out: str = "violations") -> DataFrame:
    """``df`` with the violations of the JSON text in ``raw``; null, broken and fenced texts violate ``json``."""
    return df.select("*", violations(F.try_parse_json(F.col(raw)), schema).alias(out))


def text(low: int = 0, high: int | None = None) -> dict:
    return {"type": "string", "minLength": low} | ({} if high is None else {"maxLength": high})


def listed(low: int, high: int | None, items: dict) -> dict:
    return {"type": "array", "minItems": low, "items": items} | ({} if high is None else {"maxItems": high})


def record(optional: dict | None = None, **fields: dict) -> dict:
    return {"type": "object", "required": list(fields), "additionalProperties": False, "properties": fields | (optional or {})}


def _report(cards: dict) -> dict:
    return record(snapshot_id=text(), cluster_run_id=text(), period_start=text(), period_end=text(), cluster_cards=listed(1, None, cards))


def _card(representative: dict, **more: dict) -> dict:
    optional = {k: more.pop(k) for k in ("paper_highlights",) if k in more}
    return record(
        optional, cluster_key=text(), topic_name=text(1, 100), one_liner=text(1, 220), tags=listed(3, 7, text(1, 40)), what_this_cluster_is_about=text(1, 1200), why_it_matters=text(1, 1200),
        confidence={"type": "string", "enum": ["high", "medium", "low"]}, confidence_rationale=text(1, 300), representative_papers=listed(1, 5, record(**representative, reason_representative=text(1, 300))),
        reading_order=listed(1, 10, record(paper_id=text(), url=text(), why_read_next=text(1, 220))), search_query_seed=text(1, 200), notes=text(0, 600), **more,
    )


#: The fields and bounds of plain and rich cards.
PLAIN_CARDS = _report(_card({"paper_id": text()}))
RICH_CARDS = _report(
    _card(
        {"paper_id": text(), "title": text(), "url": text()},
        cluster_highlights=listed(3, 9, text(1, 220)),
        paper_highlights=listed(0, 5, record(paper_id=text(), url=text(), highlights=listed(1, 6, text(1, 220)), future_work=listed(0, 4, text(1, 220)))),
    )
)
