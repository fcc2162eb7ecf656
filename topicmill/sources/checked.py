"""Readers that keep bad input beside the good: every row has ``fault``, null if it can be used, and ``value``, what was read where it can't.

Nothing is dropped and nothing raises: one broken file, month or item leaves the
others as they are. ``good`` and ``rejected`` split the rows; ``sinks.write_checked``
writes both in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_date
from .schemas import FLAT, FLAT_ROWS, PAPER_ITEM, PAYLOAD


def good(rows: DataFrame) -> DataFrame:
    """The rows without a fault, as the plain readers return them."""
    return rows.where(F.col("fault").isNull()).drop("fault", "value")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("fault").isNotNull())


def _kind(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _first(*cases: tuple[Column, str]) -> Column:
    """The text of the first case that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, text in reversed(cases):
        out = F.when(condition, F.lit(text)).otherwise(out)
    return out


def _text_of(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def paper_fault(item: Column) -> Column:
    """What is wrong with a variant as a paper: not an object, no text as id, or a field of another type; null is no fault but for the id."""
    right = {"string": "^(STRING|VOID)$", "array<string>": "^(ARRAY<(STRING|VOID)>|VOID)$"}
    fields = [(~_kind(item, f"$.{name}").rlike(right[kind]), f"wrong type: {name}") for name, kind in PAPER_ITEM.items() if name != "id"]
    return _first((~_kind(item).startswith("OBJECT"), "not an object"), (_kind(item, "$.id") != "STRING", "no id"), *fields)


def _paper(item: Column) -> Column:
    return F.struct(*[F.try_variant_get(item, f"$.{name}", kind).alias(name) for name, kind in PAPER_ITEM.items()])


def dumps(spark: SparkSession, path: str) -> DataFrame:
    """Dumps of months, a file each: ``file``, ``month_key``, ``pos``, ``paper``, ``fault``, ``value``.

    Faults of a file: not JSON, no papers (no object of months); of a month: not
    a list; of an item: no "paper", or a ``paper_fault``. An empty month has no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value", F.try_parse_json("value").alias("v"))
    held = files.withColumn("months", F.try_variant_get("v", "$.papers", "map<string,variant>"))
    whole = held.withColumn("fault", _first((F.col("v").isNull(), "not JSON"), (F.col("months").isNull(), "no papers")))
    broken = whole.where("fault IS NOT NULL").select("file", F.lit(None).cast("string").alias("month_key"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("item"), "fault", "value")
    months = whole.where("fault IS NULL").select("file", F.explode("months").alias("month_key", "month")).withColumn("items", F.try_variant_get("month", "$", "array<variant>"))
    # A month that is no list is kept as one row, under position null.
    each = months.select("file", "month_key", F.posexplode(F.coalesce("items", F.array("month"))).alias("pos", "item"), F.when(F.col("items").isNull(), F.lit("month is not a list")).alias("fault"))
    paper = F.try_variant_get("item", "$.paper", "variant")
    told = F.coalesce("fault", F.when(paper.isNull(), F.lit("no paper")), paper_fault(paper))
    each = each.select("file", "month_key", F.when(F.col("fault").isNull(), F.col("pos")).alias("pos"), "item", told.alias("fault"), F.lit(None).cast("string").alias("value"))
    both = broken.union(each)
    bad = F.col("fault").isNotNull()
    return both.select("file", "month_key", "pos", F.when(~bad, _paper(F.try_variant_get("item", "$.paper", "variant"))).alias("paper"), "fault", F.when(bad, F.coalesce("value", _text_of(F.col("item")))).alias("value"))


def responses(texts: DataFrame, body: str = "body") -> DataFrame:
    """As ``readers.responses``: columns of ``texts``, ``pos``, ``paper`` (a struct), ``fault`` and ``value``.

    Faults of a text: not JSON (null, too), no list of papers; of an item: a
    ``paper_fault``. A text with an empty list has no rows.
    """
    rest = [F.col(f"`{c}`") for c in texts.columns if c != body]
    own = texts.select(F.struct(*rest).alias("_rest"), F.col(f"`{body}`").alias("_body"), F.try_parse_json(F.col(f"`{body}`")).alias("_v"))
    lists = own.withColumn("_items", F.coalesce(F.try_variant_get("_v", "$.paper", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>")))
    fault = _first((F.col("_v").isNull(), "not JSON"), (F.col("_items").isNull(), "no list of papers"))
    # A text that can't be read is kept as one item, null.
    rows = lists.select("_rest", fault.alias("_fault"), F.when(F.col("_items").isNull(), F.coalesce("_body", F.lit(""))).alias("_value"), F.posexplode(F.coalesce("_items", F.array(F.lit(None).cast("variant")))).alias("_pos", "_item"))
    item = F.coalesce(F.try_variant_get("_item", "$.paper", "variant"), F.col("_item"))
    read = rows.select("_rest", F.when(F.col("_fault").isNull(), F.col("_pos")).alias("pos"), item.alias("_paper"), "_item", "_fault", "_value")
    told = read.withColumn("fault", F.coalesce("_fault", paper_fault(F.col("_paper"))))
    bad = F.col("fault").isNotNull()
    return told.select("_rest.*", "pos", F.when(~bad, _paper(F.col("_paper"))).alias("paper"), "fault", F.when(bad, F.coalesce("_value", _text_of(F.col("_item")))).alias("value"))


def payloads(spark: SparkSession, glob: str) -> DataFrame:
    """Cluster payloads, a file each, as ``readers.payloads``, with ``fault`` and ``value``; no files, no rows.

    Faults: not of the schema (broken, or a field of another type), no source, a
    period that is no pair of dates in order, no configuration, no papers, no clusters.
    """
    read = spark.read.schema(f"{PAYLOAD}, value string").option("columnNameOfCorruptRecord", "value").json(glob, multiLine=True)
    rows = read.withColumn("file", F.col("_metadata.file_name"))
    start, end = F.col("period_start"), F.col("period_end")
    dated = F.coalesce(is_date(start) & is_date(end) & (start <= end), F.lit(False))
    fault = _first(
        (F.col("value").isNotNull(), "not of the schema"), (F.coalesce("source", F.lit("")) == "", "no source"), (~dated, "bad period"),
        (F.col("embed_config.embed_config_id").isNull() | F.col("cluster_config.cluster_config_id").isNull(), "no configuration"), (F.col("papers").isNull(), "no papers"), (F.col("clusters").isNull(), "no clusters"),
    )
    told = rows.withColumn("fault", fault)
    whole = F.to_json(F.struct(*[c for c in rows.columns if c not in ("value", "file")]))
    return told.withColumn("value", F.when(F.col("fault").isNotNull(), F.coalesce("value", whole)))


def payload_rows(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows as ``readers.payload_rows``, with ``fault`` and ``value`` (the line); files of any size, a fault costs one line."""
    rows = spark.read.schema(f"{FLAT_ROWS}, value string").option("columnNameOfCorruptRecord", "value").json(path)
    fits = F.coalesce(*[F.when(F.col("kind") == k, F.col(k).isNotNull()) for k in FLAT], F.lit(False))
    fault = _first((F.col("value").isNotNull(), "not of the schema"), (F.col("payload_id").isNull(), "no payload_id"), (~fits, "no row of its kind"))
    told = rows.withColumn("fault", fault)
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != "value"]))
    return told.withColumn("value", F.when(F.col("fault").isNotNull(), F.coalesce("value", whole)))


def cluster_lists(texts: DataFrame, body: str = "body") -> DataFrame:
    """As ``readers.cluster_lists``, with ``fault`` and ``value`` instead of an error: columns of ``texts``, ``pos``, ``cluster`` (a variant)."""
    rest = [F.col(f"`{c}`") for c in texts.columns if c != body]
    own = texts.select(F.struct(*rest).alias("_rest"), F.col(f"`{body}`").alias("_body"), F.try_parse_json(F.col(f"`{body}`")).alias("_v"))
    lists = own.withColumn("_items", F.coalesce(F.try_variant_get("_v", "$.clusters", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>")))
    fault = _first((F.col("_v").isNull(), "not JSON"), (F.col("_items").isNull(), "no list of clusters"))
    rows = lists.select("_rest", fault.alias("_fault"), "_body", F.posexplode(F.coalesce("_items", F.array(F.lit(None).cast("variant")))).alias("_pos", "cluster"))
    told = rows.withColumn("fault", F.coalesce("_fault", F.when(~_kind(F.col("cluster")).startswith("OBJECT"), F.lit("not an object"))))
    bad = F.col("fault").isNotNull()
    return told.select("_rest.*", F.when(F.col("_fault").isNull(), F.col("_pos")).alias("pos"), F.when(~bad, F.col("cluster")).alias("cluster"), "fault", F.when(bad, F.when(F.col("_fault").isNull(), _text_of(F.col("cluster"))).otherwise(F.coalesce("_body", F.lit("")))).alias("value"))
