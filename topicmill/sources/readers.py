"""Readers of dumps, payloads, cluster lists and memory tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_date
from .schemas import DUMP, FLAT_ROWS, PAYLOAD, TABLES


def month_dump(spark: SparkSession, path: str, month_key: str | None = None) -> DataFrame:
    """Papers of all months of a dump, or of one, which must exist: ``month_key``, ``pos``, ``paper``."""
    rows = spark.read.schema(DUMP).json(path, multiLine=True).select(F.explode("papers").alias("month_key", "items"))
    if month_key is not None:
        rows = rows.where(F.col("month_key") == month_key)
        if rows.isEmpty():
            raise ValueError(f"no {month_key} in {path}")
    return rows.select("month_key", F.posexplode("items").alias("pos", "item")).select("month_key", "pos", F.col("item.paper").alias("paper"))


def responses(texts: DataFrame, body: str = "body") -> DataFrame:
    """Items of JSON responses of either shape: ``{"paper": [..]}`` or ``[..]``; each item wrapped in "paper" or not.

    Other shapes and broken JSON have no items. Items come as variants.
    """
    v = F.try_parse_json(F.col(body))
    items = F.coalesce(F.try_variant_get(v, "$.paper", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    rest = [F.col(f"`{c}`") for c in texts.columns if c != body]
    rows = texts.select(*rest, F.posexplode(items).alias("pos", "_item"))
    return rows.withColumn("item", F.coalesce(F.try_variant_get(F.col("_item"), "$.paper", "variant"), F.col("_item"))).drop("_item")


def item_fields(items: DataFrame) -> DataFrame:
    """``items`` with the fields of a paper taken from the variant."""
    get = lambda name, kind="string": F.try_variant_get(F.col("item"), f"$.{name}", kind).alias(name)
    rest = [c for c in items.columns if c != "item"]
    return items.select(*rest, get("id"), get("title"), get("summary"), get("ai_keywords", "array<string>"), get("publishedAt"), get("ai_summary"))


def normal_papers(papers: DataFrame, base_url: str = "https://huggingface.co/papers/") -> DataFrame:
    """Dump items (``month_key``, ``pos``, ``paper``) as papers with defaults filled in."""
    p = lambda n: F.col(f"paper.{n}")
    return papers.select(
        "month_key", "pos", p("id").alias("pid"), p("title").alias("title"), p("summary").alias("summary"),
        F.coalesce(p("ai_keywords"), F.array().cast("array<string>")).alias("keywords"),
        F.concat(F.lit(base_url), p("id")).alias("url"), iso_date(p("publishedAt")).alias("published_at"),
    )


def payloads(spark: SparkSession, glob: str) -> DataFrame:
    """Cluster payloads of one or many files, with their file's name; an error if there are none."""
    found = spark.read.schema(PAYLOAD).json(glob, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    if found.isEmpty():
        raise ValueError(f"no payloads at {glob}")
    return found


def payload_rows(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows that ``sinks.write_payload_rows`` wrote, for ``packing.flat_of``."""
    return spark.read.schema(FLAT_ROWS).json(path)


def cluster_lists(texts: DataFrame, body: str = "body") -> DataFrame:
    """Clusters of JSON texts, ``[..]`` or ``{"clusters": [..]}``, as variants; any other shape is an error."""
    v = F.try_parse_json(F.col(body))
    items = F.coalesce(F.try_variant_get(v, "$.clusters", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    checked = F.when(items.isNotNull(), items).otherwise(F.raise_error(F.lit("expected a list of clusters or {'clusters': [..]}")).cast("array<variant>"))
    rest = [F.col(f"`{c}`") for c in texts.columns if c != body]
    return texts.select(*rest, F.posexplode(checked).alias("pos", "cluster"))


def text_lines(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Lines that ``sinks.write_lines`` wrote: keys, ``place`` (orders the lines of a period) and ``line``."""
    schema = ", ".join(["value string", *[f"`{c}` string" for c in keys]])
    rows = spark.read.schema(schema).option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return rows.select(*keys, place.alias("place"), F.col("value").alias("line"))


def if_written(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A Parquet table; empty if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def memory_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A memory table; empty if it was never written."""
    return if_written(spark, TABLES[name][0], f"{folder}/{name}")


def memory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: memory_table(spark, folder, name) for name in TABLES}
