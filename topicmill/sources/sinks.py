"""Writers of payloads, reports, run outputs, memory tables and best-run cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate


def write_payloads(payloads: DataFrame, path: str) -> None:
    payloads.withColumn("period", F.col("period_start")).write.mode("overwrite").partitionBy("period").json(path)


def write_payload_rows(rows: DataFrame, path: str) -> None:
    """Typed rows of flat payloads (``packing.typed_rows``) as JSON lines, each with its key, in as many files as there are tasks."""
    rows.write.mode("overwrite").json(path)


def write_checked(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write rows of ``sources.checked`` in one pass, good and rejected ones in folders of their own, and read both back."""
    rows.withColumn("rejected", F.col("fault").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(path)
    written = rows.sparkSession.read.schema(f"{rows.schema.toDDL()}, rejected boolean").parquet(path)
    return written.where(~F.col("rejected")).drop("fault", "value", "rejected"), written.where("rejected").drop("rejected")


def _lines(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each line of ``piece``s, which end in a line break: keys, ``place`` (with the line's number in it) and ``line``."""
    split = pieces.select(*keys, "place", F.posexplode(F.split(F.expr("substring(piece, 1, length(piece) - 1)"), "\n")).alias("_no", "line"))
    return split.select(*keys, F.struct("place.*", F.col("_no").alias("no")).alias("place"), "line")


def report_lines(members: DataFrame, keys: list[str], header: str = "", max_chars: int = 350) -> DataFrame:
    """The lines of a text for each period: clusters by size, members by rank, summaries cut.

    ``members``: keys, ``label``, ``rank_in_cluster``, ``paper_id``, ``title``, ``summary``, ``url``.
    A row holds one line, and ``place`` orders the lines of a period, so a period may be of any size.
    A null label, id or title reads as ''; no members, no lines.
    """
    short = truncate(F.col("summary"), max_chars)
    paper = F.concat(
        F.lit("\n["), F.coalesce(F.col("paper_id").cast("string"), F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"),
        F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("URL: "), F.col("url"), F.lit("\n"))).otherwise(F.lit("")),
        F.when(short != "", F.concat(F.lit("Summary: "), short, F.lit("\n"))).otherwise(F.lit("")),
    )
    sizes = members.groupBy(*keys, "label").agg(F.count("*").alias("_size"))
    none = lambda kind: F.lit(None).cast(kind)
    kind = {c: members.schema[c].dataType for c in ("label", "rank_in_cluster")}
    place = lambda size, label, rank, tie: F.struct(size.alias("size"), label.alias("label"), rank.alias("rank"), tie.alias("tie")).alias("place")
    bar = F.lit("\n" + "-" * 90 + "\nCluster ")
    heads = sizes.select(*keys, place(-F.col("_size"), F.col("label"), none(kind["rank_in_cluster"]), none("string")), F.concat(bar, F.coalesce(F.col("label").cast("string"), F.lit("")), F.lit(" | size="), F.col("_size").cast("string"), F.lit("\n")).alias("piece"))
    on = [*keys, "label"]
    counted = sizes.select(*[F.col(c).alias(f"_key{k}") for k, c in enumerate(on)], "_size")
    same = [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(on)]
    papers = members.join(counted, same).select(*keys, place(-F.col("_size"), F.col("label"), F.col("rank_in_cluster"), F.col("paper_id").cast("string")), paper.alias("piece"))
    pieces = heads.union(papers)
    if header:
        title = F.lit("\n" + "=" * 90 + "\n" + header + "\n").alias("piece")
        pieces = pieces.union(sizes.select(*keys).distinct().select(*keys, place(none("long"), none(kind["label"]), none(kind["rank_in_cluster"]), none("string")), title))
    return _lines(pieces, keys)


def month_lines(papers: DataFrame) -> DataFrame:
    """The lines of a text for each month, as ``report_lines``; fields that are missing read N/A.

    ``papers``: ``month_key``, ``pos``, ``id``, ``title``, ``summary``, ``ai_summary``.
    """
    part = lambda name: F.concat(F.lit(f"   {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("N/A")), F.lit("\n"))
    body = F.concat(*[part(n) for n in ("title", "summary", "id", "ai_summary")], F.lit("\n"))
    items = papers.select("month_key", F.struct(F.col("pos").cast("long").alias("pos")).alias("place"), body.alias("piece"))
    totals = papers.groupBy("month_key").agg(F.count("*").alias("n"))
    heads = totals.select("month_key", F.struct(F.lit(None).cast("long").alias("pos")).alias("place"), F.concat(F.coalesce("month_key", F.lit("")), F.lit(" total "), F.col("n").cast("string"), F.lit(" papers:\n")).alias("piece"))
    return _lines(items.union(heads), ["month_key"])


def joined(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One ``report`` a period, for periods that one row can hold; ``write_lines`` has no such limit."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return lines.groupBy(*keys).agg(F.concat(F.array_join(in_order, "\n"), F.lit("\n")).alias("report"))


def text_report(members: DataFrame, keys: list[str], header: str = "", max_chars: int = 350) -> DataFrame:
    """``report_lines`` as one text a period, for periods that one row can hold."""
    return joined(report_lines(members, keys, header, max_chars), keys)


def month_text(papers: DataFrame) -> DataFrame:
    """``month_lines`` as one text a month, for months that one row can hold."""
    return joined(month_lines(papers), ["month_key"])


def write_lines(lines: DataFrame, path: str, keys: list[str], parts: int | None = None, lines_per_file: int = 1_000_000) -> None:
    """Write ordered lines as text files: a folder for each period, in it files whose names sort as their lines do.

    Ranges of (keys, place) go to one task each, so a long period is written by
    many tasks, in files of ``lines_per_file`` at most. A null key is written as ''.
    """
    named = lines.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in keys], "place", "line")
    ranged = named.repartitionByRange(*([parts] if parts else []), *keys, "place").sortWithinPartitions(*keys, "place")
    writer = ranged.drop("place").write.mode("overwrite").partitionBy(*keys)
    writer.option("maxRecordsPerFile", lines_per_file).option("lineSep", "\n").text(path)


def write_texts(reports: DataFrame, path: str, column: str = "report", order: list[str] | None = None) -> None:
    rows = reports.orderBy(*order) if order else reports
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_run(tables: dict[str, DataFrame], path: str) -> None:
    """Responses, judgements and summary of runs; a run that is written again replaces its partition."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def write_memory(tables: dict[str, DataFrame], folder: str, version: str) -> str:
    """Write a new version of the memory beside the old ones, which other readers may hold."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    return f"{folder}/{version}"


def card_rows(cards: DataFrame) -> DataFrame:
    """Best-run cards as JSON, with the name under which each is written."""
    name = F.concat_ws("_", F.lit("best_run"), "source", "period_start", "period_end")
    return cards.select(name.alias("name"), F.to_json(F.struct("*")).alias("value"))


def write_cards(cards: DataFrame, path: str) -> None:
    card_rows(cards).write.mode("overwrite").partitionBy("name").text(path)
