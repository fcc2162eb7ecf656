"""License scan: MinHash bands over overlapping text windows, then exact containment.

A text's words (lower case, without punctuation) form five-word shingles. A
window is ``WINDOW`` neighbouring shingles, and one starts at every shingle, so
windows overlap. Templates are cut the same way: an exact passage of ``WINDOW``
shingles or more holds windows equal to a template's, which always collide in
all ``BANDS`` bands of one row. The worst case is a template of one shingle: it
collides in a band if it is the minimum of one of the windows that hold it, with
probability 2 / (WINDOW + 1), so with probability 1 - 0.6**16 = 0.9997 in some.

A band's minimum is taken over ``hash XOR mask``. It is compared inside the scan
with the templates' few hundred band values, and what leaves it is a document's
id and a license, once for each pair. Their texts are then read again for the
exact check; texts are not exploded with the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, if_few

SHINGLE, WINDOW, BANDS = 5, 4, 16
#: What parts words: all below the letters of Latin-1 but a-z and 0-9, and general punctuation.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\xBF\x{2000}-\x{206F}]+"

#: Notices as their stewards word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def masks(bands: int) -> list[int]:
    """A signed 64-bit mask for each band, from powers of an odd constant."""
    out, state = [], 1
    for _ in range(bands):
        state = state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        mixed = (state ^ state >> 31) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        out.append(mixed - (1 << 64) if mixed >> 63 else mixed)
    return out


def literal(value: int) -> str:
    """``value`` in SQL; the least long has no literal of its own."""
    return f"{value}L" if value > -(1 << 63) else f"({value + 1}L - 1L)"


def normal(text: Column) -> Column:
    """Lower case words without ASCII, Latin-1 and general punctuation, parted by one blank."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, " "))


def shingle_hash(tokens: Column, at: Column) -> Column:
    """Of the shingle that starts at ``at``, null past the last one."""
    last = F.get(tokens, at + (SHINGLE - 1))
    return F.when(last.isNotNull(), F.xxhash64(*[F.get(tokens, at + k) for k in range(SHINGLE)]))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license``, its distinct shingles as texts, and ``_tokens``."""
    given = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    tokens = given.select("license", F.split(normal(F.col("body")), " ").alias("_tokens"))
    parts = F.transform(F.sequence(F.lit(1), F.size("_tokens") - (SHINGLE - 1)), lambda i: F.array_join(F.slice("_tokens", i, F.lit(SHINGLE)), " "))
    return tokens.where(F.size("_tokens") >= SHINGLE).select("license", "_tokens", F.array_distinct(parts).alias("shingles"))


def windows(texts: DataFrame, bands: int) -> DataFrame:
    """``texts`` (with ``_tokens``) by window and band: start ``_at``, the band's mask, and its minimum as ``_least``.

    A text's hashes are taken once; inline() of one struct keeps the optimizer
    from fetching them anew in every use.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size("_tokens") - SHINGLE), lambda i: shingle_hash(F.col("_tokens"), i))
    hashed = texts.withColumn("_hashes", hashes).drop("_tokens")
    starts = hashed.select("*", F.explode(F.sequence(F.lit(0), F.size("_hashes") - 1)).alias("_at"))
    own = F.struct(*[F.get("_hashes", F.col("_at") + k).alias(f"_h{k}") for k in range(WINDOW)])
    banded = starts.select("*", F.inline(F.array(own))).drop("_hashes").select("*", F.explode(F.array(*map(F.lit, masks(bands)))).alias("_mask"))
    return banded.withColumn("_least", F.least(*[F.col(f"_h{k}").bitwiseXOR(F.col("_mask")) for k in range(WINDOW)]))


def band_values(templates: DataFrame, bands: int) -> list[tuple[str, int, int]]:
    """License, mask and minimum for every template window and band: rows bounded by the words of the templates."""
    return sorted((r[0], r[1], r[2]) for r in windows(templates.select("license", "_tokens"), bands).select("license", "_mask", "_least").distinct().collect())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``license``, ``containment`` and ``first_word`` where a document holds a license.

    ``containment`` is the share of the template's distinct shingles found in
    the whole document, ``threshold`` at least; ``first_word`` the word at which
    the first colliding window starts. Null and empty texts, and texts under
    five words, hold none; rows with equal ids count as one document; other
    columns are not read. Templates under five words are an error.
    """
    spark = docs.sparkSession
    given = TEMPLATES if templates is None else templates
    table = template_table(spark, given)
    found = band_values(table, bands)
    if len({name for name, _, _ in found}) != len(given):
        raise ValueError(f"templates need at least {SHINGLE} words")
    names = spark.createDataFrame(found, "license string, _mask long, _least long")

    tokens = docs.select(F.col("doc_id").alias("doc_id"), F.split(normal(F.col("text")), " ").alias("_tokens")).where(F.size("_tokens") >= SHINGLE)
    hits = windows(tokens, bands).where("_least IN (" + ", ".join(sorted({literal(v) for _, _, v in found})) + ")").select("doc_id", "_at", "_mask", "_least")
    pairs = checkpointed(hits.join(F.broadcast(names), ["_mask", "_least"]).groupBy("doc_id", "license").agg(F.min("_at").cast("bigint").alias("first_word")))

    asked = pairs.join(F.broadcast(table.select("license", "shingles")), "license").withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text")
    text = texts.join(if_few(asked), texts["doc_id"].eqNullSafe(F.col("_id"))).select("_id", "license", "first_word", "shingles", F.concat(F.lit(" "), normal(F.col("text")), F.lit(" ")).alias("_text"))
    held = F.size(F.filter("shingles", lambda s: F.contains(F.col("_text"), F.concat(F.lit(" "), s, F.lit(" ")))))
    checked = text.select(F.col("_id").alias("doc_id"), "license", "first_word", (held / F.size("shingles")).alias("containment"))
    # inline() keeps the filter from being moved down, where it would check every text twice.
    once = checked.select(F.inline(F.array(F.struct(*checked.columns)))).where(F.col("containment") >= threshold)
    return once.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
