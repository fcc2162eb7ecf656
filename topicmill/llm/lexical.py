"""Ranked lexical search: the best documents of each item, by term-at-a-time evaluation with limited accumulators.

The terms of an item are taken rarest first. An accumulator is the partial score
of a document that holds one of the terms taken so far. Once the greatest scores
that the remaining terms can give add up to less than the k-th partial score, no
other document can still be among the best k: from then on no accumulator is
created, and those left are only updated, exactly. The partial scores of the k
leaders are completed after each round, which raises the k-th and stops earlier.

All items advance together. A round takes the next terms of each open item,
twice as many as the round before, so the rounds grow with the logarithm of an
item's length. Accumulators are rows, dealt by item and document. Only the terms
of items are looked for in documents; a document's counts are one row, which
rounds read without its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, if_few, small_batches, stored
from .runs import runs

#: The bytes of terms, ASCII digits and letters and all of other characters.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
#: The most terms of items, and bytes of them, that tasks look up by themselves; more are joined.
FEW, FEW_BYTES = 1 << 18, 1 << 23


def inside(data: np.ndarray) -> np.ndarray:
    return INSIDE[data]


def tallied(texts: pa.Array, vocabulary: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Terms with repeats of each row; then row, term and occurrences of each row's terms, by row.

    With a ``vocabulary`` only its terms are listed, by their place in it and each
    once. Without, a row that is cut in several segments may list a term for each.
    """
    sizes = np.zeros(len(texts), np.int64)
    rows, terms, counts = [], [], []
    for words, row in runs(texts, inside):
        sizes += np.bincount(row, minlength=len(sizes))
        if vocabulary is None:
            coded = words.dictionary_encode()
            number, names = coded.indices.to_numpy(), coded.dictionary
        else:
            found = pc.index_in(words, value_set=vocabulary)
            held = found.is_valid().to_numpy(zero_copy_only=False)
            number, names, row = found.drop_null().to_numpy(), None, row[held]
        if len(number):
            width = int(number.max()) + 1
            own, n = np.unique(row.astype(np.int64) * width + number, return_counts=True)
            rows.append(own // width)
            terms.append(own % width if names is None else names.take(pa.array(own % width)))
            counts.append(n)
    if not rows:
        return sizes, np.zeros(0, np.int64), pa.array([], pa.large_string() if vocabulary is None else pa.int64()), np.zeros(0, np.int64)
    rows, counts = np.concatenate(rows), np.concatenate(counts)
    if vocabulary is None:
        order = np.argsort(rows, kind="stable")
        return sizes, rows[order], pa.concat_arrays(terms).take(pa.array(order)), counts[order]
    keys, ends = np.unique(rows * len(vocabulary) + np.concatenate(terms), return_inverse=True)
    return sizes, keys // len(vocabulary), pa.array(keys % len(vocabulary)), np.bincount(ends, counts).astype(np.int64)


def counted(texts: DataFrame, key: str, vocabulary: tuple[pa.Array, pa.Array] | None) -> DataFrame:
    """``row`` (a number of its own), ``key``, ``n`` (terms), ``terms`` and ``tfs`` of each text with a term; see ``tallied``.

    ``vocabulary`` holds terms and the numbers to give for them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None  # FEW terms, FEW_BYTES
    kind = "string" if vocabulary is None else "long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = shared.value if shared else (None, None)
        for batch in small_batches(batches):
            sizes, rows, terms, counts = tallied(batch.column(2), words)
            terms = terms.cast(pa.string()) if numbers is None else numbers.take(terms)
            ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), values) for values in (terms, pa.array(counts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), *lists], ["row", key, "n", "terms", "tfs"]).filter(pa.array(sizes > 0))

    kind_of_key = texts.schema[key].dataType.simpleString()
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), key, "text")
    return stored(numbered.mapInArrow(count, f"row long, {key} {kind_of_key}, n long, terms array<{kind}>, tfs array<long>"))


def flat(held: DataFrame, *more: str) -> DataFrame:
    """``row``, ``term`` and ``tf``: a row for each text and term."""
    each = held.select("row", *more, F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})
    return each.groupBy("row", *more, "term").agg(F.sum("tf").alias("tf"))


def vocabulary_of(terms: DataFrame) -> tuple[pa.Array, pa.Array] | None:
    """The ``term`` strings and their ``number``s, or None if they are not few."""
    n, size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    if n > FEW or (size or 0) > FEW_BYTES:
        return None
    known = terms.select("term", "number").collect()
    return pa.array([r[0] for r in known], pa.large_string()), pa.array([r[1] for r in known], pa.int64())


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``n``, ``terms`` (numbers of known ones, each once) and ``tfs`` of the documents with a term of any kind."""
    words = vocabulary_of(terms)
    if words is not None:
        return counted(docs, "doc_id", words)
    held = counted(docs, "doc_id", None)
    known = flat(held).join(terms, "term").groupBy("row").agg(F.collect_list(F.struct("number", "tf")).alias("f"))
    pairs = known.select("row", F.col("f.number").alias("terms"), F.col("f.tf").alias("tfs"))
    none = F.array().cast("array<long>")
    return stored(held.select("row", "doc_id", "n").join(pairs, "row", "left").withColumns({"terms": F.coalesce("terms", none), "tfs": F.coalesce("tfs", none)}))


def search(docs: DataFrame, items: DataFrame, k: int = 10, first: int = 4) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of each item.

    Null, empty and blank texts have no terms: such documents do not count, such
    items have no result. Each row is a document or an item of its own, so copies
    rank one after another and repeated item ids each have their ``k`` rows.
    Equal scores rank by ``doc_id``, null last. Empty tables give no rows; other
    columns are not read. The first round takes ``first`` terms of an item.
    """
    given = counted(items, "item_id", None)
    asked = checkpointed(flat(given, "item_id").withColumnRenamed("row", "item").withColumnRenamed("tf", "times"))
    terms = checkpointed(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    held = index(docs, terms)
    total, length = held.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    m = F.expr(f"25 + (75 * n * {total}L) div {length}L")
    gain = F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)")

    def postings(rows: DataFrame, *more: str) -> DataFrame:
        each = rows.select("row", *more, m.alias("m"), F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "number", "tfs": "tf"})
        return each.select("row", *more, "number", gain.alias("gain"))

    stats = postings(held).groupBy("number").agg(F.count("*").alias("df"), F.max("gain").alias("most"))
    w = F.floor(1000 * F.log((F.lit(2.0 * total) + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(terms, "term").join(stats, "number").select("item", "number", "df", (F.col("times") * w).alias("w"), "most").where("w > 0")
    turn = Window.partitionBy("item").orderBy("df", "number")
    left = F.sum(F.col("w") * F.col("most")).over(turn.rowsBetween(1, Window.unboundedFollowing))
    plan = weighed.select("item", "number", "w", (F.row_number().over(turn) - 1).alias("place"), F.coalesce(left, F.lit(0)).alias("rest"), (F.col("w") * F.col("most")).alias("own"))
    plan = checkpointed(plan.withColumn("before", F.col("rest") + F.col("own")).drop("own"))

    found = checkpointed(_accumulated(held, postings, plan, k, first))
    few = if_few(checkpointed(found.select("row").distinct()))
    ranked = found.join(held.select("row", "doc_id").join(few, "row", "left_semi"), "row")
    best = _top(ranked, k, F.desc("score"), F.asc_nulls_last("doc_id"))
    names = given.select(F.col("row").alias("item"), "item_id")
    return best.join(if_few(checkpointed(names)), "item").select("item_id", F.col("at").cast("int").alias("rank"), "doc_id", "score")


def _top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each item with their place ``at``; Spark limits each task's rows before the shuffle."""
    return scored.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("at") <= k)


def _accumulated(held: DataFrame, postings: Callable, plan: DataFrame, k: int, first: int) -> DataFrame:
    """``item``, ``row`` and whole ``score`` of all documents that may be among the ``k`` best of an item."""

    def updated(scores: DataFrame) -> DataFrame:
        """``scores`` (item, row, score, place) with all that terms from ``place`` on give."""
        rows = if_few(checkpointed(scores.select("row").distinct()))
        own = scores.select("item", "row", "place").join(held.join(rows, "row", "left_semi"), "row")
        more = postings(own, "item", "place").join(if_few(plan.select("item", "number", "w", F.col("place").alias("turn"))), ["item", "number"]).where(F.col("turn") >= F.col("place"))
        both = scores.select("item", "row", "score").union(more.select("item", "row", (F.col("w") * F.col("gain")).alias("score")))
        return both.groupBy("item", "row").agg(F.sum("score").alias("score"))

    # Terms before ``stop`` create accumulators; a document without any of them cannot reach ``kth``.
    items = checkpointed(plan.groupBy("item").agg((F.max("place") + 1).alias("stop")).withColumn("kth", F.lit(0).cast("long")))
    survivors, scores = None, None
    begin, end = 0, first
    while not items.isEmpty():
        now = plan.join(if_few(items), "item").where((F.col("place") >= begin) & (F.col("place") < F.least(F.lit(end), "stop")))
        new = postings(held).join(if_few(checkpointed(now.select("item", "number", "w"))), "number").select("item", "row", (F.col("w") * F.col("gain")).alias("score"))
        new = new if scores is None else new.union(scores.select("item", "row", "score"))
        rests = if_few(checkpointed(now.where(F.col("place") == F.least(F.lit(end), "stop") - 1).select("item", "kth", "rest")))
        able = new.groupBy("item", "row").agg(F.sum("score").alias("score")).join(rests, "item").where(F.col("score") + F.col("rest") >= F.col("kth"))
        scores = stored(able.select("item", "row", "score"))
        # The leaders' scores are completed at once: all of them end at the least of these or above.
        placed = items.select("item", F.least(F.lit(end), "stop").alias("place"))
        leaders = checkpointed(_top(scores, k, F.desc("score")).select("item", "row", "score").join(if_few(placed), "item"))
        least = updated(leaders).groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).alias("now"))
        kth = items.join(least, "item", "left").select("item", "stop", F.greatest("kth", F.coalesce("now", F.lit(0))).alias("kth"))
        stops = plan.join(if_few(checkpointed(kth)), "item").groupBy("item", "kth", "stop").agg(
            F.coalesce(F.min(F.when(F.col("before") < F.col("kth"), F.col("place"))), "stop").alias("next"),
            F.coalesce(F.max(F.when(F.col("place") == F.least(F.lit(end), "stop") - 1, F.col("rest"))), F.lit(0)).alias("rest"),
        )
        state = checkpointed(stops.select("item", "kth", "rest", F.least(F.lit(end), "stop").alias("place"), F.least("next", "stop").alias("stop")))
        # Whoever cannot reach the k-th score with all that is left goes.
        able = scores.join(if_few(state), "item").where(F.col("score") + F.col("rest") >= F.col("kth"))
        over = stored(able.where("stop <= place").select("item", "row", "score", "place"))
        survivors = over if survivors is None else survivors.union(over)
        scores = able.where("stop > place")
        items = checkpointed(state.where("stop > place").select("item", "stop", "kth"))
        begin, end = end, 2 * end
    if survivors is None:
        return held.select(F.lit(0).cast("long").alias("item"), "row", F.lit(0).cast("long").alias("score")).limit(0)
    return updated(survivors)
