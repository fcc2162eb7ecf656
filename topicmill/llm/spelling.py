"""Spelling variants: words of a corpus within one edit of each other, found by PartEnum signatures.

A word's letters are a multiset, read as a binary vector with a place for each
letter and occurrence. One inserted, deleted or replaced letter changes two
places at most. So the letters are put into ``PARTS`` parts of near equal weight
(an occurrence goes with its letter); of two vectors within Hamming distance 2
all but two parts at most are equal, and they share the signature of some choice
of PARTS - 2 parts. (Splitting the vector in two first, as the scheme allows,
was measured: 15 times the candidates here.) Anagrams have one vector and are
never within one edit, so vectors meet instead of words.

* Vectors join on signatures. A signature of more than ``HOT`` vectors is refined:
  there, vectors also have to share what is left of them without some one letter.
  Both ends of a pair have that in common, and no more vectors than there are
  letters have it, so no bucket grows with the data.
* Vectors at distance 1 or 2 join their words; the edit distance decides. Where
  two vectors have many words, these also have to share their first or last half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, if_few, small_batches
from .runs import runs

#: The letters of runs, A-Z, a-z and U+00C0 to U+00FF; of the divisor of hashes; of the least word.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[0xC3] = True
DIVISOR, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
PARTS, HOT, MANY = 6, 64, 4096
#: Words that a task counts before it hands counts on.
HELD = 1 << 17
#: The table of the usual CRC-32, by its polynomial.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


def inside(data: np.ndarray) -> np.ndarray:
    """Of U+00C0 to U+00FF the first byte is C3."""
    own = LETTERS[data]
    own[1:] |= data[:-1] == 0xC3
    return own


def checksums(words: pa.Array, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of each of ``words`` that goes on from its seed, a letter of all words at a time, longest words first."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = offsets[:-1][order], sizes[order]
    state = ~seeds[order]
    tail = np.searchsorted(sizes[::-1], 64, "right")
    for k in range(int(min(64, sizes[0]))):
        n = len(sizes) - int(np.searchsorted(sizes[::-1], k, "right"))
        state[:n] = CRC[(state[:n] ^ data[begins[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    for i in order[: len(order) - tail]:  # very long ones by themselves
        out[i] = zlib.crc32(data[offsets[i] : offsets[i + 1]].tobytes(), int(seeds[i]))
    return out


def damaged(words: pa.Array, ids: list, rows: np.ndarray) -> pa.Array:
    """The runs, some of them without one letter: where ``DIVISOR`` divides the CRC-32 of id and run. None changes where the id is null."""
    seeds = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[rows]
    hashes = checksums(words, seeds)
    null = np.array([i is None for i in ids], bool)[rows]
    hit = np.flatnonzero((hashes % DIVISOR == 0) & ~null)
    if not len(hit):
        return words
    whole = words.take(pa.array(hit)).to_pylist()
    less = [w[: h % len(w)] + w[h % len(w) + 1 :] for w, h in zip(whole, hashes[hit].tolist(), strict=True)]
    rest = np.ones(len(words), bool)
    rest[hit] = False
    return pa.concat_arrays([words.filter(pa.array(rest)), pa.array(less, pa.large_string())])


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``word`` of ``least`` letters or more and its occurrences ``n`` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        merged = lambda: pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        for batch in small_batches(batches):
            ids = batch.column(0).to_pylist()
            for words, rows in runs(batch.column(1), inside):
                long = pc.greater_equal(pc.utf8_length(words), least)
                words, rows = words.filter(long), rows[long.to_numpy(zero_copy_only=False)]
                if len(words):
                    words = damaged(words, ids, rows)
                    found = pc.value_counts(words.filter(pc.greater_equal(pc.utf8_length(words), least)))
                    held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                    size += len(found)
            if size > HELD:
                held = [merged()]
                size = len(held[0])
                if size > HELD:
                    yield from held[0].cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(1 << 14)
                    held, size = [], 0
        if held:
            yield from merged().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(1 << 14)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def parts_of(words: DataFrame, parts: int) -> list[str]:
    """The letters of each part: the most frequent first, each into the lightest part. There are 90 letters at most."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    out, weight = [""] * parts, [0] * parts
    for letter, n in letters.orderBy(F.desc("n"), "letter").collect():
        at = weight.index(min(weight))
        out[at] += letter
        weight[at] += n
    return out


def signatures(vectors: DataFrame, parts: list[str], radius: int = 2) -> DataFrame:
    """``vector`` and each of its signatures ``sig``: the letters of all choices of all but ``radius`` parts."""
    letters = "".join(parts)
    own = [F.translate("vector", "".join(c for c in letters if c not in p), "") for p in parts]
    choices = list(combinations(range(len(parts)), len(parts) - radius))
    sigs = F.array(*[F.xxhash64(F.lit(k), *[F.col("_p")[i] for i in choice]) for k, choice in enumerate(choices)])
    return vectors.withColumn("_p", F.array(*own)).select("vector", F.explode(sigs).alias("sig"))


def places(vector: Column) -> Column:
    """The set places of a sorted vector: the letter, and how many of it came before, as one number."""
    letters = F.split(vector, "")
    return F.transform(letters, lambda c, i: F.ascii(c).cast("long") * (1 << 32) + i - F.array_position(letters, c) + 1)


def one_less(vector: Column) -> Column:
    """A sorted vector, and it without one of each letter."""
    less = lambda c: F.concat(F.substring(vector, F.lit(1), F.position(c, vector) - 1), F.substring(vector, F.position(c, vector) + 1, F.length(vector)))
    return F.concat(F.array(vector), F.transform(F.array_distinct(F.split(vector, "")), less))


def near_vectors(vectors: DataFrame, parts: list[str], hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of vectors at Hamming distance 1 or 2."""
    signed = checkpointed(signatures(vectors, parts))
    crowded = checkpointed(signed.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > hot).select("sig"))
    few = if_few(crowded)
    plain = signed.join(few, "sig", "left_anti").select("sig", F.lit("").alias("less"), "vector")
    fine = signed.join(few, "sig", "left_semi").select("sig", F.explode(one_less(F.col("vector"))).alias("less"), "vector")
    both = plain.union(fine)
    left, right = both.withColumnRenamed("vector", "a"), both.withColumnRenamed("vector", "b")
    # In order, one letter more or less is one edit, and one for another two at most: a quick test before the places are compared.
    close = F.levenshtein("a", "b", 2) >= 0
    pairs = left.join(right, ["sig", "less"]).where("a < b").where(close).select("a", "b").distinct()
    shared = F.size(F.array_intersect(places(F.col("a")), places(F.col("b"))))
    return checkpointed(pairs.where(F.length("a") + F.length("b") - 2 * shared <= 2))


def halves(word: Column) -> Column:
    """What a word and one within an edit of it, of m letters or more, have in common: the first or the last m / 2 letters."""
    n = F.length(word)

    def ends(m: Column) -> Column:
        h = (m / 2).cast("int")
        return F.array(F.struct(m.alias("m"), F.lit(0).alias("side"), F.substring(word, F.lit(1), h).alias("half")), F.struct(m.alias("m"), F.lit(1).alias("side"), F.substring(word, n - h + 1, h).alias("half")))

    return F.concat(ends(n), ends(n - 1))


def near_words(words: DataFrame, parts: int = PARTS, hot: int = HOT, many: int = MANY) -> DataFrame:
    """Pairs (a, b) of distinct ``word``s within one edit, each pair both ways."""
    spelled = checkpointed(words.select("word", F.array_join(F.array_sort(F.split("word", "")), "").alias("vector")))
    vectors = spelled.groupBy("vector").agg(F.count("*").alias("size"))
    near = near_vectors(vectors.select("vector"), parts_of(words, parts), hot)
    sizes = lambda side: vectors.select(F.col("vector").alias(side), F.col("size").alias(f"n{side}"))
    sized = checkpointed(near.join(sizes("a"), "a").join(sizes("b"), "b").withColumn("many", F.col("na") * F.col("nb") > many).select("a", "b", "many"))
    left, right = spelled.select(F.col("vector").alias("a"), F.col("word").alias("x")), spelled.select(F.col("vector").alias("b"), F.col("word").alias("y"))
    apart = F.levenshtein("x", "y", 1) == 1
    plain = sized.where("NOT many").join(left, "a").join(right, "b").where(apart).select("x", "y")
    large = sized.where("many").join(left, "a").select("b", "x", F.explode(halves(F.col("x"))).alias("end"))
    fine = large.join(right.select("b", "y", F.explode(halves(F.col("y"))).alias("end")), ["b", "end"]).where(apart).select("x", "y").distinct()
    pairs = checkpointed(plain.union(fine))
    return pairs.select(F.col("x").alias("word"), F.col("y").alias("near")).union(pairs.select("y", "x"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last of its forms, of each word that has one; each round doubles the steps taken.

    A form is ``RATIO`` times as frequent as its word, so chains are as short as the logarithm of the corpus.
    """
    found = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if found.join(if_few(on), "root", "left_semi").isEmpty():
            return found
        found = checkpointed(found.join(if_few(on), "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO, **settings: int) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word with ``least`` occurrences or more.

    Null, empty and other texts without letters have no words. Repeated rows and
    ids each count; runs of a row with a null id stay whole. A very long run is a
    word like any other. Empty tables give no rows; other columns are not read.
    """
    words = checkpointed(word_counts(docs).where(F.col("n") >= least))
    links = near_words(words.select("word"), **settings)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    first = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), "near"))
    best = links.join(known, "near").groupBy("word").agg(F.count("*").alias("n_near"), first.alias("_best"))
    judged = words.join(best, "word", "left").withColumn("_form", F.when(F.col("_best.near_n") >= ratio * F.col("n"), F.col("_best")))
    judged = checkpointed(judged.select("word", F.col("_form.near").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("_form.near_n").alias("form_n")))
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
