"""Near-duplicates by Jaccard similarity of five-word shingles: SimHash, and a second pass for what it can't reach.

Texts become sets of shingle hashes; equal sets meet as one class. Classes get a
64-bit SimHash, and ``simhash.links`` names those within its radius. At a
similarity of 0.8 fingerprints differ in some 10 bits, up to 18 and more: far
beyond what probing can cover (see the README), so a second pass looks for
classes that share one of ``BANDS`` MinHash bands of ``ROWS`` rows. A pair at 0.8
is missed there with probability (1 - 0.8**ROWS)**BANDS, 3e-5; a closer one still
less. Every link, of either pass, is then verified by the sets' exact similarity.

The members of a band value are not paired all with all. Each is compared with
the least one; values whose members are still in different components are then
gone through with ever more members as partners for the rest, until all of a
value's members are one component or all have been partners: no pair is lost.
What members of these values are compared with is held against the similarity
where they meet (``alike``), so no more than the near ones become pairs: texts
around one passage are mostly just below it, and would be as many as the square
of their number.

A value of over ``LARGE`` members that stay apart is no band's doing but a
passage that its texts share. Its members meet by their rarest shingles instead
(``rarest``): sets of similarity t have one in common among the first
n - ceil(t n) + 1 of each in any order, and even among the first
n - ceil(2 t n / (1 + t)) + 1 of the smaller one. Frequent shingles come last in
that order, so texts meet by a shared passage only where it is long enough to
make them similar. This loses no pair either.

What the passes leave is ``stored``, not checkpointed: most tables are small, and Parquet
files are read several by one task, where each partition of a checkpoint takes
one, with shuffle files of its own; small ones are also broadcast by their true size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, if_few, small_batches, stored
from .components import roots
from .hashing import mixed, shingle_hashes, word_hashes
from .simhash import fit, links, majority, one_of_each

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
#: One-byte MinHashes of a class, and how many of them a pair needs to be compared exactly.
SKETCH, LEAST = 80, 44
#: Bits that tell whether a set has an odd number of shingles of each of so many hash ranges.
PARITY = 512
#: Members of one value are dealt to so many tasks; from HEAVY pairs on, those of one class too.
SALT, HEAVY = 8, 1000
#: A round has so many times the partners of the one before.
MORE = 32
#: Members of a value that stay apart are paired as they are up to LARGE; shingles of over OFTEN sets are ordered by frequency.
LARGE, OFTEN = 64, 32
#: So many shingles, the most frequent ones, are told to all tasks.
ORDERED = 1 << 18


def sets_of(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sorted set of each row's shingle hashes; all shingles, and their number by row."""
    found, counts = shingle_hashes(*word_hashes(texts), SHINGLE)
    return [np.unique(own) for own in np.split(found, np.cumsum(counts)[:-1])] if len(counts) else [], found, counts


def code_of(shingles: np.ndarray) -> int:
    """Signed hash of a sorted set of shingles; 0 for the empty one."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0]) if len(shingles) else 0


def codes_of(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([code_of(s) for s in sets], pa.int64())


def bands_of(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, BANDS) hashes of the rows' MinHash bands, and (rows, SKETCH / 8) words of one-byte MinHashes.

    Rows without shingles have some values that mean nothing.
    """
    full = counts > 0
    bands, sketch = np.zeros((len(counts), BANDS), np.uint64), np.zeros((len(counts), SKETCH), np.uint8)
    begins = (np.cumsum(counts) - counts)[full]
    if len(begins):
        factors = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(factors):
                least = mixed(np.minimum.reduceat(found * factor, begins))
                bands[full, k // ROWS] = mixed(bands[full, k // ROWS] + least + np.uint64(k))
                sketch[full, k % SKETCH] = least.astype(np.uint8)
    return bands, sketch.view(np.uint64)


def parity_of(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, PARITY / 64) words: bits of two sets differ in no more places than the sets do in shingles."""
    counts = np.array([len(s) for s in sets], np.int64)
    if not counts.sum():
        return np.zeros((len(sets), PARITY // 64), np.uint64)
    place = np.repeat(np.arange(len(sets)) * PARITY, counts) + (mixed(np.concatenate(sets)) % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sets) * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), PARITY), axis=1).view(np.uint64)


def as_lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64).ravel()))


def with_prints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``code`` of the set, its size ``n``, its SimHash ``print``, its ``bands``, ``sketch`` and ``parity`` for each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets, found, counts = sets_of(batch.column(1))
            bands, sketch = bands_of(found, counts)
            prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int32)
            columns = [batch.column(0), codes_of(sets), pa.array(sizes), pa.array(prints), as_lists(bands), as_lists(sketch), as_lists(parity_of(sets))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "code", "n", "print", "bands", "sketch", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, code long, n int, print long, bands array<long>, sketch array<long>, parity array<long>")


def with_codes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``code``, the hash of its set, of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), codes_of(sets_of(batch.column(1))[0])], ["doc_id", "code"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, code long")


def with_sets(docs: DataFrame) -> DataFrame:
    """``code`` and the set itself of each distinct set of ``docs``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = sets_of(batch.column(0))[0]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([codes_of(sets), lists], ["code", "shingles"])

    return docs.select("text").mapInArrow(encode, "code long, shingles array<long>").dropDuplicates(["code"])


def meet(members: DataFrame, values: DataFrame) -> DataFrame:
    """Members joined with the table of their values, those of one value by ``SALT`` tasks."""
    dealt = values.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return members.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALT)).cast("int")).join(dealt, ["band", "value", "salt"]).drop("salt")


def paired(met: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of the members ``met`` with the ``hub`` structs of their values, if their sizes allow the similarity.

    ``spread`` tells over how many tasks a hub's pairs are dealt later.
    """
    hub = F.col("hub")
    met = met.where(F.col("code") != hub["code"])
    near = F.least("n", hub["n"]) >= threshold * F.greatest("n", hub["n"]) - 1e-9
    if "partner" in met.columns:
        # Of two partners, the one of the lesser code is the hub.
        met = met.where(F.col("root") != hub["root"]).where(~F.col("partner") | (F.col("code") > hub["code"]))
        # Where a shingle is the first that two sets share, they share no more than what follows it.
        left = F.least(F.col("n") - F.col("at"), hub["n"] - hub["at"])
        near &= F.coalesce(left >= threshold / (1 + threshold) * (F.col("n") + hub["n"]) - 1e-9, F.lit(True))
        near &= alike(F.col("marks"), hub["marks"], threshold)
    return met.where(near).groupBy(hub["code"].alias("a"), F.col("code").alias("b")).agg((F.max("size") / HEAVY).cast("int").alias("spread"))


def marks() -> Column:
    """What ``alike`` needs of a class."""
    return F.struct("n", "sketch", "parity")


def alike(x: Column, y: Column, threshold: float) -> Column:
    """Whether two classes share ``LEAST`` one-byte MinHashes, and differ by no more parity bits than the similarity allows shingles.

    Sets of sizes m and n that have the similarity t differ in at most (m + n) (1 - t) / (1 + t) shingles.
    """

    def bytes_set(w: Column) -> Column:
        for k in (4, 2, 1):  # the lowest bit of a byte becomes the union of its eight
            w = w.bitwiseOR(F.shiftrightunsigned(w, k))
        return F.bit_count(w.bitwiseAND(F.lit(0x0101010101010101)))

    odd = sum((F.bit_count(F.get(x["parity"], F.lit(k)).bitwiseXOR(F.get(y["parity"], F.lit(k)))) for k in range(PARITY // 64)), F.lit(0))
    other = F.zip_with(x["sketch"], y["sketch"], lambda a, b: a.bitwiseXOR(b))
    differing = F.aggregate(other, F.lit(0), lambda n, w: n + bytes_set(w))
    return (odd <= (x["n"] + y["n"]) * ((1 - threshold) / (1 + threshold)) + 1e-6) & (differing <= SKETCH - LEAST)


def sketched(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are ``alike``."""
    left, right = classes.select(F.col("code").alias("a"), marks().alias("x")), classes.select(F.col("code").alias("b"), marks().alias("y"))
    return pairs.join(right, "b").join(left, "a").where(alike(F.col("x"), F.col("y"), threshold)).select("a", "b", "spread")


def sets_named(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """``code`` and ``shingles`` of the classes whose codes are ``asked``, from the text of each one's least id."""
    ids = stored(classes.join(asked, "code").select(F.col("least").alias("id")).distinct())
    texts = docs.select("doc_id", "text")
    return stored(with_sets(texts.join(if_few(ids), texts["doc_id"].eqNullSafe(F.col("id")), "left_semi")).join(asked, "code", "left_semi"))


def rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """The places ``at`` which each set holds its rarest shingles, as values of band -1; see above.

    ``index`` marks those in which the smaller set of a pair must meet the larger
    one. Shingles that no other set, or no set as ``index``, has there are left out.
    The order of shingles is one for all sets: by value, then the ``ORDERED`` most frequent
    ones by frequency. Any order loses no pair, so ``ORDERED`` bounds what tasks are sent only.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            value, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n, pa.int64())], ["value", "n"])

    every = sets.select("shingles").mapInArrow(tally, "value long, n long")
    often = every.groupBy("value").agg(F.sum("n").alias("often")).where(F.col("often") > OFTEN).orderBy(F.desc("often"), "value").limit(ORDERED).collect()
    named = np.array([r["value"] for r in often], np.int64)
    order = np.argsort(named)
    known, place = named[order], len(named) - order

    def first(n: int, share: float) -> int:
        return n - int(np.ceil(n * share - 1e-9)) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            codes, rows = batch.column(0).to_numpy(zero_copy_only=False), []
            for code, shingles in zip(codes, batch.column(1), strict=True):
                own = shingles.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                late = np.where(known[at] == own, place[at], 0) if len(known) else np.zeros(len(own), np.int64)
                n, kept = len(own), own[np.lexsort((own, late))[: first(len(own), threshold)]]
                places = np.arange(len(kept))
                rows.append((kept, np.full(len(kept), code), np.full(len(kept), n), places, places < first(n, 2 * threshold / (1 + threshold))))
            value, code, n, at, index = map(np.concatenate, zip(*rows, strict=True)) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(code, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(index, pa.bool_())], ["value", "code", "n", "at", "index"])

    spots = checkpointed(sets.select("code", "shingles").mapInArrow(cut, "value long, code long, n int, at int, index boolean").select(F.lit(-1).alias("band"), "*"))
    shared = spots.groupBy("band", "value").agg(F.count("*").alias("size"), F.max("index").alias("met")).where("size > 1 AND met")
    return meet(spots, shared.drop("met"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets have ``threshold`` or more in common; ``pairs`` are written."""
    sets = sets_named(docs, classes, pairs.select(F.col("a").alias("code")).union(pairs.select(F.col("b").alias("code"))).distinct())
    # A class with many pairs is dealt to several tasks, its set with it.
    copies = pairs.select("a", "spread").distinct().select("a", "spread", F.explode(F.sequence(F.lit(0), "spread")).alias("salt"))
    left = copies.join(sets.select(F.col("code").alias("a"), F.col("shingles").alias("x")), "a")
    right = sets.select(F.col("code").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("spread") + 1).cast("int")).join(left, ["a", "spread", "salt"])
    same = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), same.alias("same")).where(F.col("same") >= threshold * (F.col("m") + F.col("n") - F.col("same")) - 1e-9).select("a", "b")


def simhash_pairs(classes: DataFrame, **fitting: int) -> DataFrame:
    """Pairs of classes that SimHash names: the least ones of prints within its radius, and of one print with the rest."""
    least = checkpointed(classes.groupBy("print").agg(F.min("code").alias("rep")))
    codes = least.select(F.col("print").alias("code"))
    near = links(codes, fit(codes, **fitting))
    ends = near.join(least.select(F.col("print").alias("a"), F.col("rep").alias("ra")), "a").join(least.select(F.col("print").alias("b"), F.col("rep").alias("rb")), "b")
    same = classes.select("print", "code").join(least, "print").where(F.col("code") != F.col("rep"))
    return ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"), F.lit(0).alias("spread")).union(same.select("rep", "code", F.lit(0)))


def components(docs: DataFrame, threshold: float = THRESHOLD, **fitting: int) -> DataFrame:
    """``doc_id``, ``code``, ``root`` (the group's least code) and ``component_id`` (its least id) of each row.

    Groups are the connected components of the pairs of similarity ``threshold``
    or more. Null, empty and blank texts are one group; a text of under five
    words is one shingle. Repeated rows each keep a row. ``component_id`` is null
    where all ids of a group are. Empty tables give none; other columns are not read.
    """
    coded = checkpointed(with_prints(docs))
    classes = stored(coded.groupBy("code").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "print", "bands", "sketch", "parity")]))
    some = classes.where("n > 0")
    spots = some.select("code", "n", F.posexplode("bands").alias("band", "value"))
    shared = spots.groupBy("band", "value").agg(F.min(F.struct("code", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    # Written, as the rounds below start from it too.
    met = stored(meet(spots, shared))
    first = paired(met, threshold).union(simhash_pairs(some, **fitting)).groupBy("a", "b").agg(F.max("spread").alias("spread"))
    first = stored(first.where("a <> b"))
    found = roots(verified(stored(sketched(first, classes, threshold)), docs, classes, threshold), keep=stored)
    # Values of more than two members may hold pairs without the least one.
    rest = met.where("size > 2").drop("hub").withColumns({"at": F.lit(None).cast("int"), "index": F.lit(True)})
    begin, end, named = 0, MORE, ["band", "value", "size", "code", "n", "at", "index"]
    while True:
        rooted = stored(rest.join(found, F.col("code") == F.col("node"), "left").select(*named, F.coalesce("root", "code").alias("root")))
        split = rooted.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "value")
        rest = stored(meet(rooted.where(F.col("size") > begin), split))
        if rest.isEmpty():
            break
        large = stored(rest.where((F.col("band") >= 0) & (F.col("size") > LARGE)).select("code", "root").distinct())
        if begin == 0 and not large.isEmpty():
            by_shingle = rarest(sets_named(docs, classes, large.select("code")), threshold).join(large, "code")
            rest = rest.where(F.col("size") <= LARGE).unionByName(by_shingle)
        if begin == 0:
            rest = stored(rest.join(classes.select("code", marks().alias("marks")), "code"))
            named.append("marks")
        turn = F.pmod(F.xxhash64("code", "band"), F.lit(1 << 40)) * F.col("size") / (1 << 40)
        members = rest.withColumn("partner", F.col("index") & (turn >= begin) & (turn < end))
        partners = members.where("partner").select("band", "value", "size", F.struct("code", "n", "root", "at", "marks").alias("hub"))
        more = stored(paired(meet(members.drop("size"), partners), threshold).join(first, ["a", "b"], "left_anti"))
        rest = rest.drop("root")
        begin, end = end, end * MORE
        if more.isEmpty():
            continue
        new = stored(verified(more, docs, classes, threshold))
        if not new.isEmpty():
            # A component is a star by now: new links join stars.
            found = roots(found.toDF("a", "b").union(new), keep=stored)
    rooted = stored(classes.join(found, classes["code"] == found["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return coded.select("doc_id", "code").join(rooted.select("code", "root").join(least, "root"), "code").select("doc_id", "code", "root", "component_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group: that of the least id, see ``simhash.one_of_each``; columns as given."""
    return one_of_each(docs, components(docs, threshold), with_codes)
