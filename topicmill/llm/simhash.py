"""SimHash near-duplicates with generalised pigeonhole search.

Texts get 64-bit fingerprints of their word shingles. Distinct fingerprints are
linked at ``RADIUS`` differing bits or fewer:

* the bits are grouped into ``PARTS`` partitions, correlated bits together;
* a fingerprint gets a threshold for each partition, -1 (not probed) to RADIUS.
  If the thresholds add up to RADIUS - PARTS + 1, every neighbour is within the
  threshold in at least one partition, whatever the split. Dynamic programming
  picks the split with the fewest estimated candidates and probes;
* it probes all values within its threshold, and candidates are verified.

A partition value that more than ``hot`` fingerprints may share is not joined
pair by pair. There, both sides name points of the whole 64-bit space that lie
within one bit of them; whoever names the same point is within two bits. A point
has 65 neighbours at most, so no group grows with the data, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, if_few
from .components import roots

RADIUS, PARTS, SHINGLE, SEED = 2, 3, 3, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one whole text; 0 for null, empty and blank texts.

    bytes.lower() changes A-Z only, and bytes.split() parts at the ASCII blanks.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < shingle:
        parts = [b" ".join(tokens)]
    else:
        parts = map(b" ".join, zip(*(tokens[k:] for k in range(shingle)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        chunk = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_codes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``code``, the fingerprint as a signed long, of each row."""

    @F.pandas_udf("long")
    def code(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").alias("doc_id"), code(F.col("text")).alias("code"))


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near equal width: the least related bits start them, each next bit joins where it is most correlated."""
    bits = ((sample[:, None].view(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    spread = bits.std(axis=0)
    related = np.abs((bits - bits.mean(axis=0)).T @ (bits - bits.mean(axis=0))) / max(1, len(bits))
    related /= np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(related, 0)
    room = [64 // parts + (k < 64 % parts) for k in range(parts)]
    groups = [[int(np.argmax(related.sum(axis=1)))]]
    while len(groups) < parts:
        left = [b for b in range(64) if all(b not in g for g in groups)]
        groups.append([min(left, key=lambda b: (sum(related[b, g[0]] for g in groups), b))])
    for _ in range(64 - parts):
        left = [b for b in range(64) if all(b not in g for g in groups)]
        _, bit, k = max((related[b, groups[k]].mean(), -b, k) for b in left for k in range(parts) if len(groups[k]) < room[k])
        groups[k].append(-bit)
    return [sorted(g) for g in groups]


def flips(bits: list[int], radius: int) -> list[np.ndarray]:
    """For each distance up to ``radius``, the masks that change so many of ``bits``."""
    one = np.array([1 << b for b in bits], np.uint64)
    two = np.array([a | b for i, a in enumerate(one) for b in one[i + 1 :]], np.uint64)
    return [np.zeros(1, np.uint64), one, two][: radius + 1]


class Plan:
    """The fitted index: partitions, counts of folded partition values, and the limit for hot values.

    Tables have 2**fold entries a partition, and fold is at most 18. They steer
    costs only: any plan finds the same links.
    """

    def __init__(self, groups: list[list[int]], fold: int, counts: np.ndarray, hot: int, radius: int = RADIUS, total: int = 0):
        self.groups, self.fold, self.hot, self.radius, self.total = groups, fold, hot, radius, total
        self.masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
        self.counts = counts
        self.flips = [flips(g, radius) for g in groups]
        self.rest = [flips([b for b in range(64) if b not in g], 1) for g in groups]

    def value(self, codes: np.ndarray, part: int) -> np.ndarray:
        return codes & self.masks[part]

    def folded(self, values: np.ndarray, part: int) -> np.ndarray:
        """The first ``fold`` bits of the partition, gathered."""
        out = np.zeros(len(values), np.int64)
        for k, bit in enumerate(self.groups[part][: self.fold]):
            out |= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
        return out

    def is_hot(self, values: np.ndarray, part: int) -> np.ndarray:
        return self.counts[part][self.folded(values, part)] > self.hot

    def thresholds(self, codes: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each code, by dynamic programming over partitions."""
        m, n, need = len(self.groups), len(codes), self.radius + 1
        best = np.full((need + 1, n), np.inf)  # by the sum of thresholds + 1 so far
        best[0] = 0
        picks = []
        for p in range(m):
            width = len(self.groups[p])
            thin = 2.0 ** max(0, width - self.fold)
            here = self.counts[p][self.folded(self.value(codes, p), p)].astype(float)
            mean = self.counts[p].mean()
            cost = [np.zeros(n), 1 + here / thin, 1 + width + here / thin + width * (mean + here / width) / thin]
            cost.append(cost[2] + width * (width - 1) / 2 * (1 + mean / thin))
            now, pick = np.full_like(best, np.inf), np.zeros((need + 1, n), np.int8)
            for total in range(need + 1):
                for given in range(total + 1):
                    c = best[total - given] + cost[given]
                    better = c < now[total]
                    now[total][better], pick[total][better] = c[better], given
            best = now
            picks.append(pick)
        out, left = np.zeros((n, m), np.int8), np.full(n, need)
        for p in range(m - 1, -1, -1):
            given = picks[p][left, np.arange(n)]
            out[:, p] = given - 1
            left -= given
        return out


def keys(plan: Plan, codes: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """What each code names: ``kind`` 0 a stored value, 1 a probed value, 2 a point of a hot value.

    A point names (partition, kind of point, 64-bit point): ``spot`` is even for
    points stored or probed in full, odd for points within one bit of both.
    """
    tau = plan.thresholds(codes)

    def rows(kind: int, spot: int, points: np.ndarray, who: np.ndarray) -> dict[str, np.ndarray]:
        n = len(who)
        return {"kind": np.full(n, kind, np.int8), "spot": np.full(n, spot, np.int8), "point": points, "code": who}

    for p in range(len(plan.groups)):
        own = plan.value(codes, p)
        hot = plan.is_hot(own, p)
        yield rows(0, p, own[~hot], codes[~hot])
        for points in (codes[hot] ^ mask for mask in plan.rest[p][1]):
            yield rows(2, 2 * p + 1, points, codes[hot])
        yield rows(2, 2 * p + 1, codes[hot], codes[hot])
        yield rows(2, 2 * p, codes[hot], codes[hot])
        for far in range(plan.radius + 1):
            asks = codes[tau[:, p] >= far]
            for mask in plan.flips[p][far]:
                values = plan.value(asks, p) ^ mask
                warm = plan.is_hot(values, p)
                yield rows(1, p, values[~warm], asks[~warm])
                if far and warm.any():
                    # The rest may differ in RADIUS - far bits; at far = 0 both sides' odd points say so already.
                    moved = asks[warm] ^ mask
                    yield rows(2, 2 * p, moved, asks[warm])
                    if plan.radius - far == 1:
                        for other in plan.rest[p][1]:
                            yield rows(2, 2 * p, moved ^ other, asks[warm])


KEY_SCHEMA = "kind byte, spot byte, point long, code long"


def fit(codes: DataFrame, sample: int = 100_000, hot: int = 64, parts: int = PARTS) -> Plan:
    """Fit on at most ``sample`` codes, the least by hash, for the partitions; count folded values over all."""
    some = np.array([r[0] for r in codes.orderBy(F.xxhash64("code"), "code").limit(sample).collect()], np.int64).view(np.uint64)
    total = codes.count()
    groups = group_bits(some, parts) if len(some) > 1 else [list(range(64))[k::parts] for k in range(parts)]
    fold = int(min(18, min(map(len, groups)), max(14, total.bit_length())))
    plan = Plan(groups, fold, np.zeros((parts, 1 << fold), np.int32), hot, total=total)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p in range(parts):
                value, n = np.unique(plan.folded(plan.value(own, p), p), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), p, np.int8)), pa.array(value), pa.array(n)], ["part", "value", "n"])

    counted = codes.mapInArrow(tally, "part byte, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    # Rows by the size of the tables, 2**18 a partition at most; values seen once or twice matter to no choice.
    for part, value, n in counted.where("n > 2").collect():
        plan.counts[part, value] = min(n, 2**31 - 1)
    return plan


def links(codes: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) that connect all pairs of distinct ``codes`` within the radius; each link is within it too."""
    shared = codes.sparkSession.sparkContext.broadcast((plan.groups, plan.fold, plan.counts, plan.hot, plan.radius))  # of fixed size, see Plan

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Plan(*shared.value)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for row in keys(fitted, own):
                if len(row["code"]):
                    columns = [row["kind"], row["spot"], row["point"].view(np.int64), row["code"].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "spot", "point", "code"])

    # The probes of a code take longer than reading it, so codes are dealt by their number.
    dealt = codes.repartition(int(max(8, plan.total >> 14)), "code")
    named = checkpointed(dealt.mapInArrow(name, KEY_SCHEMA))
    stored = named.where("kind = 0").select("spot", "point", F.col("code").alias("b"))
    probes = named.where("kind = 1").select("spot", "point", F.col("code").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= plan.radius
    pairs = probes.join(stored, ["spot", "point"]).where("a < b").where(near).select("a", "b")
    # No point is named by more codes than lie within two bits of it, 2,081 at most.
    met = named.where("kind = 2").groupBy("spot", "point").agg(F.collect_set("code").alias("codes")).where(F.size("codes") > 1)
    hub = F.when((F.col("spot") % 2 == 0) & F.array_contains(F.col("codes"), F.col("point")), F.col("point")).when(F.col("spot") % 2 == 1, F.array_min("codes"))
    stars = met.withColumn("a", hub).where("a IS NOT NULL").select("a", F.explode("codes").alias("b")).where("a <> b")
    return pairs.union(stars)


def components(docs: DataFrame, **fitting: int) -> DataFrame:
    """``doc_id``, ``code``, ``root`` (the group's least code) and ``component_id`` (its least id) of each row.

    Null, empty and blank texts have code 0 and link like any other. Repeated
    rows and ids each keep a row. ``component_id`` is null where all ids of a
    group are. Copies meet as one code, so a large group of them costs one row.
    """
    coded = checkpointed(with_codes(docs))
    classes = checkpointed(coded.groupBy("code").agg(F.min("doc_id").alias("least")))
    codes = classes.select("code")
    found = roots(links(codes, fit(codes, **fitting)))
    rooted = classes.join(found, classes["code"] == found["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return coded.join(rooted.select("code", "root").join(named, "root"), "code").select("doc_id", "code", "root", "component_id")


def keep_one(docs: DataFrame, **fitting: int) -> DataFrame:
    """``docs`` with one row of each group: that of the least id, see ``one_of_each``; columns as given."""
    return one_of_each(docs, components(docs, **fitting), with_codes)


def one_of_each(docs: DataFrame, found: DataFrame, coder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of ``docs`` for each component of ``found``; ``coder`` gives the codes of rows.

    The row has the component's least id, null if it has no other. If several
    rows of the component have that id, it is one of those of the least code; an
    id may so stand for several components, with a row for each. Empty tables
    give none; columns besides ``doc_id`` and ``text`` may have any names.
    """
    found = checkpointed(found)
    best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("code").alias("_code"), F.first("doc_id").alias("_id"))
    rows_of_id = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    best = checkpointed(best.join(rows_of_id, "_id", "left").select("_id", "_code", F.coalesce("_n", F.lit(2)).alias("_n")))
    single = docs.join(if_few(best.where("_n = 1").select(F.col("_id").alias("doc_id"))), "doc_id", "left_semi")
    # Of repeated and missing ids, the text decides: codes are taken anew for those rows only.
    several = if_few(best.where("_n > 1"))
    nested = docs.select(F.struct("*").alias("_row"))
    rows = nested.join(several.select("_id").distinct(), F.col("_row")["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    coded = coder(rows.select(F.col("_row").alias("doc_id"), F.col("_row")["text"].alias("text"))).select(F.col("doc_id").alias("_row"), "code")
    chosen = coded.join(several, (F.col("code") == F.col("_code")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left_semi")
    once = chosen.groupBy("code", "_row.doc_id").agg(F.first("_row").alias("_row"))
    return single.unionByName(once.select("_row.*")).select(docs.columns)
