"""Shards by fixed virtual slots.

A record's slot is a hash of its id; a versioned table maps slots to shards and
is all that changes when shards are added or load is evened out. The map for n
shards is that of one shard grown n - 1 times, so it follows from the numbers of
slots and shards alone, whatever was stored before: id and shard count decide a
record's shard (the law ``key``), and one more shard takes rows only into itself.
``rebalance`` edits a map by the bytes measured per slot, for users who prefer
even bytes to that law.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slots, a constant for the life of a data set. All slot tables have so many rows.
SLOTS = 4096
#: Parts of a slot whose rows are ranked apart; and how many equal rows one task makes.
PARTS, MANY = 16, 1 << 16


def with_slots(docs: DataFrame, id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 8), ``text_crc32`` and ``virtual_slot`` of each row.

    A null text has no bytes and the checksum of an empty one; a null id has a
    slot like any other. Equal ids share a slot, so repeated rows stay together.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(data) + 8).cast("bigint").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def owners(shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of every slot, by growth from one shard as in ``grow``; counts differ by one at most."""
    held = [list(range(slots))]
    for n in range(2, shards + 1):
        # The last slot of the largest shard, the first of several, until the new one has its share.
        gone = sorted(((-len(own) + k, s, own) for s, own in enumerate(held) for k in range(len(own))), key=lambda x: x[:2])[: slots // n]
        held.append(sorted(own.pop() for _, _, own in gone))
    shard_of = {slot: s for s, own in enumerate(held) for slot in own}
    return [shard_of[slot] for slot in range(slots)]


def start_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map for ``shards`` shards; shards differ by one slot at most."""
    dealt = ",".join(map(str, owners(shards, slots)))
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.get(F.split(F.lit(dealt), ","), F.col("id").cast("int")).cast("int").alias("shard")
    )


def grow(mapping: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The next version with one shard more: the largest of ``shards`` give their last slots, and only the new shard gains.

    The windows below run over the ``slots`` rows of the map, a constant. Grown
    from ``start_map(n)``, it is ``start_map(n + 1)``.
    """
    share = slots // (shards + 1)
    place = F.row_number().over(Window.partitionBy("shard").orderBy("virtual_slot"))
    turn = F.row_number().over(Window.orderBy(F.desc("_place"), "shard"))
    ranked = mapping.withColumn("_place", place).withColumn("_turn", turn)
    return ranked.select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("_turn") <= share, F.lit(shards)).otherwise(F.col("shard")).alias("shard")
    )


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every virtual slot, empty ones included."""
    spark = records.sparkSession
    summed = records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))
    return (
        spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(F.broadcast(summed), "virtual_slot", "left")
        .select("virtual_slot", F.coalesce("slot_bytes", F.lit(0)).alias("slot_bytes"), F.coalesce("slot_rows", F.lit(0)).alias("slot_rows"))
    )


def rebalance(mapping: DataFrame, loads: DataFrame, shards: int, tolerance: float = 0.05) -> DataFrame:
    """The next version, with slots moved from shards over the mean load to the lightest ones.

    Works on the slot table alone, whose size is fixed: the heaviest slots that
    fit move first, and a slot moves only if that evens the two shards out.
    """
    rows = [r.asDict() for r in mapping.join(loads, "virtual_slot").orderBy("virtual_slot").collect()]
    held = {s: 0 for s in range(shards)}
    for r in rows:
        held[r["shard"]] += r["slot_bytes"]
    mean = sum(held.values()) / shards
    for r in sorted(rows, key=lambda r: (-r["slot_bytes"], r["virtual_slot"])):
        light = min(held, key=lambda s: (held[s], s))
        if held[r["shard"]] > mean * (1 + tolerance) and held[r["shard"]] - r["slot_bytes"] >= held[light]:
            held[r["shard"]] -= r["slot_bytes"]
            held[light] += r["slot_bytes"]
            r["shard"] = light
    version = rows[0]["version"] + 1 if rows else 1
    return mapping.sparkSession.createDataFrame([(version, r["virtual_slot"], r["shard"]) for r in rows], "version int, virtual_slot int, shard int")


def save_map(mapping: DataFrame, path: str) -> None:
    """Add a version to the stored map; older versions stay readable."""
    mapping.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One stored version."""
    return spark.read.parquet(path).where(F.col("version") == version).select(F.lit(version).alias("version"), "virtual_slot", "shard")


def place(docs: DataFrame, mapping: DataFrame, grown: DataFrame, slots: int = SLOTS, **columns: str) -> DataFrame:
    """All rows of ``docs`` with shard, gapless place in the shard, and shard after growth.

    Places run through a shard's virtual slots in order; within one, through
    ``PARTS`` parts by a hash of id, checksum and size, and there by these three.
    Rows equal in all three are interchangeable: they are counted as one, and get
    neighbouring places. So only different rows of one part are ranked together,
    and a frequent id is spread over all parts; offsets come from counts of parts.
    These tables are broadcast: ``slots`` times ``PARTS`` rows whatever the input.
    Null texts and ids are placed like any other; an empty table gives no rows;
    other columns are not read, whatever their names.
    """
    part = F.pmod(F.xxhash64("text_crc32", "size", "doc_id"), F.lit(PARTS)).cast("int")
    alike = ["virtual_slot", "part", "doc_id", "text_crc32", "size"]
    records = with_slots(docs, slots=slots, **columns).withColumn("part", part).groupBy(*alike).agg(F.count("*").alias("n"))
    counts = records.groupBy("virtual_slot", "part").agg(F.sum("n").alias("part_rows"), F.sum(F.col("n") * F.col("size")).alias("part_bytes"))
    shards = F.broadcast(mapping.select("virtual_slot", "shard").join(grown.select("virtual_slot", F.col("shard").alias("grown_shard")), "virtual_slot"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.join(shards, "virtual_slot").select(
        "virtual_slot", "part", "shard", "grown_shard", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("part_bytes").over(Window.partitionBy("virtual_slot")).alias("slot_bytes"),
    )
    earlier = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = records.withColumn("_first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(table), ["virtual_slot", "part"])
    each = lambda rows, copies: rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)).alias("_copy"))
    few = each(placed.where(F.col("n") <= MANY), F.col("n") - 1)
    # Many equal rows are made anew by several tasks.
    chunks = placed.where(F.col("n") > MANY).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(MANY).cast("bigint"))).alias("_chunk"))
    dealt = chunks.repartition("doc_id", "_chunk")
    many = each(dealt, F.least(F.lit(MANY), F.col("n") - F.col("_chunk")) - 1).withColumn("_copy", F.col("_copy") + F.col("_chunk")).drop("_chunk")
    return few.unionByName(many).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_first") + F.col("_copy")).alias("slot"), "grown_shard", "virtual_slot", "slot_bytes"
    )
