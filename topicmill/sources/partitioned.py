"""A memory in one folder whose tables are partitioned, so that an ingest rewrites only the snapshots and papers it touches.

Tables of a snapshot are partitioned by its id, papers and configurations by a
hash of theirs. Every partition of a touched snapshot holds one row without keys
besides its own, so that it is overwritten also where nothing is left in it;
``partitioned_memory`` leaves these rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from ..operators.durable import checkpointed, if_few, stored
from .readers import if_written, memory_table
from .schemas import TABLES

OF_SNAPSHOT = ["source_snapshot", "snapshot_paper", "cluster_run", "cluster", "cluster_member"]
OF_BUCKET = ["embed_config", "cluster_config", "paper"]
BUCKETS = 64
#: Parts of an ingest that are named in the scan's filter; beyond that they are joined.
NAMED = 1000
BATCHES = "batch string, taken_at timestamp"


def _part(name: str) -> str:
    return "_of_snapshot string" if name in OF_SNAPSHOT else "_of_bucket int"


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(TABLES[name][1][0]), F.lit(BUCKETS)).cast("int").alias("_of_bucket")


def _rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its partition column, without the rows that only hold a partition."""
    schema, keys = TABLES[name]
    # Names that begin with "_" are hidden from Spark as files, but not as partition folders ("_x=1").
    return if_written(spark, f"{schema}, {_part(name)}", f"{folder}/{name}").where(F.col(keys[-1]).isNotNull())


def partitioned_memory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a partitioned memory, with the columns of ``TABLES``."""
    parts = {n: _rows(spark, folder, n).drop(_part(n).split()[0]) for n in OF_SNAPSHOT + OF_BUCKET}
    return {n: parts[n] if n in parts else memory_table(spark, folder, n) for n in TABLES}


def _touched(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` of the ``parts``: named in the scan where they are few, so that other folders aren't listed or read."""
    (part,) = parts.columns
    first = [r[0] for r in parts.limit(NAMED + 1).collect()]
    if len(first) <= NAMED:
        return rows.where(F.col(part).isin(first))
    return rows.join(if_few(parts), part, "left_semi")


def update_memory(spark: SparkSession, folder: str, payloads: DataFrame | dict[str, DataFrame], batch: str | None = None, now: Column | None = None) -> bool:
    """Ingest nested or flat payloads into a partitioned memory; whether anything was done.

    The tables are then those of ``memory.ingest``. A ``batch`` that was taken
    before is left alone. Faults raise an error before anything is written. The new
    rows are stored before the first partition is overwritten and the batch is
    noted last: after a failure in between the same batch completes the ingest.
    One ingest at a time may write to a folder.
    """
    taken = f"{folder}/batches"
    if batch is not None and not if_written(spark, BATCHES, taken).where(F.col("batch") == batch).isEmpty():
        return False
    flat = payloads if isinstance(payloads, dict) else memory.flatten(payloads)
    made = {n: stored(rows) for n, rows in memory.new_tables(flat, now, ("snapshot_id",)).items()}
    ids = {n: TABLES[n][0] for n in made}
    memory.refuse_faults({"paper": _rows(spark, folder, "paper")}, made)
    snapshots = checkpointed(made["source_snapshot"].select(F.col("snapshot_id").alias("_of_snapshot")))
    new, old, parts = {}, {}, {}
    for name in made:
        own = F.col("snapshot_id").alias("_of_snapshot") if name in OF_SNAPSHOT else _bucket(name)
        columns = [c.split()[0] for c in ids[name].split(", ")]
        new[name] = made[name].select(*columns, own)
        parts[name] = snapshots if name in OF_SNAPSHOT else checkpointed(new[name].select("_of_bucket").distinct())
        old[name] = _touched(_rows(spark, folder, name), parts[name])
    for name, rows in {n: stored(df) for n, df in memory.merged(old, new).items()}.items():
        part = _part(name).split()[0]
        if name in OF_SNAPSHOT:
            rows = rows.unionByName(parts[name], allowMissingColumns=True)
        # A part's rows may be most of the table: they are dealt to tasks by part and hash, not by part alone.
        dealt = rows.repartition(part, F.pmod(F.xxhash64(*TABLES[name][1]), F.lit(16)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{folder}/{name}")
    if batch is not None:
        spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("taken_at")).write.mode("append").parquet(taken)
    return True
