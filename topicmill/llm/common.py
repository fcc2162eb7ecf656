"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: ASCII blank and tab to carriage return.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of non-blank characters; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def set_up_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder of the session's ``spark.checkpoint.dir`` where the context has none.

    Without that setting only a session within one process gets a folder of its
    own: on a cluster, executors could not see it, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="topicmill-checkpoints-")
        context.setCheckpointDir(folder)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000, volume: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows and ``volume`` bytes, or one row that is larger alone.

    Spark bounds a batch's bytes, but a task's Python copies of texts would take
    several times that; parts keep them small whatever the session's settings.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() and batch.slice(at, n).nbytes > volume:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n
        if not batch.num_rows:
            yield batch


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back from it."""
    set_up_checkpoints(df.sparkSession)
    return df.checkpoint()


def if_few(rows: DataFrame, most: int = 1 << 18) -> DataFrame:
    """Short ``rows``, already written, to be joined with texts: broadcast if they are ``most`` or fewer.

    Beyond that they get no hint, and Spark shuffles both sides.
    """
    return F.broadcast(rows) if rows.count() <= most else rows


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again: columns can be read one by one."""
    set_up_checkpoints(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
