"""Payload files that keep arriving, taken in micro-batches; a repeated batch changes nothing more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.memory import ingest
from ..sources.partitioned import update_memory
from ..sources.readers import memory
from ..sources.schemas import PAYLOAD
from ..sources.sinks import write_memory


def follow_payloads(spark: SparkSession, source: str, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingest new payload files of ``source`` into the memory in ``folder``; batch n writes version n + 1.

    A batch that is run again reads the version before it and writes its own
    again, so recovery after a failure is safe.
    """

    def take(batch: DataFrame, number: int) -> None:
        tables = memory(batch.sparkSession, f"{folder}/{number}")
        write_memory(ingest(tables, batch), folder, str(number + 1))

    stream = spark.readStream.schema(PAYLOAD).option("multiLine", True).json(source)
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def follow_payloads_in_place(spark: SparkSession, source: str, folder: str, checkpoint: str, name: str = "payloads", available_now: bool = True) -> StreamingQuery:
    """Ingest new payload files of ``source`` into one partitioned memory, of which a batch rewrites only what it touches.

    A batch's id is ``name`` and its number: one that is run again, also under
    another checkpoint folder, changes nothing.
    """

    def take(batch: DataFrame, number: int) -> None:
        update_memory(batch.sparkSession, folder, batch, f"{name}-{number}")

    stream = spark.readStream.schema(PAYLOAD).option("multiLine", True).json(source)
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
