"""What jobs of many steps need on a cluster: results that survive lost executors, and joins with checked sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def set_up_checkpoints(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; only a session within one process gets one of its own where there is none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="topicmill-")
        context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back from it, in the same partitions."""
    set_up_checkpoints(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name within the shared checkpoint folder."""
    set_up_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back: smaller, and read by column."""
    folder = scratch_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def if_few(rows: DataFrame, most: int = 1 << 18) -> DataFrame:
    """Short ``rows``, already written, to be broadcast if they are ``most`` or fewer; beyond that Spark shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= most else rows
