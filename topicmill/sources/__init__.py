"""Readers and writers. ``table`` reads one of the Parquet tables of a folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, by any path that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
