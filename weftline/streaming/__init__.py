"""Streaming DataFrames as scan inputs: a plan over one is a streaming query like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.functions.predicates import Predicate, by_name


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, where: Predicate | None = None) -> DataFrame:
    """Rows of the Parquet files that appear in a folder."""
    df = spark.readStream.schema(schema).parquet(path)
    return df if where is None else df.where(where.to_column(by_name))


def append_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has arrived since the last call, once each, to a Parquet folder; returns when
    that is written. ``checkpoint``: a shared folder that remembers what was read."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
