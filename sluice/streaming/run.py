"""Start helpers: file sources, and runs that drain what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluice.session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def drain(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table and return that table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], path: str) -> None:
    """Process everything available through a per-batch function.

    Batch numbers are stable across restarts; handlers write to a folder per number, so a
    repeated batch replaces its own output.
    """
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
