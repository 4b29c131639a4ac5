"""Embedding tables, joined by id."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_embeddings(table: DataFrame, vectors: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows with their vector; a row without one fails the job."""
    joined = table.join(vectors.select(key, "embedding"), key, "left")
    message = F.concat(F.lit("no embedding for "), F.col(key).cast("string"))
    present = F.when(F.col("embedding").isNull(), F.raise_error(message).cast("array<float>"))
    return joined.withColumn("embedding", present.otherwise(F.col("embedding")))


def as_vector(df: DataFrame, column: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))
