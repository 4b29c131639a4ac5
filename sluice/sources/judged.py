"""Judged records: import from result files, and the table that replaces them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USAGE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("prompt_tokens", "completion_tokens", "total_tokens")]
)
RECORD = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("router_score", T.DoubleType()),
        T.StructField("llm_prediction", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("usage", USAGE),
        T.StructField("reused", T.BooleanType()),
    ]
)
PAYLOAD = T.StructType(
    [T.StructField("dataset", T.StringType()), T.StructField("records", T.ArrayType(RECORD))]
)


def read_judged_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Records of result files, one row each; ``multi_line=False`` for one payload per line."""
    payload = spark.read.schema(PAYLOAD).json(path, multiLine=multi_line)
    return payload.select("dataset", F.inline("records"))


def append_judged(df: DataFrame, path: str) -> None:
    """Add newly judged rows; with ``pending_rows`` this is the resume point of a judge run."""
    df.write.mode("append").parquet(path)


def write_metrics(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a small metric table as Parquet or JSON."""
    df.write.mode("overwrite").format(form).save(path)
