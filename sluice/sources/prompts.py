"""The prompt table: one row per text, partitioned by dataset and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORE = ["sample_id", "prompt", "label", "dataset", "split"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def normalise(
    df: DataFrame,
    dataset: Column | str,
    split: Column | str,
    text_col: str,
    row_key: str,
    label: int | str = "label",
) -> DataFrame:
    """Bring any source table to the core columns.

    ``label`` names the label column, or is a constant for one-class sets.  Every other
    source column is kept with the prefix ``source_``.  The id is dataset, split and the
    source's own row key, so it does not depend on row order.
    """
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    split = F.lit(split) if isinstance(split, str) else split
    constant = isinstance(label, int)
    used = {text_col} if constant else {text_col, label}
    extra = [c for c in df.columns if c not in used]
    return df.select(
        F.concat_ws("_", dataset, split, F.col(row_key).cast("string")).alias("sample_id"),
        F.col(text_col).cast("string").alias("prompt"),
        (F.lit(label) if constant else F.col(label)).cast("int").alias("label"),
        dataset.alias("dataset"),
        split.alias("split"),
        *[F.col(c).alias(f"source_{c}") for c in extra],
    )


def concat_splits(frames: Sequence[DataFrame], key: str = "sample_id") -> DataFrame:
    """Union of splits with one row per id (copies of an id combine before the shuffle)."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.dropDuplicates([key])


def distinct_texts(df: DataFrame, order: str = "sample_id") -> DataFrame:
    """One row per text (the smallest id), keyed by digest so hot copies combine map-side."""
    keep = df.groupBy(F.sha2("prompt", 256).alias("_digest")).agg(F.min(order).alias(order))
    return df.join(keep.select(order), order, "left_semi")


def write_prompts(df: DataFrame, path: str) -> None:
    """Write partitioned by dataset and split.

    Rows are spread by a hash salt inside each partition folder, so one dominant dataset
    does not end in one writer task.
    """
    writers = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("sample_id"), F.lit(writers)))
    spread = salted.repartition(writers, "dataset", "split", "_salt").drop("_salt")
    spread.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)
