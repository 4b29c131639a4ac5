"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "sluice", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder of the session.

    The folder comes from ``spark.checkpoint.dir``.  A machine-local folder is only
    used by a local session that has none; on a cluster the setting is required,
    because executors must all see what is written there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "sluice-scratch")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    For results that several later steps read: it cuts the plan, and a lost executor
    costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of few files over the cores before heavy work on each row.

    A table with at least one input split per core is left alone, so a large table is
    never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


SMALL_BYTES = 8 << 20


def join_small(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Bring a per-group table (thresholds, limits) to the rows of a large table.

    The small side is written once, and its bytes (as text) are added up on the way: up to
    ``SMALL_BYTES`` it is broadcast; beyond that the join treats hot groups apart.  Rows of groups
    without an entry go.
    """
    seen = Observation()
    size = F.sum(F.length(F.to_json(F.struct(*small.columns))))
    kept = stored(small.observe(seen, size.alias("bytes")), "per-group")
    if (seen.get["bytes"] or 0) <= SMALL_BYTES:
        return df.join(F.broadcast(kept), keys)
    return join_hot(df, kept.withColumn("_kept", F.lit(True)), keys).filter("_kept").drop("_kept")


def join_hot(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of rows to a table with one row per key, when a key may hold most rows.

    A key with more than its share of rows (one in four per shuffle partition) counts as
    hot; by that share there are fewer hot keys than four per partition, which bounds what
    is broadcast.  Hot rows stay where they are, and the others meet the table in a plain
    join, where no key is large.
    """
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = stored(counts.filter(F.col("_n") * parts > total).select(*keys), "hot-keys")
    entries = hot.join(table, keys, "left")
    others = df.join(F.broadcast(hot), keys, "left_anti").join(table, keys, "left")
    return df.join(F.broadcast(entries), keys).unionByName(others)


def range_count(spark: SparkSession) -> int:
    """How many sort ranges a distributed running sum uses (grows with the cluster)."""
    return max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
