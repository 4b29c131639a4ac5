"""Helpers of the corpus operators: shared tables, counters of fixed size, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sluice.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Intermediate tables in the shared folder, so that a lost executor costs a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, name), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
        """``put``, and aggregates of the rows as they are written, without another job."""
        seen = Observation()
        kept = self.put(df.observe(seen, *(c.alias(k) for k, c in figures.items())), name)
        return kept, seen.get

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``put`` returned, once nothing reads it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
        if path is not None and path.toString().find(self.root.split("/")[-1]) >= 0:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


CHUNK = 1 << 16
COUNTER_SCHEMA = "chunk int, counts binary"


def packed_counts(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The non-empty chunks of an array of counters, each in the narrowest whole-number type."""
    chunks, parts = [], []
    for k in range(0, len(counts), CHUNK):
        part = counts[k : k + CHUNK]
        if top := int(part.max(initial=0)):
            width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
            chunks.append(k // CHUNK)
            parts.append(bytes([width]) + part.astype(f"<u{width}").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _chunk_totals(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = unpacked(data)
            totals[chunk] = totals[chunk] + part if chunk in totals else part
    return totals


def counters(df: DataFrame, count: Callable, size: int, finish: Callable = np.asarray, kind: type = np.int64) -> np.ndarray:
    """Sum arrays of ``size`` counters over all rows; ``count`` turns a partition into one array.

    Each task sends its counters once, packed and cut in chunks; chunks are added up as they stream
    in, and ``finish`` turns them into an array of ``kind`` where they are added.  The driver receives
    ``size`` values of that kind, whatever the input.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed_counts(count(batches))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _chunk_totals(batches).items():
            done = finish(part).astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([done], pa.binary())], ["chunk", "counts"])

    chunks = -(-size // CHUNK)
    partial = df.mapInArrow(each, COUNTER_SCHEMA)
    summed = partial.repartition(min(chunks, 64), "chunk").mapInArrow(total, COUNTER_SCHEMA)
    out = np.full(chunks * CHUNK, finish(np.zeros(1, np.int64))[0], kind)
    for row in summed.collect():  # at most size / CHUNK rows, size values in all
        part = np.frombuffer(row.counts, kind)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(part)] = part
    return out[:size]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): one row (item, root) per vertex, root the least vertex.

    Contraction: every vertex hooks to its least neighbour, chains are quartered until they are stars,
    and edges are renamed to the stars' centres; edges inside a star go.  All tables hold one row
    per vertex or edge left, and each is written once, with the figure that ends its loop.
    """
    rows = F.count(F.lit(1))
    edges, left = scratch.measured(edges.select("a", "b").filter("a <> b").distinct(), "edges", n=rows)
    labels = edges.select(F.col("a").alias("item")).union(edges.select("b")).distinct().withColumn("root", F.col("item"))
    while left["n"]:
        both = edges.union(edges.select("b", "a"))
        parents = scratch.put(
            both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("up")),
            "parents",
        )
        moved = 1
        while moved:
            twice = _jumped(parents)
            parents, figures = scratch.measured(
                _jumped(twice.select("v", "up")).join(parents.select("v", F.col("up").alias("first")), "v")
                .select("v", "up", (F.col("up") != F.col("first")).alias("moved")),
                "jumped", moved=F.count_if("moved"),
            )
            moved, parents = figures["moved"], parents.select("v", "up")
        named = parents.select(F.col("v").alias("root"), F.col("up").alias("top"))
        labels = labels.join(named, "root", "left").select("item", F.coalesce("top", "root").alias("root"))
        edges, left = scratch.measured(
            edges.join(parents.select(F.col("v").alias("a"), F.col("up").alias("ra")), "a")
            .join(parents.select(F.col("v").alias("b"), F.col("up").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges", n=rows,
        )
    return scratch.put(labels, "labels")


def _jumped(parents: DataFrame) -> DataFrame:
    """Every vertex with its parent's parent."""
    above = parents.select(F.col("v").alias("up"), F.col("up").alias("top"))
    return parents.join(above, "up").select("v", F.col("top").alias("up"))


ROW_BITS = 33


def numbered(df: DataFrame, scratch: Scratch, name: str, at: str) -> DataFrame:
    """Write the rows in the order in which their partitions hold them, with ``at``: 0, 1, 2, ... without gaps.

    Numbers come from the written table, so every later reading sees the same.  One count per partition
    goes through the driver.
    """
    kept = scratch.put(df.withColumn(at, F.monotonically_increasing_id()), name)
    counts = kept.groupBy(F.shiftright(at, ROW_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    first, offsets = 0, []
    for row in counts:
        offsets.append((row.part, first - (row.part << ROW_BITS)))
        first += row.n
    shifts = df.sparkSession.createDataFrame(offsets, "part long, shift long").withColumnsRenamed({"part": f"{at}_part", "shift": f"{at}_shift"})
    shifted = kept.join(F.broadcast(shifts), F.shiftright(at, ROW_BITS) == F.col(f"{at}_part"))
    return shifted.withColumn(at, F.col(at) + F.col(f"{at}_shift")).select(*kept.columns)
