"""Embedding whitening with MLlib's BlockMatrix.

Rows are numbered without gaps and become an indexed row matrix of centred vectors, cut into blocks of
rows.  The scatter of the fit rows is a block product: the transposed blocks are laid out with one block
row per group of ``GROUP`` row blocks, so every group's product is summed where it is made and only one
small matrix per group is added up.  Its eigenvectors are found locally, and the centred matrix times the
whitening matrix, a block product again, gives the projected rows.

Every entry c becomes the whole number floor(64 c) + 1000000.  The fit list holds each distinct vector
once (told apart by a 128-bit hash).  Sums are exact in whole numbers; vectors are centred before any
product.  Blocks hold ``block_rows`` rows, so memory in a task follows that and the dimension; the driver
gets a (dimension x dimension) matrix, its sums, and the coordinates of the blocks.

Defined cases: a vector that is null, or holds a null or an entry that isn't finite, is dropped, as is one
whose length isn't the most frequent one (ties: the longer); empty vectors go too.  Repeated rows and
repeated or null ids stay, each with its own result.  A component of no variance has whitened null and
explained 0 (null where no component has any).  Scaled entries
beyond 2**56 count as 2**56; a deviation beyond a long is null.  Other columns are
ignored.  An empty table, or one without a usable vector, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch, numbered

SCALE, SHIFT = 64, 1_000_000
GROUP = 32
BLOCK_ROWS = (1 << 10, 1 << 16)
BLOCK_COLUMNS = 1 << 10
NO_VARIANCE = 1e-12
LARGEST = float(1 << 56)
LONG = 1 << 63


def whole_vectors(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x (array<long>) of the rows whose vector is usable."""
    entry = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entry, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + SHIFT)
    return embeddings.filter((F.size(vector) > 0) & usable).select(F.col(key).alias("key"), x.alias("x"))


class Whitening:
    """Principal components of unit variance, up to ``components`` of them."""

    def __init__(self, components: int = 16, block_rows: int | None = None):
        self.components, self.block_rows = components, block_rows

    def apply(self, embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """Per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
        spark = embeddings.sparkSession
        scratch = Scratch(spark, "whitening")
        kind = embeddings.schema[key].dataType.simpleString()
        empty = spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
        rows = whole_vectors(embeddings, key, vector)
        length = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        if length is None:
            return empty
        rows = numbered(rows.filter(F.size("x") == length.d), scratch, "vectors", "at")
        firsts = rows.groupBy(F.xxhash64("x"), F.xxhash64(F.lit(1), "x")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fit"))
        rows = scratch.put(rows.join(firsts, "at", "left").withColumn("fit", F.coalesce("fit", F.lit(False))), "marked")
        n, sums = self._sums(rows, length.d)
        total = rows.count()
        per_task = -(-total // (4 * spark.sparkContext.defaultParallelism))
        block = self.block_rows or min(max(per_task, BLOCK_ROWS[0]), BLOCK_ROWS[1])

        centred = rows.withColumn("v", self._centred(n, sums))
        every = self._matrix(centred, total, length.d).toBlockMatrix(block, BLOCK_COLUMNS)
        fitted = self._matrix(centred.filter("fit"), total, length.d).toBlockMatrix(block, BLOCK_COLUMNS)
        covariance = scatter(fitted) / n
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values, kind="stable")[::-1][: self.components]
        values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
        real = values > NO_VARIANCE * max(trace, 0.0)
        matrix = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)

        projected = every.multiply(self._local(spark, matrix, block)).toIndexedRowMatrix()
        done = scratch.put(self._rows(projected, spark), "projected")
        marked = done.join(rows.select("at", "key", "fit", self._deviation(n, sums).alias("deviation")), "at")
        error = self._identity_error(marked.filter("fit").select("z"), real, n)
        told = marked.select("key", "deviation", F.posexplode("z").alias("i", "z"))
        has_variance = F.array(*(F.lit(bool(r)) for r in real))
        explained = F.array(*(F.lit(float(max(v, 0.0) / trace) if trace > 0 else None).cast("double") for v in values))
        return told.select(
            F.col("key").alias(key), (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
            F.when(F.get(has_variance, F.col("i")), F.col("z")).alias("whitened"), F.get(explained, F.col("i")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )

    @staticmethod
    def _sums(rows: DataFrame, length: int) -> tuple[int, list[int]]:
        """How many fit rows there are, and their sum per dimension, exact."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = 0, np.zeros(length, object)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, length)
                count += len(x)
                total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, length), pa.int32()), pa.array([str(count), *map(str, total)])], ["i", "s"])

        parts = rows.filter("fit").select("x").mapInArrow(add, "i int, s string")
        found = dict(parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
        return int(found[-1]), [int(found[i]) for i in range(length)]

    @staticmethod
    def _centred(n: int, sums: list[int]) -> Column:
        """x less the mean, from whole numbers where these fit a long."""
        offsets = F.array(*(F.struct(F.lit(s if abs(s) < LONG else None).cast("long").alias("s"), F.lit(float(s / n)).alias("mean")) for s in sums))
        own = lambda x, o: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), o["s"]).cast("double") / n
        return F.zip_with("x", offsets, lambda x, o: F.coalesce(own(x, o), x.cast("double") - o["mean"]))

    @staticmethod
    def _deviation(n: int, sums: list[int]) -> Column:
        """Sum of (n x - S) squared; whole numbers that overflow give null."""
        offsets = F.array(*(F.lit(s if abs(s) < LONG else None).cast("long") for s in sums))

        def squared(x: Column, s: Column) -> Column:
            off = F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), s)
            return F.try_multiply(off, off)

        return F.aggregate(F.zip_with("x", offsets, squared), F.lit(0).cast("long"), F.try_add)

    @staticmethod
    def _matrix(rows: DataFrame, n_rows: int, n_columns: int) -> IndexedRowMatrix:
        indexed = MLUtils.convertVectorColumnsFromML(rows.select(F.col("at").alias("index"), array_to_vector("v").alias("vector")), "vector")
        return IndexedRowMatrix(indexed, n_rows, n_columns)

    @staticmethod
    def _local(spark, matrix: np.ndarray, block: int) -> BlockMatrix:
        """The whitening matrix in blocks that fit the columns of the rows' blocks."""
        d, k = matrix.shape
        cut = [((i, 0), DenseMatrix(len(part), k, part.ravel(order="F"))) for i, part in enumerate(np.split(matrix, range(BLOCK_COLUMNS, d, BLOCK_COLUMNS)))]
        return BlockMatrix(spark.sparkContext.parallelize(cut, 1), BLOCK_COLUMNS, k, d, k)

    @staticmethod
    def _rows(projected: IndexedRowMatrix, spark) -> DataFrame:
        pairs = projected.rows.map(lambda r: (r.index, [float(v) for v in r.vector.toArray()]))
        return spark.createDataFrame(pairs, "at long, z array<double>")

    @staticmethod
    def _identity_error(fitted: DataFrame, real: np.ndarray, n: int) -> float | None:
        """Largest entry of the whitened fit rows' covariance less the identity, over components with variance."""
        width = len(real)
        if not real.any():
            return None

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width + 1, width))
            for batch in batches:
                z = batch.column(0).flatten().to_numpy().reshape(-1, width)
                total += np.vstack((z.T @ z, z.sum(axis=0)))
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "s"])

        found = dict(fitted.mapInArrow(add, "i int, s double").groupBy("i").agg(F.sum("s")).collect())
        total = np.array([found[i] for i in range((width + 1) * width)]).reshape(width + 1, width)
        mean = total[width] / n
        return float(np.abs(total[:width] / n - np.outer(mean, mean) - np.eye(width))[np.ix_(real, real)].max())


def scatter(rows: BlockMatrix) -> np.ndarray:
    """rows' transpose times rows.

    A plain block product would bring all blocks to one task for each block of the result.  Here transposed
    block k lies in block row ``k // GROUP`` of a taller matrix, which gives one product per group.
    """
    d, across = rows.numCols(), rows.colsPerBlock
    columns = math.ceil(d / across)
    groups = math.ceil(rows.numRowBlocks / GROUP)
    size = across if columns > 1 else d

    def laid_out(block):
        (k, j), m = block
        values = np.zeros((size, m.numRows))
        values[: m.numCols] = m.toArray().T
        return ((k // GROUP * columns + j, k), DenseMatrix(size, m.numRows, values.ravel(order="F")))

    tall = BlockMatrix(rows.blocks.map(laid_out), size, rows.rowsPerBlock, groups * columns * size, rows.numRows())
    product = tall.multiply(rows)

    def placed(block):
        (i, j), m = block
        out = np.zeros((d, d))
        low = i % columns * size
        part = m.toArray()[: d - low]
        out[low : low + len(part), j * across : j * across + m.numCols] = part
        return out

    return product.blocks.map(placed).treeReduce(np.add)
