"""Logistic regression on sparse rows, for a whole grid of penalties at once.

Every iteration reads the rows once, as blocks of numbers that are written before the first (``features.blocks``): each
task adds up loss and gradient of all candidates that haven't converged, over the coefficients that a block has.  There
are no more tasks than cores, as each hands on a whole gradient.  The sums meet by chunk of coefficients, and the driver,
which holds the coefficients anyway, takes one L-BFGS step per candidate.  Candidates start from a few steps of the
strongest penalty.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.features import BLOCK, LARGE_ROWS, blocks, is_blocks, linear_score, unpacked
from sluice.session import stored

CHUNK = 1 << 16
MEMORY = 10
FIRST_STEPS = 3


@dataclass
class LinearModel:
    """Coefficients and intercept; scores rows that have ``idx`` and ``weight`` arrays."""

    coefficients: np.ndarray
    intercept: float

    def score(self, rows: DataFrame, out: str = "router_score") -> DataFrame:
        return linear_score(rows, self.coefficients, self.intercept, out)

    def table(self, spark: SparkSession) -> DataFrame:
        """(idx, coefficient) of what isn't 0; there are as many as features, which the vocabulary bounds."""
        at = np.flatnonzero(self.coefficients)
        return spark.createDataFrame(pa.table({"idx": pa.array(at.astype(np.int32)), "coefficient": pa.array(self.coefficients[at])}))

    def save(self, spark: SparkSession, path: str) -> None:
        ends = spark.createDataFrame([(-1, self.intercept), (-2, float(len(self.coefficients)))], "idx int, coefficient double")
        self.table(spark).unionByName(ends).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LinearModel":
        found = dict(spark.read.parquet(path).collect())
        coefficients = np.zeros(int(found[-2]))
        for i, value in found.items():
            if i >= 0:
                coefficients[i] = value
        return LinearModel(coefficients, found[-1])


def stored_blocks(rows: DataFrame) -> DataFrame:
    """Written as they are: numbers don't shrink, and every iteration would unpack them again."""
    return stored(rows, "weights", **LARGE_ROWS, compression="none")


def losses_and_gradients(rows: DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log loss and its gradient at every point (columns; the last entry of each is the intercept), in one read.

    rows: ``features.blocks``.
    """
    size, k = points.shape[0] - 1, points.shape[1]
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(points)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 2))
        for entries, idx, factor, place, value, scale, y, w in (part for batch in batches for part in unpacked(batch)):
            idx, place = idx.astype(np.intp), place.astype(np.intp)  # else each use makes its own copy
            some = np.flatnonzero(entries)
            first = (np.cumsum(entries) - entries)[some]
            own, m, product = np.ascontiguousarray(sent.value[idx].T) * factor, np.zeros(len(entries)), np.empty(len(value))
            for i in range(k):
                np.multiply(np.take(own[i], place, out=product, mode="clip"), value, out=product)
                m[some] = np.add.reduceat(product, first) if len(first) else 0.0
                at = (m * scale).reshape(len(y), -1).sum(axis=1) + sent.value[-1, i]
                off = w * (1.0 / (1.0 + np.exp(-at)) - y)
                each_part = np.repeat(off, len(entries) // max(1, len(y))) * scale
                total[i, idx] += np.bincount(place, np.multiply(np.repeat(each_part, entries), value, out=product), len(idx)) * factor
                total[i, size] += off.sum()
                total[i, size + 1] += (w * (np.logaddexp(0.0, at) - y * at)).sum()
        flat = total.ravel()
        parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
        kept = [i for i, part in enumerate(parts) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([parts[i].tobytes() for i in kept], pa.binary())], ["chunk", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(data.as_buffer())
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "data"])

    chunks = -(-k * (size + 2) // CHUNK)
    cores = context.defaultParallelism
    partial = rows.select(*BLOCK).coalesce(cores).mapInArrow(each, "chunk int, data binary")
    summed = partial.repartition(min(chunks, cores), "chunk").mapInArrow(add, "chunk int, data binary")
    flat = np.zeros(k * (size + 2))
    for batch in summed.toArrow().to_batches():  # (features + 2) x candidates numbers
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(data.as_buffer())
            flat[chunk * CHUNK : chunk * CHUNK + len(part)] = part
    sent.destroy()
    flat = flat.reshape(k, size + 2)
    return flat[:, -1], flat[:, :-1].T


class Descent:
    """L-BFGS for one penalty: asks for loss and gradient at a point, is told them, and moves."""

    def __init__(self, start: np.ndarray, penalty: float, tolerance: float):
        self.penalty, self.tolerance = penalty, tolerance
        self.at = self.ask = start
        self.loss, self.slope = np.inf, np.zeros_like(start)
        self.pairs: deque = deque(maxlen=MEMORY)
        self.direction, self.step, self.moves, self.done = np.zeros_like(start), 1.0, 0, False

    def told(self, loss: float, gradient: np.ndarray) -> None:
        """Loss and gradient (without the penalty) at ``ask``."""
        inside = np.append(self.ask[:-1], 0.0)  # the intercept is free
        loss, gradient = loss + 0.5 * self.penalty * inside @ inside, gradient + self.penalty * inside
        if self.moves and loss > self.loss + 1e-4 * self.step * (self.slope @ self.direction):
            self.step /= 2
            self.done = self.step < 1e-8
        else:
            gained = self.loss - loss
            if self.moves:
                s, y = self.ask - self.at, gradient - self.slope
                if s @ y > 1e-12 * (y @ y):
                    self.pairs.append((s, y))
            self.at, self.loss, self.slope = self.ask, loss, gradient
            self.done = np.abs(gradient).max() < self.tolerance or 0 <= gained < self.tolerance * 1e-2 * max(1.0, loss)
            self._turn()
            self.moves += 1
        self.ask = self.at + self.step * self.direction

    def _turn(self) -> None:
        """The next direction, by the two loops over past moves."""
        q, kept = self.slope.copy(), []
        for s, y in reversed(self.pairs):
            a = s @ q / (s @ y)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += (a - y @ q / (s @ y)) * s
        self.direction = -q
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(1e-12, np.linalg.norm(self.slope)))


def fit_grid(rows: DataFrame, size: int, c_values: Sequence[float], max_iter: int = 100, tolerance: float = 1e-5) -> dict[float, LinearModel]:
    """One model per C: weighted mean log loss + |coefficients|^2 / (2 C total weight).

    rows: idx, weight, label, row_weight; or blocks of these, that are written already.
    """
    if not is_blocks(rows):
        rows = stored_blocks(blocks(rows))
    total = float(rows.agg(F.sum("_total")).first()[0] or 1.0)

    def run(descents: list[Descent], reads: int) -> None:
        for _ in range(reads):
            going = [d for d in descents if not d.done]
            if not going:
                return
            losses, gradients = losses_and_gradients(rows, np.stack([d.ask for d in going], axis=1))
            with ThreadPoolExecutor(len(going)) as pool:  # steps are independent, and spend their time in NumPy
                list(pool.map(lambda d, loss, gradient: d.told(loss / total, gradient / total), going, losses, np.ascontiguousarray(gradients.T)))

    strongest = Descent(np.zeros(size + 1), 1.0 / (min(c_values) * total), tolerance)
    run([strongest], FIRST_STEPS)
    descents = {float(c): Descent(strongest.at, 1.0 / (c * total), tolerance) for c in c_values}
    run(list(descents.values()), max_iter)
    return {c: LinearModel(d.at[:-1].copy(), float(d.at[-1])) for c, d in descents.items()}
