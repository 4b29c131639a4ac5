"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of code points of the lower-cased text, hashed to ``2**bits`` columns; runs of
characters that are no letters count as one space.  The value of a column is its share of the text's
n-grams times the column's idf.  So a class score is a mean over the text of idf * weight, one lookup
per n-gram and class, and texts are scored whole in time linear in their length.

* idf counts every training text, as counters of fixed size that tasks add up.
* Weights are fitted by follow-the-regularised-leader with elastic-net penalties, on at most
  ``per_class`` distinct training texts of each language, those with the least hash.
* A temperature is fitted on every tenth of a language's texts, which the weights haven't seen.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when
there is nothing to learn from.  Languages are compared in sorted order, ties go to the first.  Rows
without a language don't train.  Repeated rows are scored alike, and count once among the texts that
weights are fitted on, however many copies there are; idf counts each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.shared import counters
from sluice.llm.words import mix

SLICE_CHARS = 1 << 18
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def _letters() -> np.ndarray:
    """Lower-case code point per code point of the first plane; 32 where it is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class NgramFeatures:
    """Hashed n-gram columns of texts."""

    def __init__(self, orders: tuple[int, ...] = (1, 2, 3), bits: int = 16):
        self.orders, self.bits, self._fold = orders, bits, None

    def __getstate__(self):
        return {"orders": self.orders, "bits": self.bits, "_fold": None}

    def slices(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(low, high, columns, first): columns of texts low:high end to end, text i from first[i - low]."""
        if self._fold is None:
            self._fold = _letters()
        low = 0
        while low < len(texts):
            high, held = low, 0
            while high < len(texts) and (high == low or held + len(texts[high]) <= SLICE_CHARS):
                held += len(texts[high])
                high += 1
            yield low, high, *self._columns(texts[low:high])
            low = high

    def _columns(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)
        folded = np.where(points < 1 << 16, self._fold[np.minimum(points, (1 << 16) - 1)], points)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])  # the gap before each text
        keep = np.concatenate(([True], (folded[1:] != 32) | (folded[:-1] != 32)))
        gaps = starts[1:-1]
        keep[gaps] |= True
        places = np.concatenate(([0], np.cumsum(keep)))
        folded = folded[keep].astype(np.uint64)
        first = places[starts]
        first[-1] = len(folded) - 1
        codes = np.zeros(len(folded), np.uint64)
        columns = []
        total = len(folded)
        for order in range(1, max(self.orders) + 1):
            # the code of the n-gram that ends at each place
            codes = codes * np.uint64(0x100000001B3) + folded if order == 1 else np.concatenate(([np.uint64(0)], codes[:-1])) * np.uint64(0x100000001B3) + folded
            if order in self.orders:
                columns.append((mix(codes + np.uint64(order * int(_STEP) & (1 << 64) - 1)) >> np.uint64(64 - self.bits)).astype(np.int32))
        wide = np.stack(columns, axis=1)[1:total].reshape(-1)
        bounds = np.maximum(first, 0) * len(self.orders)
        return wide, np.minimum(bounds, len(wide))


def train_rows(docs: DataFrame, held_out: Column, label: str, text: str) -> DataFrame:
    return docs.filter(~held_out & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_text"), F.col(label).alias("_label"))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, width: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights (width x classes) after passes of per-coordinate FTRL-proximal over sparse rows."""
    z, n = np.zeros((width, classes)), np.zeros((width, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for at, value, label in rows:
            w = weights(at)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1.0
            g = value[:, None] * p
            squares = g * g
            z[at] += g - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / alpha * w
            n[at] += squares
    return weights(np.arange(width))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden-section search on its logarithm."""
    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class LanguageModel:
    """Fitted languages, idf * weight table and temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float, features: NgramFeatures):
        self.languages, self.table, self.temperature, self.features = languages, table, temperature, features

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for low, high, columns, first in self.features.slices(texts):
            for j in range(len(self.languages)):
                sums = np.concatenate(([0.0], np.cumsum(self.table[j][columns])))
                out[low:high, j] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
        return out / self.temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [has_letter(t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        s = self.scores([t or "" for t in texts])
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]


class LanguageTrainer:
    """Fits a LanguageModel; see the module for what each bound means."""

    def __init__(self, features: NgramFeatures | None = None, per_class: int = 1000, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 4):
        self.features = features or NgramFeatures()
        self.per_class, self.alpha, self.beta, self.l1, self.l2, self.epochs = per_class, alpha, beta, l1, l2, epochs

    def _idf(self, train: DataFrame) -> np.ndarray:
        """Smoothed idf per column, over all training texts; the last counter holds their number."""
        features, width = self.features, 1 << self.features.bits

        def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(width + 1, np.int64)
            for batch in batches:
                for low, high, columns, first in features.slices([t or "" for t in batch.column("_text").to_pylist()]):
                    for a, b in zip(first[:-1], first[1:], strict=True):
                        total[np.flatnonzero(np.bincount(columns[a:b], minlength=width))] += 1
                    total[width] += high - low
            return total

        seen = counters(train.select("_text"), count, width + 1)
        return np.log((1 + seen[width]) / (1 + seen[:width])) + 1

    def sample(self, train: DataFrame) -> DataFrame:
        """_label, _rank, _text: at most ``per_class`` distinct texts of each language.

        Texts are told apart and drawn by hash, one row per text and task; only drawn texts are shuffled.
        """
        span = 1 << 31
        rows = train.withColumn("_hash", F.xxhash64("_text"))
        distinct = rows.select("_label", "_hash").distinct().withColumn("_draw", F.pmod(F.xxhash64("_hash"), F.lit(span)))
        counts = distinct.groupBy("_label").agg((F.lit(2.0 * self.per_class * span) / F.count(F.lit(1)) + 1).alias("_limit"))
        few = distinct.join(F.broadcast(counts), "_label").filter("_draw < _limit")  # about twice the bound
        rank = F.row_number().over(Window.partitionBy("_label").orderBy("_draw", "_hash"))
        drawn = few.select("_label", "_hash", rank.alias("_rank")).filter(F.col("_rank") <= self.per_class)
        return rows.join(F.broadcast(drawn), ["_label", "_hash"]).groupBy("_label", "_rank").agg(F.min("_text").alias("_text"))

    def fit(self, train: DataFrame) -> LanguageModel:
        """``train`` has _text and _label."""
        idf = self._idf(train)
        sample = self.sample(train)
        spec = self

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            return spec.learn(pdf, idf)

        row = sample.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(learn, "languages array<string>, weights binary, temperature double").first()
        if row is None:
            return LanguageModel([], np.zeros((0, 0), np.float32), 1.0, self.features)
        table = np.frombuffer(row.weights, np.float32).reshape(len(row.languages), -1)
        return LanguageModel(list(row.languages), table, row.temperature, self.features)

    def learn(self, pdf: pd.DataFrame, idf: np.ndarray) -> pd.DataFrame:
        """Fit on the bounded sample, in one task."""
        pdf = pdf.sort_values(["_rank", "_label"], kind="stable")
        languages = sorted(set(pdf["_label"]))
        index = {name: i for i, name in enumerate(languages)}
        texts, labels = list(pdf["_text"]), [index[x] for x in pdf["_label"]]
        rows = []
        scale = 10.0
        for low, _, columns, first in self.features.slices(texts):
            for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True), low):
                at, times = np.unique(columns[a:b], return_counts=True)
                rows.append((at, scale * times / max(1, b - a) * idf[at], labels[i]))
        held = pdf["_rank"].to_numpy() % 10 == 0  # of each language, so that one of few texts still trains
        fitted = ftrl([r for r, h in zip(rows, held, strict=True) if not h], len(languages), len(idf), self.alpha, self.beta, self.l1, self.l2, self.epochs)
        checked = [r for r, h in zip(rows, held, strict=True) if h] or rows
        scores = np.array([value @ fitted[at] for at, value, _ in checked])
        temperature = fit_temperature(scores, np.array([r[2] for r in checked]))
        table = (scale * idf[:, None] * fitted).T.astype(np.float32)
        return pd.DataFrame({"languages": [languages], "weights": [np.ascontiguousarray(table).tobytes()], "temperature": [temperature]})


def identify(docs: DataFrame, model: LanguageModel, keys: list[str], text: str = "text") -> DataFrame:
    """Per row of docs: the keys, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                names, scores = sent.value.predict(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keys, "lang_pred", "score"])

    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")
