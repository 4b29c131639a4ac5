"""Quality classifier: a generalised additive model with pairwise interactions.

1. A text becomes a row of numbers: shares of kinds of characters, word and line statistics, repetition.
2. Each feature is cut in bins at quantiles over all training rows.
3. Boosting goes round the features: each turn fits one shallow tree on the bins of one feature to the
   gradient of the log loss and adds it to that feature's lookup table.  Then the pairs of features
   whose joint bins explain most of what is left get tables of their own, boosted in the same way.
4. A score is the logistic function of the intercept plus one looked-up number per feature and pair.

Trees are fitted on at most ``rows`` training rows, those with the least hash of key and text; bins
and texts are treated whole.

Defined cases: null and empty texts have zero in every feature and get the score of such a row; rows
without a label don't train; without training rows, or with one label only, every score is the smoothed
share of label 1.  Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch
from sluice.llm.words import mix, text_slices, words_of

NAMES = [
    "log_words", "log_chars", "word_length", "long_words", "upper", "upper_words", "lower", "digits", "marks", "bars",
    "bangs", "brackets", "spaces", "wide_bytes", "distinct_words", "top_word", "repeated_pairs", "lines", "line_length",
    "repeated_lines", "stops", "symbol_words", "log_longest_word", "title_words", "commas",
]


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER, DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(bytes(range(48, 58)))
MARK = _flags(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
GROUPS = {
    "upper": UPPER, "lower": LOWER, "digits": DIGIT, "marks": MARK, "bars": _flags(b"|"), "bangs": _flags(b"!?"),
    "brackets": _flags(b"<>{}[]()=;&$#@^*%~"), "spaces": _flags(b" \t\r\n\x0b\x0c"), "wide_bytes": _flags(bytes(range(128, 256))), "commas": _flags(b","),
}


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def _top_and_distinct(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: the count of its commonest value, and how many distinct values it has."""
    top, distinct = np.zeros(n), np.zeros(n)
    if len(values):
        keys = np.sort((owner.astype(np.uint64) << np.uint64(43)) | (values >> np.uint64(21)))
        fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        whose = (keys[fresh] >> np.uint64(43)).astype(np.int64)
        np.maximum.at(top, whose, np.diff(np.append(fresh, len(keys))))
        distinct = np.bincount(whose, minlength=n).astype(float)
    return top, distinct


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text, in the order of ``NAMES``."""
    blocks = []
    for low, high, data, offsets in text_slices(texts):
        n = high - low
        size = np.diff(offsets).astype(float)
        out = dict.fromkeys(NAMES, np.zeros(n))
        words = words_of(data, offsets, fold=True)
        count, owner = words.counts.astype(float), words.owner()
        per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
        length = words.end - words.start
        for name, flags in GROUPS.items():
            out[name] = _sums(flags[data], offsets) / per_byte
        caps = np.concatenate(([0], np.cumsum(UPPER[data])))
        small = np.concatenate(([0], np.cumsum(LOWER[data])))
        signs = np.concatenate(([0], np.cumsum(MARK[data])))
        has_caps, has_small = caps[words.end] - caps[words.start], small[words.end] - small[words.start]
        has_signs = signs[words.end] - signs[words.start]
        first_caps = UPPER[data[words.start]] if len(words.start) else np.zeros(0, bool)
        share = lambda flag: _sums(flag, words.first) / per_word
        out["log_words"], out["log_chars"] = np.log1p(count), np.log1p(size)
        out["word_length"] = _sums(length, words.first) / per_word
        out["long_words"] = share(length > 12)
        out["upper_words"] = share((has_caps > 0) & (has_small == 0))
        out["title_words"] = share(first_caps & (has_small > 0))
        out["symbol_words"] = share(has_signs == length)
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        out["log_longest_word"] = np.log1p(longest)
        top, distinct = _top_and_distinct(owner, words.hash, n)
        out["top_word"], out["distinct_words"] = top / per_word, distinct / np.maximum(np.sqrt(count), 1)
        joined = mix(words.hash[:-1]) + words.hash[1:] if len(owner) > 1 else words.hash[:0]
        same = owner[:-1] == owner[1:] if len(owner) > 1 else np.zeros(0, bool)
        _, pairs = _top_and_distinct(owner[:-1][same] if len(owner) > 1 else owner[:0], joined[same], n)
        out["repeated_pairs"] = 1 - (pairs + 1) / np.maximum(count, 1)
        out["repeated_pairs"][count < 2] = 0
        breaks = np.flatnonzero(data == 10)
        begin = np.union1d(breaks + 1, offsets[:-1])  # lines are compared by the words they hold
        begin = begin[begin < len(data)]
        at = np.searchsorted(offsets, begin, "right") - 1
        last = np.append(begin[1:], len(data))
        word_sums = np.concatenate(([np.uint64(0)], np.cumsum(words.hash, dtype=np.uint64)))
        held = word_sums[np.searchsorted(words.start, last)] - word_sums[np.searchsorted(words.start, begin)]
        full = held != 0
        lines = np.bincount(at[full], minlength=n).astype(float)
        _, kinds = _top_and_distinct(at[full], held[full], n)
        out["lines"] = np.log1p(lines)
        out["line_length"] = np.log1p(count / np.maximum(lines, 1))
        out["repeated_lines"] = np.where(lines > 0, 1 - kinds / np.maximum(lines, 1), 0.0)
        out["stops"] = _sums(_flags(b".")[data], offsets) / per_word
        blocks.append(np.stack([np.asarray(out[name], float) for name in NAMES], axis=1))
    return np.concatenate(blocks) if blocks else np.zeros((0, len(NAMES)))


def _tree(grad: np.ndarray, weight: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A tree over ordered bins: the step of each bin, from sums of gradients and weights per bin."""
    out = np.zeros(len(grad))

    def grow(a: int, b: int, left: int) -> None:
        g, w = grad[a:b], weight[a:b]
        if left and b - a > 1:
            gs, ws = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
            gain = gs**2 / (ws + 1) + (g.sum() - gs) ** 2 / (w.sum() - ws + 1) - g.sum() ** 2 / (w.sum() + 1)
            gain[(ws < least) | (w.sum() - ws < least)] = -1
            cut = int(gain.argmax())
            if gain[cut] > 1e-9:
                grow(a, a + cut + 1, left - 1)
                grow(a + cut + 1, b, left - 1)
                return
        out[a:b] = -g.sum() / (w.sum() + 1)

    grow(0, len(grad), depth)
    return out


class AdditiveModel:
    """Cut points and lookup tables; scoring is one bin search and one addition per term."""

    def __init__(self, cuts: list[np.ndarray], intercept: float, tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]], coarse: int):
        self.cuts, self.intercept, self.tables, self.pairs, self.coarse = cuts, intercept, tables, pairs, coarse

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, rows[:, i], "right") for i, c in enumerate(self.cuts)], axis=1) if len(self.cuts) else np.zeros((len(rows), 0), int)

    def coarse_bins(self, bins: np.ndarray) -> np.ndarray:
        """Bins joined to at most ``coarse`` per feature, for the pairs."""
        return np.stack([bins[:, i] * self.coarse // (len(c) + 1) for i, c in enumerate(self.cuts)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        if self.pairs:
            wide = self.coarse_bins(bins)
            for i, j, t in self.pairs:
                out += t[wide[:, i], wide[:, j]]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.bins(features(texts)))))


def measured(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per row of docs: the keys, _draw (a hash that orders the sample, of keys and text) and the features."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = features(batch.column("_text"))
            held = [batch.column(k) for k in (*keys, "_draw")]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(v) for v in values.T)], [*keys, "_draw", *NAMES])

    drawn = docs.select(*keys, F.xxhash64(*keys, text).alias("_draw"), F.col(text).alias("_text"))
    return drawn.mapInArrow(run, f"{kinds}, _draw long, " + ", ".join(f"{n} double" for n in NAMES))


class AdditiveTrainer:
    """Cyclic boosting of feature tables, then of pair tables."""

    def __init__(self, rows: int = 20_000, bins: int = 64, rounds: int = 150, rate: float = 0.1, depth: int = 2, pairs: int = 8, pair_rounds: int = 60, coarse: int = 8, least: float = 5.0):
        self.rows, self.bins, self.rounds, self.rate, self.depth = rows, bins, rounds, rate, depth
        self.n_pairs, self.pair_rounds, self.coarse, self.least = pairs, pair_rounds, coarse, least

    def fit(self, train: DataFrame) -> AdditiveModel:
        """``train`` has _text and _label (0 or 1)."""
        return self.fit_measured(measured(train, ["_label"], "_text"))

    def fit_measured(self, rows: DataFrame) -> AdditiveModel:
        """``rows`` has _label (0 or 1) beside the columns of ``measured``."""
        scratch = Scratch(rows.sparkSession, "quality")
        labelled = rows.filter("_label is not null")
        kept = scratch.put(labelled.select("_draw", F.col("_label").cast("int").alias("_label"), *NAMES), "measured")
        try:
            shares = [i / self.bins for i in range(1, self.bins)]
            cuts = [np.unique(c) for c in kept.approxQuantile(NAMES, shares, 0.002)]
            chosen = kept.orderBy("_draw", "_label", *NAMES).limit(self.rows)
            spec = self

            def learn(pdf: pd.DataFrame) -> pd.DataFrame:
                model = spec.learn(pdf[NAMES].to_numpy(), pdf["_label"].to_numpy(), cuts)
                return pd.DataFrame(
                    {
                        "intercept": [model.intercept], "tables": [[list(t) for t in model.tables]],
                        "places": [[[i, j] for i, j, _ in model.pairs]], "joint": [[list(t.ravel()) for _, _, t in model.pairs]],
                    }
                )

            schema = "intercept double, tables array<array<double>>, places array<array<int>>, joint array<array<double>>"
            row = chosen.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(learn, schema).first()
        finally:
            scratch.drop(kept)
        if row is None:
            return AdditiveModel([], 0.0, [], [], self.coarse)
        joint = [(i, j, np.array(t).reshape(self.coarse, self.coarse)) for (i, j), t in zip(row.places, row.joint, strict=True)]
        return AdditiveModel(cuts, row.intercept, [np.array(t) for t in row.tables], joint, self.coarse)

    def learn(self, rows: np.ndarray, labels: np.ndarray, cuts: list[np.ndarray]) -> AdditiveModel:
        """Boost on the bounded sample, in one task."""
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        model = AdditiveModel(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts], [], self.coarse)
        if len(np.unique(labels)) < 2:
            return model
        bins = model.bins(rows)
        at = np.full(len(labels), model.intercept)
        for _ in range(self.rounds):
            for i, table in enumerate(model.tables):
                p = 1 / (1 + np.exp(-at))
                grad = np.bincount(bins[:, i], p - labels, minlength=len(table))
                weight = np.bincount(bins[:, i], p * (1 - p), minlength=len(table))
                step = self.rate * _tree(grad, weight, self.depth, self.least * 0.25)
                table += step
                at += step[bins[:, i]]
        wide, side = model.coarse_bins(bins), self.coarse
        p = 1 / (1 + np.exp(-at))
        gains = []
        for i in range(len(cuts)):
            for j in range(i):
                cell = wide[:, i] * side + wide[:, j]
                g, w = np.bincount(cell, p - labels, side * side), np.bincount(cell, p * (1 - p), side * side)
                gains.append((float((g**2 / (w + 1)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]:
            model.pairs.append((i, j, np.zeros((side, side))))
        for _ in range(self.pair_rounds):
            for i, j, table in model.pairs:
                p = 1 / (1 + np.exp(-at))
                cell = wide[:, i] * side + wide[:, j]
                g, w = np.bincount(cell, p - labels, side * side).reshape(side, side), np.bincount(cell, p * (1 - p), side * side).reshape(side, side)
                rows_first = _tree(g.sum(1), w.sum(1), 1, self.least * 0.25)
                groups = [np.flatnonzero(rows_first == v) for v in np.unique(rows_first)]
                step = np.zeros((side, side))
                for group in groups:
                    step[group] = self.rate * _tree(g[group].sum(0), w[group].sum(0), self.depth, self.least * 0.25)
                table += step
                at += step[wide[:, i], wide[:, j]]
        return model


def score(docs: DataFrame, model: AdditiveModel, keys: list[str], text: str = "text") -> DataFrame:
    """Per row of docs: the keys and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = sent.value.scores(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(values)], [*keys, "score"])

    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows of docs with a score of at least the threshold, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(batch.column(text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
