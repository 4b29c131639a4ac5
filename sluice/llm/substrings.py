"""Substring dedup with difference-cover anchors: words inside long passages that an earlier document has.

A window is ``length`` consecutive words.  A difference cover D of period v holds, for every distance
d, two members that differ by d modulo v.  So when two documents share a window at places p and q,
some shift j < v makes both p + j and q + j fall on D.  Only the runs of ``length - v + 1`` words that
start on cover positions are compared between documents; every shared window contains a shared run
whose two copies are aligned.  The second step extends: around each shared run, the windows that
contain it at that alignment are compared whole, by two independent 64-bit hashes.  A window is repeated when a document with
a smaller id has it too.

Texts with equal words are one class.  In all but the rows with the class's least id, every word goes
that lies in a window, since that least document has all their windows; they need no anchors.

Comparing is a window function over one hash: rows of a hash are sorted and spilled, not held, and a
hash has one row for each place where it occurs.  Texts are shuffled once, for both steps that need
them together with places.

Defined cases: null and blank texts have no words; a text shorter than a window keeps all words.
Repeats within one document don't count.  Rows that share an id count as one document.  Null ids come
last in the order of ids, and are one document.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.shared import Scratch, counters
from sluice.llm.words import mix, shingles, text_slices, window_hashes, words_of

SIEVE_BITS = 22
LAST = (1 << 63) - 1


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues whose differences reach every residue of the period."""
    size = 1
    while True:
        for rest in combinations(range(2, period), max(0, size - 2)):
            cover = [*range(min(2, size, period)), *rest]
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[i] .. stop[i] - 1 for each i, end to end."""
    count = np.maximum(stop - start, 0)
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class SubstringDedup:
    """Remove words covered by windows that a document with a smaller id has too."""

    def __init__(self, length: int = 50, period: int = 31):
        if not 0 < period <= length:
            raise ValueError("the period must be from 1 to the window's length")
        self.length, self.period = length, period
        self.cover = np.isin(np.arange(period), difference_cover(period))

    def apply(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row of docs: key, n_words, n_removed, kept (the words left, joined by one space)."""
        scratch = Scratch(docs.sparkSession, "substrings")
        rows = docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"), F.col(text).alias("_text")
        )
        rank = F.coalesce(F.col("_id").cast("long"), F.lit(LAST)).alias("rank")
        classes = scratch.put(rows.select("_row", rank, "_text").mapInArrow(self._digests, "_row long, rank long, digest binary"), "classes")
        least = classes.groupBy("digest").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most")
        copies = scratch.put(classes.join(least, "digest").filter("rank > least").select("_row"), "copies")
        sieve = self._sieve(copies)
        anchors = rows.select("_row", rank, "_text").mapInArrow(self._anchors(sieve), "_row long, rank long, pos int, hash long, maybe boolean")
        sure, unsure = anchors.filter("not maybe"), anchors.filter("maybe").join(copies, "_row", "left_anti")
        same = Window.partitionBy("hash")
        shared = (
            sure.unionByName(unsure)
            .select("_row", "pos", "hash", F.min("rank").over(same).alias("least"), F.max("rank").over(same).alias("most"))
            .filter("least < most")
            .select("_row", "pos")
        )
        shared = scratch.put(shared, "anchors")
        sieve.destroy()
        same = Window.partitionBy("hash", "check")
        places = shared.groupBy("_row").agg(F.sort_array(F.collect_set("pos")).alias("places"))
        windows = rows.join(places, "_row").select("_row", rank, "_text", "places").mapInArrow(
            self._windows, "_row long, rank long, pos array<int>, hash long, check long"
        )
        repeated = (
            windows.withColumn("least", F.min("rank").over(same))
            .filter("least < rank")
            .groupBy("_row")
            .agg(F.flatten(F.collect_list("pos")).alias("starts"))
        )
        whole = copies.select("_row", F.array(F.lit(-1)).alias("starts"))
        told = rows.join(repeated.unionByName(whole), "_row", "left").select("_id", "_text", "starts")
        kind = docs.schema[key].dataType.simpleString()
        return told.mapInArrow(self._kept, f"_id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("_id", key)

    def _digests(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes of equal word sequences, of the texts that have a window."""
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("_text")):
                words = words_of(data, offsets, fold=False)
                at = np.flatnonzero(words.counts >= self.length)
                digests = [
                    hashlib.blake2b(words.hash[words.first[i] : words.first[i + 1]].tobytes(), digest_size=16).digest() for i in at
                ]
                part = batch.slice(low, high - low).select(["_row", "rank"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary())], ["_row", "rank", "digest"])

    @staticmethod
    def _place(batch: pa.RecordBatch) -> np.ndarray:
        return mix(batch.column("_row").to_numpy().view(np.uint64)).astype(np.int64) & ((1 << SIEVE_BITS) - 1)

    def _sieve(self, copies: DataFrame) -> Broadcast:
        """One bit for each place that a row among the copies has."""
        size, place = 1 << SIEVE_BITS, self._place

        def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size, np.uint8)
            for batch in batches:
                total[place(batch)] = 1
            return total

        return copies.sparkSession.sparkContext.broadcast(np.packbits(counters(copies, mark, size, kind=np.bool_)))

    def _anchors(self, sieve: Broadcast):
        """Runs on cover positions; ``maybe`` marks texts that a sieve of fixed size can't tell from copies."""
        length, period, cover, place = self.length, self.period, self.cover, self._place

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = place(batch)
                maybe = (sieve.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                for low, high, data, offsets in text_slices(batch.column("_text")):
                    words = words_of(data, offsets, fold=False)
                    hashes, index, _ = shingles(words, length - period + 1, whole_if_short=False)
                    owner = np.searchsorted(words.first, index, "right") - 1
                    pos = index - words.first[owner]
                    keep = cover[pos % period] & (words.counts[owner] >= length)
                    owner = owner[keep]
                    ids = batch.slice(low, high - low).select(["_row", "rank"]).take(pa.array(owner))
                    columns = [*ids.columns, pa.array(pos[keep].astype(np.int32)), pa.array(hashes[keep].view(np.int64)), pa.array(maybe[low:high][owner])]
                    yield pa.RecordBatch.from_arrays(columns, ["_row", "rank", "pos", "hash", "maybe"])

        return find

    def _windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole windows around shared anchors."""
        for batch in batches:
            places = batch.column("places")
            flat, bounds = places.flatten().to_numpy(), places.offsets.to_numpy() - places.offsets[0].as_py()
            for low, high, data, offsets in text_slices(batch.column("_text")):
                words = words_of(data, offsets, fold=False)
                starts, counts = [], []
                for i in range(high - low):
                    pos = flat[bounds[low + i] : bounds[low + i + 1]].astype(np.int64)
                    stop = np.minimum(pos + 1, words.counts[i] - self.length + 1)
                    begin = np.maximum(np.concatenate(([0], pos[:-1] + 1)), pos - self.period + 1)
                    own = _ranges(begin, stop)
                    starts.append(own)
                    counts.append(len(own))
                owner, start = np.repeat(np.arange(high - low), counts), np.concatenate(starts).astype(np.int64)
                at = words.first[owner] + start
                hashes, checks = (window_hashes(words.hash, self.length, seed)[at] if len(at) else np.zeros(0, np.uint64) for seed in (0, 1))
                order = np.lexsort((start, checks, hashes, owner))  # one row per distinct window of a document
                owner, start, hashes, checks = owner[order], start[order], hashes[order], checks[order]
                other = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
                fresh = np.flatnonzero(np.concatenate(([True], other))[: len(owner)])
                places_of = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(start)).astype(np.int32)), pa.array(start.astype(np.int32)))
                ids = batch.slice(low, high - low).select(["_row", "rank"]).take(pa.array(owner[fresh]))
                columns = [*ids.columns, places_of, pa.array(hashes[fresh].view(np.int64)), pa.array(checks[fresh].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "rank", "pos", "hash", "check"])

    def _kept(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drop covered words; the one start -1 stands for all windows of the text."""
        for batch in batches:
            starts = batch.column("starts").to_pylist()
            for low, high, data, offsets in text_slices(batch.column("_text")):
                words = words_of(data, offsets, fold=False)
                counts, removed, kept = words.counts, [], []
                raw = data.tobytes()
                for i in range(high - low):
                    own, n = starts[low + i], int(counts[i])
                    if not own:
                        kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                        removed.append(0)
                        continue
                    at = np.arange(n - self.length + 1) if own[0] < 0 else np.array(own)
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + self.length, -1)
                    left = np.flatnonzero(np.cumsum(steps[:n]) == 0) + words.first[i]
                    kept.append(b" ".join(raw[words.start[j] : words.end[j]] for j in left))
                    removed.append(n - len(left))
                columns = [batch.column("_id").slice(low, high - low), pa.array(counts), pa.array(removed, pa.int64())]
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "n_removed", "kept"])
