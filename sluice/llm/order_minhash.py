"""Order MinHash fingerprints: signatures that follow edit distance, not only shared content.

A text's k-mers of code points are numbered by occurrence, so that repeats count.  Each of ``slots``
sketches orders the numbered k-mers by a hash, takes the ``width`` least, puts them back in text order
and hashes the tuple of k-mers.  Sketch i orders by (hash - i / slots of the range) modulo the range:
one hash and one sort per text serve all sketches.  Likeness is the share of equal sketches.

Defined cases: a text shorter than k is one k-mer; one with fewer k-mers than ``width`` uses all; a null
or empty text has zero in every sketch, so empty texts are alike.  Equal texts have equal fingerprints.

``with_next`` brings each document its successor in descending order of ids.  Ids are cut in ranges of
about equal counts; the first document of a range is sent to the range before as well, so each task
reads its documents in order and finds every successor.  Null ids come last; rows with equal ids are
ordered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.words import mix, powers, run_hashes

SLICE_CHARS = 1 << 18
PLACE_BITS = 28
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _kmer_hashes(texts: list[str], k: int) -> list[np.ndarray]:
    """Hashes of the k-mers of each text, in text order."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    values = mix((points.astype(np.uint64) + np.uint64(1)) * _STEP)
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    last = max(len(points) - k + 1, 0)
    windows = mix((sums[k:] - sums[:last]) * down[:last] + np.uint64(k * int(_STEP) & (1 << 64) - 1)) if last else values[:0]
    out, first = [], 0
    for text in texts:
        n = len(text)
        if n >= k:
            out.append(windows[first : first + n - k + 1])
        else:
            out.append(run_hashes(values[first : first + n], np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n)))
        first += n
    return out


class OrderMinHash:
    """Fingerprints of ``slots`` sketches over ``width`` k-mers each."""

    def __init__(self, k: int = 8, slots: int = 64, width: int = 2):
        self.k, self.slots, self.width = k, slots, width
        if slots & (slots - 1) or slots < 2:
            raise ValueError("slots must be a power of two")
        self.starts = np.arange(slots, dtype=np.uint64) * np.uint64((1 << 64) // slots)
        self.within = np.uint64((1 << 64) // slots - 1)

    def near(self, n: int) -> np.uint64:
        """How far above a sketch's start hashes are kept at first; about ``8 width`` fall below it."""
        share = (1 << 64) // self.slots
        return np.uint64(min(share, share * 8 * self.width * self.slots // n))

    def _sketch(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        bits = np.uint64(max(PLACE_BITS, n.bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        places = np.arange(n, dtype=np.uint64)
        by_kmer = hashes & ~low
        by_kmer |= np.arange(n, dtype=np.uint64)
        by_kmer.sort()
        place = by_kmer & low
        by_kmer >>= bits
        again = np.flatnonzero(by_kmer[1:] == by_kmer[:-1]) + 1
        if len(again):  # number repeats: how far back the run of equal k-mers began
            begins = np.concatenate(([True], np.diff(again) > 1))
            count = np.arange(len(again)) - np.flatnonzero(begins)[np.cumsum(begins) - 1] + 1
            by_kmer[again] += count.astype(np.uint64) * _STEP
        drawn = mix(by_kmer) & ~low
        drawn |= place
        width = min(self.width, n)
        order = np.sort(drawn[(drawn & self.within) < self.near(n)])
        if len(order) < n:
            held = np.searchsorted(order, self.starts)
            if np.diff(np.append(held, len(order))).min() < width:  # a sketch reaches beyond what was kept
                order = np.sort(drawn)
        picked = (np.searchsorted(order, self.starts)[:, None] + np.arange(width)) % len(order)
        at = np.sort((order[picked] & low).astype(np.int64), axis=1)
        out = np.zeros(self.slots, np.uint64)
        for j in range(width):
            out = mix(out * _STEP + hashes[at[:, j]])
        return (out >> np.uint64(32)) | np.uint64(1)

    def sketches(self, texts: list[str]) -> np.ndarray:
        """One row of ``slots`` numbers of 32 bits per text."""
        out = np.zeros((len(texts), self.slots), np.uint32)
        low = 0
        while low < len(texts):
            high, held = low, 0
            while high < len(texts) and (high == low or held + len(texts[high]) <= SLICE_CHARS):
                held += len(texts[high])
                high += 1
            for i, hashes in enumerate(_kmer_hashes(texts[low:high], self.k), low):
                if len(hashes):
                    out[i] = self._sketch(hashes)
            low = high
        return out

    @staticmethod
    def written(sketches: np.ndarray) -> list[str]:
        return [row.astype(">u4").tobytes().hex() for row in sketches]

    def fingerprints(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row of docs: key and fingerprint."""
        kind = docs.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(self.written(self.sketches(texts)), pa.string())], ["_id", "fingerprint"])

        rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
        return rows.mapInArrow(run, f"_id {kind}, fingerprint string").withColumnRenamed("_id", key)

    def against_edits(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Fingerprint of each text and of its edited form, whose last third is the next text's beginning.

        Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
        """
        kind = docs.schema[key].dataType.simpleString()
        schema = (
            f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double"
        )
        names = [part.split()[0] for part in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    part = batch.slice(low, 256)
                    ids, texts = part.column("_id").to_pylist(), [t or "" for t in part.column("_text").to_pylist()]
                    guests, own = part.column("_guest").to_pylist(), self.sketches(texts)
                    if held is not None:
                        ids, texts, guests = [held[0], *ids], [held[1], *texts], [held[2], *guests]
                        own = np.concatenate((held[3][None], own))
                    held = (ids[-1], texts[-1], guests[-1], own[-1])
                    at = [i for i in range(len(ids) - 1) if not guests[i]]
                    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in at]
                    theirs = self.sketches(edited)
                    mine = own[at]
                    columns = [
                        pa.array([ids[i] for i in at], part.schema.field("_id").type), pa.array([len(texts[i]) for i in at], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array(self.written(mine), pa.string()), pa.array(self.written(theirs), pa.string()),
                        pa.array((mine == theirs).mean(axis=1)), pa.array((mine == own[[i + 1 for i in at]]).mean(axis=1)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

        return self.with_next(docs, key, text).mapInArrow(run, schema).withColumnRenamed("_id", key)

    @staticmethod
    def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
        """Rows (_id, _text, _guest) in tasks by id range, in descending order; every range ends with a guest.

        The guest rows at the end of a range are the first of the next range, or of the first one.
        """
        spark = docs.sparkSession
        rows = docs.select(
            F.col(key).alias("_id"), F.col(text).alias("_text"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_rank")
        )
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shares = [i / ranges for i in range(1, ranges)] or [0.5]
        cuts = sorted(set(rows.agg(F.percentile_approx("_rank", shares, 10000)).first()[0] or []))
        above = F.array(*(F.lit(c) for c in cuts)).cast("array<long>")
        rows = rows.withColumn("_range", F.size(F.filter(above, lambda c: c > F.col("_rank"))))
        first = {r._range: r.first for r in rows.groupBy("_range").agg(F.max("_rank").alias("first")).collect()}  # a row per range
        filled = sorted(first)
        before = {b: filled[i - 1] for i, b in enumerate(filled)}
        heads = F.array(*(F.lit(first.get(i)) for i in range(len(cuts) + 1))).cast("array<long>")
        back = F.array(*(F.lit(before.get(i)) for i in range(len(cuts) + 1))).cast("array<int>")
        home = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
        visit = F.struct(F.get(back, F.col("_range")).alias("range"), F.lit(True).alias("guest"))
        leads = F.get(heads, F.col("_range")) == F.col("_rank")
        dealt = rows.withColumn("_to", F.explode(F.when(leads, F.array(home, visit)).otherwise(F.array(home))))
        return (
            dealt.select("_id", "_text", "_rank", F.col("_to.range").alias("_range"), F.col("_to.guest").alias("_guest"))
            .repartition(ranges, "_range")
            .sortWithinPartitions("_range", "_guest", F.desc("_rank"), "_text")
            .select("_id", "_text", "_guest")
        )
