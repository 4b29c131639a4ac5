"""Line dedup over batches: levelled sorted runs of line hashes.

Each batch counts, per line key, the documents of the batch that hold it.  Keys that the runs already
know to be frequent are settled: a sort-merge anti-join against the sorted runs drops them, and the
rest is added as a new run.  When a level has ``fanout`` runs they are merged into one run of the next
level, counts of equal keys are summed, and keys that reach the limit become settled.  So a key is
written at most once per level, and a batch costs its own lines plus one merge pass over the runs.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased; runs hold
two 64-bit hashes of it.  Every row counts as one document; a line that a document repeats counts once.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points are
never dropped; a document that loses every line has the empty text.  Repeated rows are documents of
their own.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 8
KEY = ["h1", "h2"]


def line_hash(key: Column, min_chars: int) -> Column:
    """Two hashes of a line's key; null where the key is too short."""
    pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    return F.when(F.char_length(key) >= min_chars, pair)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keys_of(text: Column) -> Column:
    """The keys of the text's lines, in order, each made once."""
    return F.transform(lines_of(text), lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER))


class LineRuns:
    """Counts of line keys, kept as sorted runs in levels."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 2):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.scratch = Scratch(spark, "lines")
        self.levels: list[list[DataFrame]] = [[]]

    def _run(self, counts: DataFrame, name: str) -> DataFrame:
        """Write a run: hash-partitioned by key, sorted within each file."""
        sorted_counts = counts.select(*KEY, "docs").repartition(*KEY).sortWithinPartitions(*KEY)
        return self.scratch.put(sorted_counts, name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame, text: str = "text") -> None:
        """Count a batch, without the keys that are settled, and add it as a run of the lowest level."""
        hashes = F.array_compact(F.transform(F.array_distinct(keys_of(F.col(text))), lambda x: line_hash(x, self.min_chars)))
        counts = batch.select(F.explode(hashes).alias("key")).groupBy("key.h1", "key.h2").agg(F.count(F.lit(1)).alias("docs"))
        for run in self.runs():
            settled = run.filter(F.col("docs") >= self.min_docs).select(*KEY)
            counts = counts.join(settled.hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._run(counts, "run"))
        self._compact()

    def _compact(self) -> None:
        for level in range(64):
            if level >= len(self.levels) or len(self.levels[level]) < self.fanout:
                return
            merged = self._run(self._merged(self.levels[level]), f"level{level + 1}")
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            self.levels[level] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return every.groupBy(*KEY).agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of all batches."""
        return self._merged(self.runs()).filter(F.col("docs") >= self.min_docs).select(*KEY)

    def strip(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row of docs: key, n_lines, n_dropped, kept (the lines left, joined by a line feed).

        Lines meet the frequent keys in a join salted by row, so that a line which most documents
        hold is dealt over several tasks.
        """
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"), F.col(text).alias("_text"))
        hashes = F.transform(keys_of(F.col("_text")), lambda x: line_hash(x, self.min_chars))
        places = rows.select("_row", F.posexplode(hashes).alias("place", "k")).filter("k is not null").select(
            "_row", "place", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"), F.pmod(F.xxhash64("_row"), F.lit(SALTS)).alias("salt")
        )
        keys = self.scratch.put(self.frequent(), "frequent").withColumn(
            "salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS))))
        )
        dropped = (
            places.join(keys, [*KEY, "salt"]).groupBy("_row").agg(F.collect_list("place").alias("drop"))
        )
        drop = F.coalesce(F.col("drop"), F.array().cast("array<int>"))
        kept = F.filter(lines_of(F.col("_text")), lambda x, i: ~F.array_contains(F.col("_drop"), i))
        return (
            rows.join(dropped, "_row", "left")
            .select("_id", "_text", drop.alias("_drop"))
            .select("_id", F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"), F.when(F.size("_drop") > 0, kept).otherwise(lines_of(F.col("_text"))).alias("_kept"))
            .select(
                F.col("_id").alias(key), "n_lines", (F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
                F.array_join("_kept", "\n").alias("kept"),
            )
        )


def file_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """A table read from files, as up to ``batches`` tables over some of the files each."""
    files = sorted(docs.inputFiles())
    groups = [files[i::batches] for i in range(min(batches, len(files)))]
    return [docs.sparkSession.read.schema(docs.schema).parquet(*group) for group in groups]


def dedup_lines(docs: DataFrame, batches: list[DataFrame], min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop the lines of docs whose key is in at least ``min_docs`` documents of the batches."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    for batch in batches:
        runs.add(batch)
    if not batches:
        runs.add(docs)
    return runs.strip(docs)
