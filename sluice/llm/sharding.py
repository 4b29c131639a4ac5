"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, split only where it is too full.

A document's bucket is a prefix of a 60-bit hash of its id and text.  A bucket over the byte limit
splits on one more bit.  Bytes are counted per cell of ``STEP`` bits, and the sums over all shorter
prefixes tell at which depth each cell's bucket fits; only cells that are too full themselves are
counted again, ``STEP`` bits deeper.  The directory of a step has a row per cell, never per document,
and documents look it up by equi-joins, which Spark broadcasts while they are small.

Defined cases: rows that are equal in id and text have equal hashes; where those alone are over the
limit, the bits of a hash of their scan position follow.  A document that is over the limit by itself
has a shard of its own.  A null id hashes like the empty string, a null text has no bytes.  An empty
table gives an empty result.  Columns named ``shard`` or ``n_bytes`` are replaced; others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch

STEP = 12
BITS = 60


def hash_bits(key: Column, text: Column) -> Column:
    """60 bits as a whole number, from the id and the text."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def _cell(depth: int) -> list[Column]:
    """The prefix of ``depth`` bits of the two hashes, as two numbers."""
    first, second = min(depth, BITS), max(0, depth - BITS)
    return [F.shiftright("_h1", BITS - first).alias("_c1"), F.shiftright("_h2", BITS - second).alias("_c2")]


def _directory(cells: DataFrame, base: int, limit: int) -> DataFrame:
    """For each cell ``STEP`` bits below ``base``: the depth of its bucket, null where it is still too full."""
    depths = range(base + 1 if base else 0, base + STEP + 1)
    up = F.lit(base + STEP) - F.col("depth")
    second = base >= BITS
    wide = cells.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths))))
    prefix = wide.select(
        "_c1", "_c2", "bytes", "docs", "depth",
        (F.col("_c1") if second else F.call_function("shiftright", F.col("_c1"), up)).alias("p1"),
        (F.call_function("shiftright", F.col("_c2"), up) if second else F.col("_c2")).alias("p2"),
    )
    sums = prefix.groupBy("depth", "p1", "p2").agg(F.sum("bytes").alias("held"), F.sum("docs").alias("rows"))
    fits = sums.filter((F.col("held") <= limit) | (F.col("rows") == 1))
    return (
        prefix.join(fits.select("depth", "p1", "p2", "held"), ["depth", "p1", "p2"], "left")
        .groupBy("_c1", "_c2")
        .agg(F.min(F.when(F.col("held").isNotNull(), F.col("depth"))).alias("_depth"))
    )


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with ``n_bytes`` and ``shard``, the bucket's prefix as a string of bits."""
    scratch = Scratch(docs.sparkSession, "shards")
    kept = docs.drop("shard", "n_bytes")
    rows = kept.select(
        F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("_doc"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        hash_bits(F.col(key), F.col(text)).alias("_h1"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS).alias("_h2"),
    )
    sizes = scratch.put(rows.select("_h1", "_h2", "n_bytes"), "sizes")
    out, base, found = rows, 0, []
    while base < 2 * BITS:
        cells = sizes.groupBy(*_cell(base + STEP)).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        directory = scratch.put(_directory(cells, base, limit), "directory")
        column = f"_depth{base}"
        known = directory.filter("_depth is not null").withColumnRenamed("_depth", column)
        one, two = _cell(base + STEP)
        out = out.withColumns({"_c1": one, "_c2": two}).join(known, ["_c1", "_c2"], "left").drop("_c1", "_c2")
        found.append(column)
        full = directory.filter("_depth is null").select("_c1", "_c2")
        if full.isEmpty():
            break
        sizes = scratch.put(
            sizes.withColumns({"_c1": one, "_c2": two}).join(full, ["_c1", "_c2"], "left_semi").drop("_c1", "_c2"), "sizes"
        )
        base += STEP
    depth = F.coalesce(*(F.col(c) for c in found), F.lit(2 * BITS))
    bits = F.concat(F.lpad(F.bin("_h1"), BITS, "0"), F.lpad(F.bin("_h2"), BITS, "0"))
    return out.select("_doc.*", "n_bytes", F.substring(bits, F.lit(1), depth).alias("shard"))
