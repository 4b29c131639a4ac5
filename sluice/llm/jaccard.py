"""Grouped prefix join: documents whose shingle sets are alike, and the components they form.

1. Every text becomes its set of k-word shingles (64-bit hashes).  Texts with equal sets are one class.
2. One pass counts shingles in a table of fixed size.  Rare shingles come first in the order used for
   prefixes; any fixed order gives the same result, a good one gives few candidates.
3. Two sets with Jaccard similarity t or more share a shingle in their prefixes of n - ceil(t n) + 1.
   Classes with equal prefix and size form one group; only groups are indexed by prefix shingles.
4. Pairs of groups that share a shingle pass the size bound and either the bound on the number of
   common prefix shingles (rare shingles) or the position bound (common ones), expand to their members,
   pass a bitmap bound on the symmetric difference, and are verified on the full sets.

A shingle in few groups yields all its pairs.  One in many groups first yields only the pairs of one
pivot, the member that has it earliest; members that are linked by then need no pair of their own.
Pivots repeat until the pairs left are few or ``ROUNDS`` is over; then all pairs left that pass the
bounds are verified.  So no link between components is lost, and a large group of near copies costs
pairs in proportion to its size.

Defined cases: a null or blank text has no set, size 0, and is alone in its component.  A text with
fewer than k words has one shingle, the whole sequence.  Repeated rows and equal sets are one class.
Columns other than the keys and the text are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch, components, counters, fresh
from sluice.llm.words import distinct_runs, lists, mix, shingles, text_slices, words_of

SKETCH_BITS = 22
SIEVE_BITS = 22
BITMAP_WORDS = 8
SMALL = 16
ROUNDS = 8
WORK = 8


def sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of the texts, slice by slice, with each slice's first row."""
    for low, _, data, offsets in text_slices(texts):
        hashes, _, bounds = shingles(words_of(data, offsets, fold=True), k)
        yield low, distinct_runs(hashes, bounds)


def shingle_levels(texts: DataFrame, k: int) -> np.ndarray:
    """How common shingles are, by the high bits of their hash, in eighths of a power of two."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, sets in sets_of(batch.column(0), k):
                flat = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                places, times = np.unique(flat, return_counts=True)
                total[places] += times
        return total

    def level(seen: np.ndarray) -> np.ndarray:
        return np.round(8 * np.log2(np.maximum(seen, 1))).clip(0, 255)

    return counters(texts, count, size, level, np.uint8)


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity of the shingles per bit: the bits by which two bitmaps differ bound the sets' difference."""
    bits = 64 * BITMAP_WORDS
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = (mix(np.concatenate(sets)) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(owner * bits + flat, minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), bits), axis=1).view(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


BIT_COLUMNS = [f"bits{i}" for i in range(BITMAP_WORDS)]
SIGNATURE = "_key long, n long, sig binary, gid long, prefix array<long>, " + ", ".join(f"{c} long" for c in BIT_COLUMNS)


class JaccardJoin:
    """Near-duplicate components of texts by shingle sets; see the module for the method.

    ``k`` words per shingle; two sets are linked when 100 |A & B| >= percent |A | B|.
    """

    def __init__(self, k: int = 5, percent: int = 80):
        self.k, self.percent = k, percent

    def groups(self, docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """One row per row of docs: the keys, n_shingles, and the class id of its component (null if blank).

        Copies within a component have the same ``component``, a binary id.
        """
        scratch = Scratch(docs.sparkSession, "jaccard")
        rows = docs.select(F.xxhash64(*keys).alias("_key"), *keys, F.col(text).alias("_text"))
        levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(rows.select("_text"), self.k))
        signatures = scratch.put(self._signatures(rows, keys, levels), "signatures")
        levels.destroy()
        members, size = scratch.measured(
            signatures.filter("n > 0").drop(*keys).dropDuplicates(["sig"]), "classes", n=F.count(F.lit(1))
        )
        found = self._roots(rows, members, size["n"], scratch)
        sized = signatures.select(*keys, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
        return (
            sized.join(found.withColumnRenamed("item", "sig"), "sig", "left")
            .select(*keys, "n_shingles", F.coalesce("root", "sig").alias("component"))
        )

    def _signatures(self, rows: DataFrame, keys: list[str], levels: Broadcast) -> DataFrame:
        k, percent = self.k, self.percent
        shift = np.uint64(64 - SKETCH_BITS)

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, sets in sets_of(batch.column("_text"), k):
                    prefixes = []
                    for s in sets:
                        size = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                        order = np.argsort(levels.value[(s >> shift).astype(np.int64)], kind="stable")
                        prefixes.append(s[order[:size]])
                    n = np.array([len(s) for s in sets], np.int64)
                    gids = [np.frombuffer(_digest(np.append(p, np.uint64(len(s)))), np.int64)[0] for p, s in zip(prefixes, sets, strict=True)]
                    part = batch.slice(low, len(sets))
                    columns = [part.column("_key"), pa.array(n), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(gids, pa.int64()), lists(prefixes)]
                    columns += [pa.array(bits) for bits in _bitmaps(sets).T]
                    names = ["_key", "n", "sig", "gid", "prefix", *BIT_COLUMNS]
                    yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in keys)], [*names, *keys])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
        return rows.mapInArrow(sign, f"{SIGNATURE}, {kinds}")

    def _roots(self, rows: DataFrame, members: DataFrame, classes: int, scratch: Scratch) -> DataFrame:
        """The component (item, root) of every class that is linked with another."""
        postings = members.dropDuplicates(["gid", "n"]).select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
        packed = postings.select("token", "gid", (F.shiftleft("n", 32) + F.col("pos")).alias("place"))
        shared = packed.groupBy("token").count().filter("count > 1").select("token")
        cross = scratch.put(
            packed.join(shared, "token").select(
                F.col("token").alias("key"), F.col("gid").alias("item"),
                F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("pos"),
            ),
            "shared",
        )
        members = members.drop("prefix")
        several = members.groupBy("gid").count().filter("count > 1").select("gid")
        inner = scratch.put(
            members.join(several, "gid").select(F.col("gid").alias("key"), F.col("sig").alias("item"), "n", F.lit(0).cast("long").alias("pos")),
            "inner",
        )
        budget = WORK * max(1, classes)
        labels = members.sparkSession.createDataFrame([], "item binary, root binary")
        step = 0
        while True:
            rooted = members.select("sig", "gid").join(labels.withColumnRenamed("item", "sig"), "sig", "left").withColumn(
                "root", F.coalesce("root", "sig")
            )
            by_group = rooted.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")).select(
                F.col("gid").alias("item"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("root")
            )
            last = step >= ROUNDS
            group_pairs, cross = self._round(cross, by_group, budget, last, step, step == 0, scratch)
            own_pairs, inner = self._round(inner, rooted.select(F.col("sig").alias("item"), "root"), budget, last, step, False, scratch)
            if group_pairs is None and own_pairs is None:
                return labels
            one = members.join(labels.withColumnRenamed("item", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
            pairs = None
            if group_pairs is not None:
                pairs = self._bounded(self._side(one, "gid", "a"), self._side(one, "gid", "b"), group_pairs)
            if own_pairs is not None:
                own = self._bounded(self._side(one, "sig", "a"), self._side(one, "sig", "b"), own_pairs)
                pairs = own if pairs is None else pairs.union(own).distinct()
            candidates, size = scratch.measured(pairs, "candidates", n=F.count(F.lit(1)))
            step += 1
            if size["n"]:
                labels = self._labelled(labels, self._verified(rows, members, candidates, scratch), scratch)

    @staticmethod
    def _labelled(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
        """Labels after further links: only the roots that the links join are contracted."""
        known = labels.withColumnRenamed("root", "r")
        ends = (
            links.join(known.withColumnsRenamed({"item": "a", "r": "ra"}), "a", "left")
            .join(known.withColumnsRenamed({"item": "b", "r": "rb"}), "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        )
        joined = components(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), scratch)
        above = joined.select(F.col("item").alias("root"), F.col("root").alias("top"))
        moved = labels.join(above, "root", "left").select("item", F.coalesce("top", "root").alias("root"))
        fresh = joined.join(labels.select("item"), "item", "left_anti")
        return scratch.put(moved.union(fresh), "labels")

    def _round(
        self, state: DataFrame, roots: DataFrame, budget: int, last: bool, step: int, counted: bool, scratch: Scratch
    ) -> tuple[DataFrame | None, DataFrame]:
        """Pairs of items to look at next, and the buckets that still hold others."""
        state = state.select("key", "item", "n", "pos").join(roots, "item", "left")
        parts = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least_n"))
        within = F.sum(F.when(F.col("root").isNull(), F.col("size")).otherwise(F.col("size") * F.col("size")))
        open_keys = (
            parts.groupBy("key")
            .agg(
                F.sum("size").alias("size"), F.min("least_n").alias("least_n"),
                (F.sum("size") * F.sum("size") - within).alias("apart"),
            )
            .filter("apart > 0")
        )
        reach = (100 + self.percent) * (F.col("n") - F.col("pos")) * 100 >= self.percent * (
            F.col("n") * 100 + F.greatest(F.col("least_n") * 100, F.col("n") * self.percent)
        )
        weight = F.sum(F.when(F.col("size") > SMALL, F.col("apart") / F.col("size")).otherwise(0))
        state, figures = scratch.measured(state.join(open_keys, "key").withColumn("reach", reach), "open", w=weight, n=F.count(F.lit(1)))
        if not figures["n"]:
            return None, state
        small, large = state.filter(F.col("size") <= SMALL), state.filter((F.col("size") > SMALL) & F.col("reach"))
        pairs = self._counted(state, small) if counted else self._all_pairs(small.filter("reach"))
        if last or (figures["w"] or 0) <= budget:
            pairs, rest = pairs.union(self._all_pairs(large)), state.limit(0)
        else:
            chosen = large.groupBy("key").agg(
                F.min_by(F.struct("key", "item", "n", "pos", "root"), F.struct("pos", F.xxhash64("item", F.lit(step)))).alias("p")
            ).select("p.*")
            chosen = scratch.put(chosen, "pivots")
            pivoted = self._named(large, "a").join(
                self._named(chosen, "b"), (F.col("a_key") == F.col("b_key")) & (F.col("a_item") != F.col("b_item")) & self._may_link()
            )
            pairs = pairs.union(pivoted.select("a_item", "b_item"))
            rest = scratch.put(large.join(chosen.select("key", "item"), ["key", "item"], "left_anti"), "rest")
        return pairs.select(F.least("a_item", "b_item").alias("a"), F.greatest("a_item", "b_item").alias("b")).distinct(), rest

    def _all_pairs(self, state: DataFrame) -> DataFrame:
        """Pairs of items in one bucket that pass the size and position bounds."""
        together = (F.col("a_key") == F.col("b_key")) & (F.col("a_item") < F.col("b_item"))
        return self._named(state, "a").join(self._named(state, "b"), together & self._may_link()).select("a_item", "b_item")

    def _counted(self, state: DataFrame, small: DataFrame) -> DataFrame:
        """Pairs of items with enough common prefix shingles.

        What two sets share is at most: the common shingles of their prefixes, counted here over the
        small buckets, plus the fewer prefix shingles of the two that lie in large buckets, plus what
        follows the prefix in the one set whose prefix ends first.
        """
        load = state.filter(F.col("size") > SMALL).groupBy("item", "n").agg(F.count(F.lit(1)).alias("load"))
        loaded = small.join(load, ["item", "n"], "left").select("key", "item", "n", F.coalesce("load", F.lit(0)).alias("load"))
        one, two = (loaded.select(*(F.col(c).alias(f"{side}_{c}") for c in loaded.columns)) for side in "ab")
        together = (F.col("a_key") == F.col("b_key")) & (F.col("a_item") < F.col("b_item"))
        sizes = 100 * F.least("a_n", "b_n") >= self.percent * F.greatest("a_n", "b_n")
        after = [F.ceil(self.percent * F.col(n) / 100) - 1 for n in ("a_n", "b_n")]
        most = F.col("c") + F.least("a_load", "b_load") + F.greatest(*after)
        return (
            one.join(two, together & sizes)
            .groupBy("a_item", "b_item", "a_n", "b_n", "a_load", "b_load")
            .agg(F.count(F.lit(1)).alias("c"))
            .filter((100 + self.percent) * most >= self.percent * (F.col("a_n") + F.col("b_n")))
            .select("a_item", "b_item")
        )

    @staticmethod
    def _named(state: DataFrame, side: str) -> DataFrame:
        return state.select(*(F.col(c).alias(f"{side}_{c}") for c in ("key", "item", "n", "pos", "root")))

    def _may_link(self) -> Column:
        """Size and position bounds, for items that aren't known to be in one component."""
        most = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
        apart = F.col("a_root").isNull() | F.col("b_root").isNull() | (F.col("a_root") != F.col("b_root"))
        return apart & ((100 + self.percent) * most >= self.percent * (F.col("a_n") + F.col("b_n")))

    @staticmethod
    def _side(members: DataFrame, by: str, side: str) -> DataFrame:
        return members.select(
            F.col(by).alias(side), F.col("sig").alias(f"{side}_sig"), F.col("n").alias(f"{side}_n"), F.col("root").alias(f"{side}_root"),
            *(F.col(c).alias(f"{side}_{c}") for c in BIT_COLUMNS),
        )

    def _bounded(self, left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
        """Expand items to members; keep pairs of different components whose bitmaps allow a link."""
        differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in BIT_COLUMNS), F.lit(0))
        total = F.col("a_n") + F.col("b_n")
        return (
            pairs.join(left, "a")
            .join(right, "b")
            .filter((F.col("a_root") != F.col("b_root")) & ((100 + self.percent) * (total - differ) >= 2 * self.percent * total))
            .select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b"))
            .distinct()
        )

    def _verified(self, rows: DataFrame, members: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(members.select("sig", "_key"), "sig")
        wanted = scratch.put(wanted, "wanted")
        size = 1 << SIEVE_BITS

        def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size, np.uint8)
            for batch in batches:
                total[mix(batch.column(0).to_numpy().view(np.uint64)).astype(np.int64) & (size - 1)] = 1
            return total

        sieve = rows.sparkSession.sparkContext.broadcast(np.packbits(counters(wanted.select("_key"), mark, size, kind=np.bool_)))
        k = self.k

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = mix(batch.column("_key").to_numpy().view(np.uint64)).astype(np.int64) & (size - 1)
                part = batch.filter(pa.array((sieve.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1))
                for low, sets in sets_of(part.column("_text"), k):
                    digests = pa.array([_digest(s) for s in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("_key").slice(low, len(sets)), digests, lists(sets)], ["_key", "sig", "tokens"])

        read_sets = rows.select("_key", "_text").mapInArrow(read, "_key long, sig binary, tokens array<long>")
        sets = scratch.put(read_sets.select("sig", "tokens"), "sets")
        sieve.destroy()
        percent = self.percent

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = batch.column("left"), batch.column("right")
                flat_a, at_a = left.flatten().to_numpy(), left.offsets.to_numpy() - left.offsets[0].as_py()
                flat_b, at_b = right.flatten().to_numpy(), right.offsets.to_numpy() - right.offsets[0].as_py()
                keep = []
                for i in range(batch.num_rows):
                    a, b = flat_a[at_a[i] : at_a[i + 1]], flat_b[at_b[i] : at_b[i + 1]]
                    both = np.sort(np.concatenate((a, b)))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append((100 + percent) * common >= percent * (len(a) + len(b)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("left"))
        right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("right"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return joined.mapInArrow(verify, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """Per row of docs: the key, n_shingles and component_id, the least key of its component."""
    rows = JaccardJoin(k, percent).groups(docs, [key])
    least = rows.filter("component is not null").groupBy("component").agg(F.min(key).alias("component_id"))
    return rows.join(least, "component", "left").select(
        key, "n_shingles", F.when(F.col("component").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id")
    )


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component, the row with the least doc_id stays.

    Rows are numbered by the scan, so that rows with equal or null ids stay apart: docs must be a table on
    files, which every reading numbers alike.  Blank texts stay, and all columns as they are.
    """
    row = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    keyed = numbered.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id"), "text")
    rows = JaccardJoin(k, percent).groups(keyed, ["_row", "_id"])
    rank = F.struct(F.col("_id").isNull().alias("blank"), "_id", "_row")
    first = rows.filter("component is not null").groupBy("component").agg(F.min(rank).alias("first")).select("first._row")
    kept = first.union(rows.filter("component is null").select("_row")).withColumnRenamed("_row", row)
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
