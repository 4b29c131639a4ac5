"""Mixing sources to target weights: min-cost flow of tokens, then seeded documents.

1. Documents are aggregated by membership pattern, the set of sources they count for.
2. Targets: a share of all tokens is split over the sources by weight; none gets more than ``repeats``
   times its own tokens, and the excess is shared by weight among the others until none is above.
3. Tokens of patterns flow to sources at least cost.  A pattern offers its tokens ``repeats`` times, and
   the n-th time costs n - 1, so that repeats are used only where first copies don't suffice (the
   costs are convex).  Patterns that share a source form one component; components are solved apart,
   each over its patterns and sources, never over documents.
4. A pattern with flow f and c tokens takes every document floor(f / c) times, and some once more:
   documents in order of a seeded hash until the rest of the flow is used.  Rest that is smaller than
   the next document is offered to the smaller documents, round by round; a last document goes over
   the rest where that comes nearer than stopping short.

The order is cut in hash cells: sums per cell are added up, and only the rows of the one cell per
pattern in which the sum passes the rest are sorted.

Defined cases: a null source is a source of its own, last in order; a null or blank text has size 0
and is taken 0 words (1 copy).  Equal rows are told apart by their place in the scan.  A source
without tokens has target 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.shared import Scratch, components, fresh
from sluice.operators.prefix import ranked

WORD = r"[^\x20\x09-\x0D]+"
CELL_BITS = 12
FILL_ROUNDS = 16
NEAR = 0.0005


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def min_cost_flow(capacity: dict, members: dict, quota: dict, repeats: int) -> dict:
    """Tokens per (pattern, source) that fill the quotas at least cost; as much as fits where they can't.

    Cheapest augmenting paths: the cost of a path is that of the layer in which its first pattern is
    filled, so patterns are tried in order of their next layer and reach sources with quota left over
    any chain of patterns that can give way.
    """
    used = dict.fromkeys(capacity, 0.0)
    left = dict(quota)
    flow: dict = {}
    slack = 1e-9 * max([1.0, *quota.values()])
    while True:
        cheapest = sorted((int(used[p] // capacity[p]) if capacity[p] > 0 else repeats, repr(p), p) for p in capacity)
        path = None
        for layer, _, first in cheapest:
            if layer >= repeats or capacity[first] * repeats - used[first] <= slack:
                continue
            path = _path(first, members, left, flow, slack)
            if path:
                room = capacity[first] * (layer + 1) - used[first]
                if room <= slack:
                    used[first] = capacity[first] * (layer + 1)
                    path = []
                break
        if path is None:
            return {end: amount for end, amount in flow.items() if amount > slack}
        if not path:
            continue
        amount = min([room, left[path[-1][1]], *(flow[p, s] for p, s, given in path if given)])
        used[path[0][0]] += amount
        if room - amount <= slack:
            used[path[0][0]] = capacity[path[0][0]] * (layer + 1)
        left[path[-1][1]] -= amount
        for p, s, given in path:
            flow[p, s] = flow.get((p, s), 0.0) + (-amount if given else amount)


def _path(first, members: dict, left: dict, flow: dict, slack: float):
    """A shortest chain first -> source (<- pattern -> source)* to a source with quota left, or None."""
    holders: dict = {}
    for (p, s), amount in flow.items():
        if amount > slack:
            holders.setdefault(s, []).append(p)
    came: dict = {}
    queue, seen = deque([first]), {first}
    while queue:
        p = queue.popleft()
        for s in members[p]:
            if s in came:
                continue
            came[s] = p
            if left[s] > slack:
                steps, at = [], s
                while True:
                    giver = came[at]
                    steps.append((giver, at, False))
                    if giver == first:
                        return steps[::-1]
                    at = came["from", giver]
                    steps.append((giver, at, True))
            for q in holders.get(s, ()):
                if q not in seen:
                    seen.add(q)
                    came["from", q] = s
                    queue.append(q)
    return None


class SourceMix:
    """A mix of overlapping sources: weights by rank of the source, repeats bounded."""

    def __init__(self, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, repeats: int = 3, seed: int = 42):
        self.weights, self.share, self.repeats, self.seed = list(weights), share, repeats, seed

    def targets(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """Per source: source_size and target; sources in order of code points, null last."""
        each = scratch.put(
            rows.select(F.explode("_pattern").alias("s"), "_size").groupBy("s").agg(F.sum("_size").alias("source_size")), "sources"
        )
        keyed = each.withColumns({"_last": F.col("s").isNull().cast("int"), "_name": F.coalesce("s", F.lit(""))})
        order = ranked(keyed, ["_last", "_name"], name="_rank")
        pick = F.element_at(F.array(*(F.lit(float(w)) for w in self.weights)), ((F.col("_rank") - 1) % len(self.weights) + 1).cast("int"))
        table = scratch.put(order.select("s", "source_size", pick.cast("double").alias("w")), "weighted")
        cap = F.col("source_size") * float(self.repeats)
        total = (rows.agg(F.sum("_size")).first()[0] or 0) * float(self.share)
        level = 0.0
        while True:
            full = F.col("w") * F.lit(level) >= cap
            sums = table.agg(
                F.sum(F.when(full, cap).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")
            ).first()
            rising = (total - sums.given) / sums.open if sums.open else level
            if rising <= level * (1 + 1e-12):
                break
            level = rising
        return table.select("s", "source_size", F.least(F.col("w") * F.lit(level), cap).alias("target"))

    def _flows(self, patterns: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
        """Tokens per pattern and source."""
        ends = patterns.select("_pattern", F.explode("_pattern").alias("s"))
        first = F.concat(F.lit("s"), F.coalesce(F.col("_pattern")[0], F.lit("\0")))
        name = F.concat(F.lit("s"), F.coalesce("s", F.lit("\0")))
        links = components(ends.select(first.alias("a"), name.alias("b")), scratch)
        parts = patterns.select("_pattern", "tokens", first.alias("item")).join(links, "item", "left").withColumn(
            "root", F.coalesce("root", "item")
        )
        wide = parts.select("root", "_pattern", "tokens", F.posexplode("_pattern").alias("place", "_s")).join(
            targets.select(F.col("s").alias("_t"), "target"), F.col("_s").eqNullSafe(F.col("_t"))
        )
        repeats = self.repeats

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(p=[tuple(x) for x in pdf["_pattern"]]).sort_values(["place"], kind="stable")
            names = ["\0" if s is None or s != s else "s" + s for s in pdf["_s"]]
            capacity = dict(zip(pdf["p"], pdf["tokens"].astype(float), strict=True))
            members: dict = {}
            for p, s in zip(pdf["p"], names, strict=True):
                members.setdefault(p, []).append(s)
            quota = dict(zip(names, pdf["target"], strict=True))
            flow = min_cost_flow(capacity, members, quota, repeats)
            return pd.DataFrame(
                {
                    "_pattern": [list(p) for p, _ in flow], "source": [None if s == "\0" else s[1:] for _, s in flow],
                    "tokens": [float(x) for x in flow.values()],
                }
            )

        return wide.select("root", "_pattern", "tokens", "place", "_s", "target").groupBy("root").applyInPandas(
            solve, "_pattern array<string>, source string, tokens double"
        )

    def plan(self, docs: DataFrame, sources: Column, keys: Sequence[str] = (), text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, targets, flows).  rows: _row, keys, _pattern, _size, copies, taken per row of docs."""
        scratch = Scratch(docs.sparkSession, "mix")
        rows = scratch.put(
            docs.select(
                F.monotonically_increasing_id().alias("_row"), *keys, F.array_sort(F.array_distinct(sources)).alias("_pattern"),
                word_count(F.col(text)).alias("_size"), F.xxhash64(F.lit(self.seed), *keys, F.md5(F.col(text))).alias("_draw"),
            ),
            "rows",
        )
        targets = scratch.put(self.targets(rows, scratch), "targets")
        patterns = scratch.put(rows.groupBy("_pattern").agg(F.sum("_size").alias("tokens")), "patterns")
        flows = scratch.put(self._flows(patterns, targets, scratch), "flows")
        used = flows.groupBy("_pattern").agg(F.sum("tokens").alias("flow"))
        times = F.least(F.floor(F.col("flow") / F.col("tokens") + 1e-9), F.lit(self.repeats))
        shares = scratch.put(
            patterns.filter("tokens > 0")
            .join(used, "_pattern")
            .select("_pattern", times.cast("long").alias("times"), "flow", (F.col("flow") - times * F.col("tokens")).alias("rest"))
            .withColumn("near", NEAR * F.col("flow")),
            "shares",
        )
        chosen = self._chosen(rows, shares, scratch)
        copies = F.when(F.col("_size") == 0, 1).otherwise(F.coalesce("times", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long")
        rows = (
            rows.join(shares.select("_pattern", "times"), "_pattern", "left")
            .join(chosen.withColumn("extra", F.lit(1)), "_row", "left")
            .select("_row", *keys, "_pattern", "_size", copies.alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("_size"))
        )
        return rows, targets, flows

    def _chosen(self, rows: DataFrame, shares: DataFrame, scratch: Scratch) -> DataFrame:
        """Rows that are taken once more than the others of their pattern."""
        cell = F.shiftrightunsigned("_draw", 64 - CELL_BITS)
        every = rows.filter("_size > 0").join(
            shares.filter(f"rest > near and times < {self.repeats}").select("_pattern", "rest", "near"), "_pattern"
        ).select("_row", "_pattern", "_size", "_draw", cell.alias("cell"), "rest", "near")
        open_rows = every
        chosen = None
        for _ in range(FILL_ROUNDS):
            fitting = scratch.put(open_rows.filter("_size <= rest"), "fitting")
            if fitting.isEmpty():
                break
            upto = Window.partitionBy("_pattern").orderBy("cell")
            cells = fitting.groupBy("_pattern", "cell", "rest").agg(F.sum("_size").alias("held")).withColumn("upto", F.sum("held").over(upto))
            whole = cells.filter("upto <= rest").select("_pattern", "cell")
            border = cells.filter("upto > rest and upto - held <= rest").select("_pattern", "cell", (F.col("upto") - F.col("held")).alias("before"))
            within = Window.partitionBy("_pattern").orderBy("_draw", "_row")
            edge = fitting.join(border, ["_pattern", "cell"]).withColumn("sum", F.sum("_size").over(within) + F.col("before")).filter("sum <= rest")
            taken = scratch.put(
                fitting.join(whole, ["_pattern", "cell"]).select("_row", "_pattern", "_size").union(edge.select("_row", "_pattern", "_size")), "taken"
            )
            chosen = taken if chosen is None else chosen.union(taken)
            got = taken.groupBy("_pattern").agg(F.sum("_size").alias("got"))
            open_rows = (
                fitting.join(taken.select("_row"), "_row", "left_anti")
                .join(got, "_pattern", "left")
                .withColumn("rest", F.col("rest") - F.coalesce("got", F.lit(0)))
                .drop("got")
                .filter("rest > near")
            )
        if chosen is None:
            chosen = rows.select("_row", "_pattern", "_size").limit(0)
        got = chosen.groupBy("_pattern").agg(F.sum("_size").alias("got"))
        over = (
            every.join(chosen.select("_row"), "_row", "left_anti")
            .join(got, "_pattern", "left")
            .withColumn("rest", F.col("rest") - F.coalesce("got", F.lit(0)))
            .filter("rest > near and _size > rest and _size < 2 * rest")
            .groupBy("_pattern")
            .agg(F.min_by("_row", F.struct("_size", "_draw", "_row")).alias("_row"))
        )
        return scratch.put(chosen.select("_row").union(over.select("_row")), "chosen")


def mixed(docs: DataFrame, mix: SourceMix, sources: Column) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all columns as they are.

    Rows are numbered by the scan: docs must be a table on files, which every reading numbers alike.
    """
    rows, _, _ = mix.plan(docs, sources, ["doc_id"])
    row, copy = fresh(docs, "_row"), fresh(docs, "_copy")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = rows.filter("copies > 0").select(F.col("_row").alias(row), F.sequence(F.lit(1), F.col("copies")).alias(copy))
    return numbered.join(kept, row).withColumn(copy, F.explode(copy)).select(*docs.columns)
