"""Conversation structure repair: cheapest edits after which roles alternate, by an auction on a lattice.

Rows are sorted by conversation and turn and numbered without gaps; ``BLOCK`` consecutive numbers of one
conversation are a block, so no task holds more of a conversation than a block of one-character codes.
A conversation within one block is solved there (``auction.py``).  For others, blocks become matrices of
costs by entry and exit state, ``FAN`` of them become one of the next level, and so on until a conversation
has few; from there the distances to the end go down again, level by level.  With them every block knows,
for each entry state, its least letters and its exit state; these maps go up and the entry states come down.

Order: turn (nulls first), role, the text's first 100 characters, a hash of the text; equal rows are alike.
Defined cases: a null role or text counts as one space; a null conversation is one conversation; an empty
role has no initial, and keeping its row leaves the state as it is.  Null turns count in no gap.  Repeated
rows are duplicates.  Further columns are ignored.  An empty table gives empty results.  Very long texts
are never held together: they are sorted, joined by number and hashed as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import auction
from sluice.llm.shared import Scratch, numbered

BLOCK_BITS = 7
FAN_BITS = 7
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
ROLES = {auction.USER: "user", auction.ASSISTANT: "assistant"}


def _mapped(df: DataFrame, keys: list[str], inputs: list[str], make: Callable, schema: str) -> DataFrame:
    """Per row: the keys and what ``make`` returns for the inputs (a tuple of the schema's columns)."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(*values) for values in zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            made = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made], [*keys, *names])

    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    types = [arrow[part.split()[1]] for part in schema.split(", ")]
    return df.select(*keys, *(c for c in inputs if c not in keys)).mapInArrow(run, f"{kinds}, {schema}")


def _in_order(key: str, *columns: str) -> Column:
    """Values of a small group, in the order of a key, as an array of structs."""
    return F.array_sort(F.collect_list(F.struct(key, *columns)))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls included; the right side's keys are named with an underscore."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"_{k}"])
    return condition


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys where null meets null; the left side's keys stay."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(renamed, _same(left, renamed, keys), how).drop(*(f"_{k}" for k in keys))


def _matrix(codes: str) -> tuple:
    return (auction.rows_stretch(codes),)


def _matrix_of(matrices: list[list[int]]) -> tuple:
    return (auction.stretch([auction.matrix_arcs(m) for m in matrices], False),)


def _exits(matrices: list[list[int]], exits: list[int] | None) -> tuple:
    """Distances to the end behind every stretch, flat; ``exits`` None: these stretches are the whole."""
    if exits is None:
        lattice = auction.Lattice([auction.matrix_arcs(m) for m in matrices], auction.ACCEPT, False, True)
    else:
        lattice = auction.Lattice([auction.matrix_arcs(m) for m in matrices], _sink(exits), False, False)
    behind = lattice.borders()
    if exits is not None:
        behind[-1] = tuple(exits)
    return ([cost for border in behind for cost in border],)


def _sink(exits: list[int]) -> tuple[int | None, ...]:
    """Costs of leaving, less what all have in common."""
    least = min(exits)
    return tuple(None if e >= auction.FAR else e - least for e in exits)


def _traces(codes: str, exits: list[int] | None, last: bool | None) -> tuple:
    """Letters by entry state, and exit states; -1 where there is no way."""
    if exits is None:
        found = auction.rows_trace(codes, auction.ACCEPT, True, (auction.START,))
    else:
        found = auction.rows_trace(codes, auction.ACCEPT if last else _sink(exits), bool(last), tuple(auction.STATES))
    return [f and f[0] for f in found], [f[1] if f else -1 for f in found]


def _map_of(maps: list[list[int]]) -> tuple:
    """The exit state of several stretches after one another, by entry state."""
    out = []
    for state in auction.STATES:
        for step in maps:
            state = step[state] if state >= 0 else -1
        out.append(state)
    return (out,)


def _entries(maps: list[list[int]], entry: int | None) -> tuple:
    state, out = auction.START if entry is None else entry, []
    for step in maps:
        out.append(state)
        state = step[state]
    return (out,)


def _edits(codes: str, letters: list[str | None], entry: int | None) -> tuple:
    """The block's letters, their cost, and each edit: row, order at that row, letter, role given."""
    state = auction.START if entry is None else entry
    chosen = letters[state]
    edits, cost = auction.walk(codes, chosen, state)
    rows, names, roles = [e[0] for e in edits], [e[1] for e in edits], [ROLES.get(e[2]) if e[1] in "RI" else None for e in edits]
    return chosen, cost, rows, names, roles


class ConversationRepair:
    """Faults of conversations, the cheapest edits that mend their structure, and the mended rows."""

    def __init__(self, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conv, self.turn, self.role, self.text = conv, turn, role, text

    def apply(self, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(report, repaired)``.

        report, one row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.
        repaired, the rows left and inserted: conv, at, place (order: at, then place), edit (K, R or I), role, text.
        """
        scratch = Scratch(turns.sparkSession, "repair")
        one_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
        rows = turns.select(
            F.col(self.conv).alias("conv"), F.col(self.turn).alias("turn"), one_space(self.role).alias("role"), one_space(self.text).alias("text"),
            F.monotonically_increasing_id().alias("tie"),
        )
        order = [F.col("conv"), F.col("turn"), F.col("role"), F.substring("text", 1, 100), F.xxhash64("text"), F.col("tie")]
        rows = numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie"), scratch, "rows", "at")
        blocks = scratch.put(self._blocks(rows), "blocks")
        plans = scratch.put(self._plans(blocks, scratch), "plans")
        return self._report(plans), self._repaired(rows, plans)

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """conv, block, first, codes, and the faults and turns of each block."""
        trimmed = F.btrim("text", F.lit(BLANKS))
        blank = trimmed == ""
        open_end = ~F.right(trimmed, F.lit(1)).isin(*ENDS)
        firsts = rows.filter(~blank).groupBy("conv", "role", F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("at").alias("seen")).select("seen")
        initial = F.substring("role", 1, 1)
        place = F.when(F.col("role") == "", 4).otherwise(3)
        for i, name in enumerate(auction.INITIALS):
            place = F.when(initial == name, i).otherwise(place)
        lean = rows.select("conv", "turn", "at", place.alias("initial"), blank.alias("blank"), open_end.alias("open"))
        told = lean.join(firsts, F.col("at") == F.col("seen"), "left")
        again = ~F.col("blank") & F.col("seen").isNull()
        truncated = ~F.col("blank") & F.col("seen").isNotNull() & F.col("open")
        fault = F.when(F.col("blank") | again, 2).when(truncated, 1).otherwise(0)
        told = told.select(
            "conv", F.shiftright("at", BLOCK_BITS).alias("block"), "at", "turn", "initial", F.char(65 + 3 * F.col("initial") + fault).alias("code"),
            F.col("blank").cast("long").alias("blank"), again.cast("long").alias("duplicate"), truncated.cast("long").alias("truncated"),
        )
        grouped = told.groupBy("conv", "block").agg(
            _in_order("at", "turn", "initial", "code").alias("r"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))
        )
        pairs = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda x, y: _illegal(x["initial"], y["initial"]))
        turns_of = F.filter(F.transform("r", lambda x: x["turn"]), lambda x: x.isNotNull())
        return grouped.select(
            "conv", "block", F.col("r")[0]["at"].alias("first"), F.array_join(F.transform("r", lambda x: x["code"]), "").alias("codes"),
            "blank", "duplicate", "truncated", F.when(F.size("r") > 1, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0).alias("illegal"),
            F.size(F.array_distinct(turns_of)).cast("long").alias("turns"), F.get(turns_of, F.lit(0)).alias("low"), F.element_at("r", -1)["turn"].alias("high"),
            F.col("r")[0]["initial"].alias("head"), F.element_at("r", -1)["initial"].alias("tail"),
        )

    def _plans(self, blocks: DataFrame, scratch: Scratch) -> DataFrame:
        """The blocks with their letters, cost and edits."""
        counts = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        units = scratch.put(_mapped(joined(blocks, counts, ["conv"], "left_semi"), ["conv", "block"], ["codes"], _matrix, "matrix array<long>"), "matrices")
        most = units.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most is None:  # every conversation lies in one block
            traced = _mapped(blocks.withColumns({"exits": F.lit(None).cast("array<long>"), "last": F.lit(None).cast("boolean")}), list(blocks.columns), ["codes", "exits", "last"], _traces, "letters array<string>, leads array<int>")
            return self._edited(traced.withColumn("entry", F.lit(None).cast("int")))
        levels = [units]
        while most > 1 << FAN_BITS:
            levels.append(scratch.put(self._above(levels[-1], "matrix", _matrix_of, "matrix array<long>"), "matrices"))
            most = levels[-1].groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        exits = self._below(levels[-1], None, "matrix", _exits, "exits", 4)
        for level in levels[-2::-1]:
            exits = self._below(level, scratch.put(exits, "exits"), "matrix", _exits, "exits", 4)
        exits = scratch.put(exits.select("conv", "block", "exits", "last"), "exits")
        traced = _mapped(joined(blocks, exits, ["conv", "block"], "left"), list(blocks.columns), ["codes", "exits", "last"], _traces, "letters array<string>, leads array<int>")
        traced = scratch.put(traced, "traces")
        maps = [joined(traced.select("conv", "block", "leads"), counts, ["conv"], "left_semi")]
        for _ in levels[1:]:
            maps.append(scratch.put(self._above(maps[-1], "leads", _map_of, "leads array<int>"), "maps"))
        entries = self._below(maps[-1], None, "leads", _entries, "entry", 1)
        for level in maps[-2::-1]:
            entries = self._below(level, scratch.put(entries, "entries"), "leads", _entries, "entry", 1)
        return self._edited(joined(traced, entries.select("conv", "block", "entry"), ["conv", "block"], "left"))

    @staticmethod
    def _above(units: DataFrame, column: str, make: Callable, schema: str) -> DataFrame:
        """Stretches of up to 2 ** FAN_BITS units as one unit each."""
        groups = units.groupBy("conv", F.shiftright("block", FAN_BITS).alias("above")).agg(_in_order("block", column).alias("r"))
        listed = groups.select("conv", F.col("above").alias("block"), F.transform("r", lambda x: x[column]).alias("parts"))
        return _mapped(listed, ["conv", "block"], ["parts"], make, schema)

    @staticmethod
    def _below(units: DataFrame, given: DataFrame | None, column: str, make: Callable, out: str, width: int) -> DataFrame:
        """What ``make`` tells each unit, from what the units above were given; None at the top, where a conversation's units are one group."""
        above = F.lit(0).cast("long") if given is None else F.shiftright("block", FAN_BITS)
        groups = units.groupBy("conv", above.alias("above")).agg(_in_order("block", column).alias("r"))
        kind = "array<long>" if width > 1 else "int"
        if given is None:
            groups = groups.withColumns({out: F.lit(None).cast(kind), "last": F.lit(True)})
        else:
            told = given.withColumnRenamed("block", "above")
            groups = joined(groups, told if "last" in told.columns else told.withColumn("last", F.lit(False)), ["conv", "above"])
        listed = groups.select("conv", "last", F.transform("r", lambda x: x["block"]).alias("blocks"), F.transform("r", lambda x: x[column]).alias("parts"), F.col(out).alias("given"))
        if width > 1:  # the last stretch of a conversation ends where it ends
            listed = listed.withColumn("given", F.when(~F.col("last"), F.col("given")))
        made = _mapped(listed, ["conv", "last", "blocks"], ["parts", "given"], make, f"told array<{'long' if width > 1 else 'int'}>")
        each = made.select("conv", "last", "told", F.size("blocks").alias("n"), F.posexplode("blocks").alias("i", "block"))
        value = F.slice("told", F.col("i") * width + 1, F.lit(width)) if width > 1 else F.get("told", F.col("i"))
        return each.select("conv", "block", value.alias(out), (F.col("last") & (F.col("i") + 1 == F.col("n"))).alias("last"))

    @staticmethod
    def _edited(traced: DataFrame) -> DataFrame:
        keys = [c for c in traced.columns if c not in ("codes", "letters", "leads", "entry")]
        return _mapped(traced, keys, ["codes", "letters", "entry"], _edits, "chosen string, cost long, rows array<int>, edits array<string>, roles array<string>")

    @staticmethod
    def _report(plans: DataFrame) -> DataFrame:
        """Blocks of a conversation put together; an audit is as long as its conversation."""
        added = ("blank", "duplicate", "truncated", "cost", "illegal", "turns")
        conv = plans.groupBy("conv").agg(
            *(F.sum(c).alias(c) for c in added), F.min("low").alias("low"), F.max("high").alias("high"),
            _in_order("block", "chosen", "head", "tail", "low", "high").alias("r"),
        )
        met = F.zip_with(
            F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1),
            lambda x, y: F.struct(_illegal(x["tail"], y["head"]).alias("illegal"), F.coalesce(x["high"] == y["low"], F.lit(False)).cast("long").alias("same")),
        )
        over = lambda name: F.when(F.size("r") > 1, F.aggregate(met, F.lit(0).cast("long"), lambda a, x: a + x[name])).otherwise(0)
        missing = F.col("high") - F.col("low") + 1 - (F.col("turns") - over("same"))
        return conv.select(
            "conv", F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + over("illegal")).alias("illegal"),
            "cost", F.array_join(F.transform("r", lambda x: x["chosen"]), "").alias("audit"),
        )

    @staticmethod
    def _repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
        edits = plans.select("conv", "first", F.posexplode(F.arrays_zip("rows", "edits", "roles")).alias("place", "e")).select(
            "conv", (F.col("first") + F.col("e.rows")).alias("at"), "place", F.col("e.edits").alias("edit"), F.col("e.roles").alias("given")
        )
        inserted = edits.filter("edit = 'I'").select("conv", "at", "place", "edit", F.col("given").alias("role"), F.lit("").alias("text"))
        left = edits.filter("edit in ('K', 'R')").select(F.col("at").alias("own"), "place", "edit", "given")
        kept = rows.join(left, F.col("at") == F.col("own")).select("conv", "at", "place", "edit", F.coalesce("given", "role").alias("role"), "text")
        return kept.unionByName(inserted)


def _illegal(one: Column, two: Column) -> Column:
    """1 where neighbours' initials aren't su, ua or au."""
    pair = one * 5 + two
    return F.when(pair.isin(0 * 5 + 1, 1 * 5 + 2, 2 * 5 + 1), 0).otherwise(1).cast("long")


def digests(repaired: DataFrame) -> DataFrame:
    """conv, sha256: lowercase hex of the repaired rows, ``role:text`` each, joined by line feeds.

    Rows stream through in order; a digest is one pass over its conversation by nature, so the rows of
    one conversation meet in one task, sorted and spilled, and are never held together.
    """
    kind = repaired.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, conv_kind = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own[0]], conv_kind), pa.array([state.hexdigest()])], ["conv", "sha256"])

        for batch in batches:
            conv_kind = batch.column(0).type
            for conv, role, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                key = (conv.as_py(),)
                if key != own:
                    if own is not None:
                        yield done()
                    own, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(role.as_py().encode() + b":" + text.as_py().encode())
        if own is not None:
            yield done()

    dealt = repaired.repartition("conv").sortWithinPartitions("conv", "at", "place").select("conv", "role", "text")
    return dealt.mapInArrow(run, f"conv {kind}, sha256 string")
