"""Seeded, repeatable sampling: the rows with the smallest salted hash win.

A sample size that grows with the table (a mixing rate, half of a class) must not go
through ``orderBy(...).limit(n)``, which ends in one task.  Instead one pass writes every
row's place in the random order, a narrow table.  Counts per leading digits of the order
tell in which cell each sample ends, and only these cells (about a millionth of the rows
each) are ranked.  That gives a limit for every group and every size at once, and the
second pass keeps the rows up to it.  All samples of one seed share the order, so smaller
ones lie inside larger ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.hashing import hash_cell, sample_order
from sluice.operators.prefix import ranked
from sluice.session import join_small, stored

Size = int | Column | Callable[[Column], Column]


def _wanted(size: Size, total: Column) -> Column:
    if callable(size) and not isinstance(size, Column):
        size = size(total)
    elif isinstance(size, int):
        size = F.lit(size)
    return F.least(size.cast("bigint"), total)


def order_limits(orders: DataFrame, sizes: dict[str, Size], groups: Sequence[str] = (), order: str = "_order") -> DataFrame:
    """(groups, size, limit): the order of the last row in each group's sample of each size; no row where a sample is empty.

    ``orders`` is read twice, so it should be a written table of groups and order alone.
    """
    groups = list(groups)
    keyed = orders.select(*groups, order, hash_cell(F.col(order)).alias("_cell"))
    counts = keyed.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy(*groups)
    upto = of_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(of_group)})
    wanted = F.array(*(F.struct(F.lit(name).alias("size"), _wanted(size, F.col("_total")).alias("want")) for name, size in sizes.items()))
    edges = (
        sums.withColumn("_w", F.explode(wanted))
        .filter((F.col("_upto") - F.col("_n") < F.col("_w.want")) & (F.col("_w.want") <= F.col("_upto")))
        .select(*groups, "_cell", F.col("_w.size").alias("size"), (F.col("_w.want") - (F.col("_upto") - F.col("_n"))).alias("_room"))
    )
    place = F.row_number().over(Window.partitionBy(*groups, "size").orderBy(order))
    last = keyed.join(edges, [*groups, "_cell"]).withColumn("_place", place).filter(F.col("_place") == F.col("_room"))
    return last.select(*groups, "size", F.col(order).alias("limit"))


def hash_sample(
    df: DataFrame, size: Size, seed: int | str, groups: Sequence[str] = (), id_col: str = "sample_id"
) -> DataFrame:
    """Exactly ``min(size, rows)`` rows per group; rows that share the id at the end of a sample come together.

    ``size`` is a number, a column without references, or a function of the group's row count.  Rows of
    a null group are in no sample.
    """
    groups = list(groups)
    order = sample_order(F.col(id_col), seed).alias("_order")
    limits = order_limits(stored(df.select(*groups, order), "orders"), {"one": size}, groups).select(*groups, "limit")
    ordered = df.select("*", order)
    if groups:
        kept = join_small(ordered, limits, groups)
    else:
        kept = ordered.withColumn("limit", limits.select("limit").scalar())
    return kept.filter(F.col("_order") <= F.col("limit")).select(*df.columns)


def balanced_sample(
    df: DataFrame, size: int, seed: int | str, label: str = "label", id_col: str = "sample_id"
) -> DataFrame:
    """Half of ``size`` per class; what a small class lacks is topped up from all the rest.

    Both draws come from one narrow table: the halves by their limits, the rest by a second order
    among the rows beyond these.
    """
    draws = {"_one": sample_order(F.col(id_col), f"{seed}:class"), "_two": sample_order(F.col(id_col), f"{seed}:rest")}
    orders = stored(df.select(label, *(c.alias(n) for n, c in draws.items())), "orders")
    halves = stored(order_limits(orders, {"half": size // 2}, [label], "_one").select(label, "limit"), "halves")
    inside = F.coalesce(F.col("_one") <= F.col("limit"), F.lit(False))
    told = orders.join(halves, label, "left")
    missing = told.agg((F.lit(size) - F.count_if(inside)).alias("m")).scalar()
    rest = order_limits(told.filter(~inside).select("_two"), {"rest": missing}, (), "_two").select("limit").scalar()
    every = df.select("*", *(c.alias(n) for n, c in draws.items()), rest.alias("_rest")).join(halves, label, "left")
    return every.filter(inside | (F.col("_two") <= F.col("_rest"))).select(*df.columns)


def shuffled(df: DataFrame, seed: int | str, id_col: str = "sample_id") -> DataFrame:
    """Append a 0-based ``position`` in a seeded random order."""
    keyed = df.withColumn("_order", sample_order(F.col(id_col), seed))
    placed = ranked(keyed, ["_order"], name="position")
    return placed.withColumn("position", F.col("position") - 1).drop("_order")


def mix_streams(
    base: DataFrame,
    foreign: DataFrame,
    rates: float | Sequence[float],
    seed: int | str,
    names: tuple[str, str] = ("id", "ood"),
    id_col: str = "sample_id",
) -> DataFrame:
    """Replace ``round(n * rate)`` rows of ``base`` by as many rows of ``foreign``, for every rate.

    Rounding is half to even.  ``component`` tells where a row came from.  All rates share one order of
    the base and one of the foreign rows, so each is read once for the limits and once for the rows.
    """
    rates = [float(r) for r in ([rates] if isinstance(rates, int | float) else rates)]
    total = base.agg(F.count(F.lit(1)).alias("n")).scalar()

    def taken(n: Column, rate: float) -> Column:
        return F.bround(n * F.lit(rate)).cast("bigint")

    def part(df: DataFrame, name: str, tag: str, sizes: dict[str, Size]) -> DataFrame:
        order = sample_order(F.col(id_col), f"{seed}:{tag}").alias("_order")
        limits = stored(order_limits(stored(df.select(order), "orders"), sizes), "limits")
        by_rate = limits.agg(F.map_from_entries(F.collect_list(F.struct("size", "limit"))).alias("m")).scalar()  # a limit per rate
        each = F.array(*(F.struct(F.lit(r).alias("rate"), F.element_at("_limits", str(r)).alias("limit")) for r in rates))
        met = df.select("*", order, by_rate.alias("_limits")).select(*df.columns, F.explode(F.filter(each, lambda x: F.col("_order") <= x["limit"])).alias("_r"))
        return met.select(*df.columns, F.lit(name).alias("component"), F.col("_r.rate").alias("mixture_rate"))

    kept = part(base, names[0], "base", {str(r): lambda n, r=r: n - taken(n, r) for r in rates})
    added = part(foreign, names[1], "foreign", {str(r): taken(total, r) for r in rates})
    return kept.unionByName(added.select(*kept.columns))


GROUP_LIMIT = 1000


def top_per_group(df: DataFrame, n: int, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First ``n`` rows of each group with their ``place``; ``order`` must be unique in a group.

    Up to the engine's group limit (``spark.sql.optimizer.windowGroupLimitThreshold``, 1000) the row-number
    limit runs before the shuffle, so a hot group sends at most ``n`` rows per input partition.  A larger
    ``n`` is ranked over sort ranges; its order must be plain rising columns.
    """
    if n <= GROUP_LIMIT:
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return df.withColumn("place", place).filter(F.col("place") <= n)
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    return ranked(keyed, names, groups, "place").drop(*names).filter(F.col("place") <= n)


def padded_prompts(df: DataFrame, padding: Column | str, text: str = "prompt") -> DataFrame:
    """Put a given padding text and a blank line before each prompt (gate test fixture)."""
    pad = F.lit(padding) if isinstance(padding, str) else padding
    return df.withColumn(text, F.concat(pad, F.lit("\n\n"), F.col(text)))


def drawn_padding(terms: Sequence[str], n: int, seed: int | str, per_row_id: str | None = None) -> Column:
    """``n`` lexicon terms in a hash-shuffled order, one draw for all rows or one per row."""
    row = F.lit("") if per_row_id is None else F.col(per_row_id).cast("string")
    salted = [
        F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), row, F.lit(f":{t}")), 256).alias("k"), F.lit(t).alias("t"))
        for t in terms
    ]
    chosen = F.slice(F.array_sort(F.array(*salted)), 1, n)
    return F.array_join(F.transform(chosen, lambda x: x["t"]), " ")
