"""Running sums, ranks and exact quantiles without a single-task sort.

A window ordered over a whole table (or over one hot key) runs in one task.  Here the
rows are cut into sort ranges first:

1. split points come from rows whose hash falls below a limit set by the row count, so
   every evaluation of the plan cuts at the same places;
2. each row finds its range by binary search over the split points;
3. running sums are taken inside (range, group), which no hot group can outgrow;
4. one small table (at most two rows per range) carries the sums over range borders.

Rows are in (group, order) sequence, so a group that reaches into several ranges is the
first or the last one of each.  That bounds the broadcast border table by twice the number
of ranges, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.session import range_count

HASH_SPAN = 1 << 31
PER_SPLIT = 8


def _split_points(df: DataFrame, key: Column, measures: Sequence[str], ranges: int) -> Column:
    """A sorted array of about ``ranges`` keys, as a scalar.

    Every ``PER_SPLIT``-th sampled key becomes a split point, which evens out the ranges.
    Both branches use all columns of the main plan, so they share its shuffle.
    """
    widest = F.max(F.struct(key, *measures)).alias("widest")
    size = df.agg(F.struct(F.count(F.lit(1)).alias("rows"), widest).alias("s")).scalar()
    limit = F.lit(float(HASH_SPAN * ranges * PER_SPLIT)) / size.getField("rows")
    picked = df.filter(F.pmod(F.xxhash64(key, *measures), F.lit(HASH_SPAN)) < limit)
    sample = F.array_sort(F.collect_list(key))
    return picked.agg(F.filter(sample, lambda x, i: i % PER_SPLIT == PER_SPLIT - 1).alias("p")).scalar()


def with_range(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Add ``_range``: the index of the sort range of each row over ``keys``."""
    ranges = ranges or range_count(df.sparkSession)
    key = F.struct(*keys)
    # The number of points scatters around the target; twice the target is never reached
    # in practice, and points beyond the search depth would only leave the last range wide.
    steps = (2 * ranges + 16).bit_length()
    search = [_split_points(df, key, measures, ranges).alias("_points"), F.lit(0).alias("_at0")]
    for i in range(steps):
        step = 1 << (steps - 1 - i)
        at = F.col(f"_at{i}")
        probe = F.get(F.col("_points"), at + (step - 1))
        search.append(F.when(probe <= key, at + step).otherwise(at).alias(f"_at{i + 1}"))
    return df.select("*", *search).select(*df.columns, F.col(f"_at{steps}").alias("_range"))


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    measures: Sequence[str],
    groups: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Append ``cum_<m>`` (inclusive, ascending) and ``total_<m>`` of each measure per group.

    ``(groups, order)`` must identify a row.  Rows with a null group are a group of their own;
    order values must not be null.
    """
    columns = df.columns
    groups = list(groups) or ["_all"]
    base = df if groups != ["_all"] else df.withColumn("_all", F.lit(0))
    base = with_range(base, [*groups, *order], measures, ranges)
    cell = ["_range", *groups]

    sums, group = F.struct(*measures), F.struct(*groups)
    cells = base.groupBy(*cell).agg(*[F.sum(m).alias(m) for m in measures])
    edges = cells.groupBy("_range").agg(
        F.min(F.struct(group.alias("g"), sums.alias("s"))).alias("first"),
        F.max(F.struct(group.alias("g"), sums.alias("s"))).alias("last"),
    )
    edges = edges.select("_range", F.explode(F.array_distinct(F.array("first", "last"))).alias("_e"))
    of_group = Window.partitionBy("_e.g")
    earlier = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    border = edges.select(
        "_range",
        *[F.col(f"_e.g.{g}").alias(g) for g in groups],
        *[F.coalesce(F.sum(f"_e.s.{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_e.s.{m}").over(of_group).alias(f"_whole_{m}") for m in measures],
    )
    of_cell = Window.partitionBy(*cell)
    upto = of_cell.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    border = border.withColumnsRenamed({c: f"_border_{c}" for c in cell})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_border_{c}")) for c in cell])
    joined = base.join(F.broadcast(border), same, "left")
    return joined.select(
        *columns,
        *[(F.sum(m).over(upto) + F.coalesce(f"_before_{m}", F.lit(0))).alias(f"cum_{m}") for m in measures],
        *[F.coalesce(f"_whole_{m}", F.sum(m).over(of_cell)).alias(f"total_{m}") for m in measures],
    )


def ranked(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Append the 1-based position of each row in its group; ``order`` must be unique in a group."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    counted = running_sums(one, order, ["_one"], groups)
    return counted.drop("_one", "total__one").withColumnRenamed("cum__one", name)


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value: the pre-aggregation that all order statistics start from."""
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), name: str = "quantiles"
) -> DataFrame:
    """Linear-interpolated quantiles per group as one array column, plus the row count ``n``.

    The built-in exact percentile keeps every distinct value of a group in one task; this
    reads the two neighbouring order statistics off distributed running counts instead.
    """
    return counted_quantiles(value_counts(df, value, groups), value, probs, groups, name)


def counted_quantiles(
    counts: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), name: str = "quantiles"
) -> DataFrame:
    """``exact_quantiles`` of rows that are counted already: one row per group and distinct value, with ``n``."""
    rows = running_sums(counts, [value], ["n"], groups)
    v = F.col(value).cast("double")

    def at(p: float, total: str) -> Column:
        return F.lit(float(p)) * (F.col(total) - 1)

    aggs = []
    for i, p in enumerate(probs):
        spot = at(p, "total_n")
        aggs.append(F.min(F.when(F.col("cum_n") > F.floor(spot), v)).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("cum_n") > F.ceil(spot), v)).alias(f"_hi{i}"))
    picked = rows.groupBy(*groups).agg(F.max("total_n").alias("n"), *aggs)
    parts = []
    for i, p in enumerate(probs):
        lo, hi, spot = F.col(f"_lo{i}"), F.col(f"_hi{i}"), at(p, "n")
        parts.append(lo + (hi - lo) * (spot - F.floor(spot)))
    return picked.select(*groups, "n", F.array(*parts).alias(name))
