"""Random counts from uniform numbers, by inverting a distribution: plain columns, no rows per draw.

The chances of neighbouring counts differ by a simple ratio, so a walk over the counts within twelve
standard deviations of the mean (and 30 more) adds them up from one end, and the draw is the first count
whose sum reaches the uniform number's share.  What lies outside is below 1e-30 of the whole.  A draw of
n costs the root of n steps, whatever the rows that n stands for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REACH, MORE = 12, 30


def _inverted(u: Column, low: Column, high: Column, ratio: Callable[[Column], Column]) -> Column:
    """The first k in low .. high whose running sum of weights reaches u of all; ratio(k) is weight k + 1 over weight k."""
    steps, one, none = F.sequence(low, high), F.lit(1.0), F.lit(0.0)
    total = F.aggregate(
        steps, F.struct(one.alias("w"), none.alias("sum")),
        lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"],
    )

    def step(s: Column, k: Column) -> Column:
        reached = s["sum"] + s["w"]
        at = F.when(reached < s["goal"], k + 1).otherwise(s["at"])
        return F.struct((s["w"] * ratio(k)).alias("w"), reached.alias("sum"), s["goal"].alias("goal"), at.alias("at"))

    start = F.struct(one.alias("w"), none.alias("sum"), (u * total).alias("goal"), low.alias("at"))
    return F.least(F.aggregate(steps, start, step, lambda s: s["at"]), high)


def _reach(mean: Column, variance: Column) -> Column:
    return REACH * F.sqrt(variance) + MORE


def binomial_draw(u: Column, n: Column, p: Column) -> Column:
    """A number of hits in n trials of chance p (bigint); a chance outside 0 .. 1 counts as the nearer end."""
    n, mean = n.cast("bigint"), n * p
    reach = _reach(mean, mean * (1 - p))
    low = F.greatest(F.lit(0).cast("bigint"), F.floor(mean - reach))
    high = F.least(n, F.ceil(mean + reach))
    odds = p / (1 - p)
    drawn = _inverted(u, low, high, lambda k: (n - k) / (k + 1) * odds)
    return F.when((p <= 0) | (n <= 0), F.lit(0).cast("bigint")).when(p >= 1, n).otherwise(drawn)


def poisson_draw(u: Column, mean: Column) -> Column:
    """A Poisson count (bigint); a mean of 0 or less gives 0."""
    mean = mean.cast("double")
    reach = _reach(mean, mean)
    low = F.greatest(F.lit(0).cast("bigint"), F.floor(mean - reach))
    drawn = _inverted(u, low, F.ceil(mean + reach), lambda k: mean / (k + 1))
    return F.when(mean <= 0, F.lit(0).cast("bigint")).otherwise(drawn)
