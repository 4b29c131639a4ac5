"""Exact binomial bounds for false-bypass counts.

The bounds are applied to *aggregated* rows (one per policy, stream or split), so the
inversion of the binomial tail runs as an Arrow-batched function on a handful of
numbers.  The tail is the regularised incomplete beta function, evaluated with a
continued fraction; its cost grows with the square root of the counts, not with them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType

from sluice.functions import lexicons as lx


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 200 + int(10 * math.sqrt(max(a, b)))):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return 1.0 - beta_cdf(k + 1.0, float(n - k), p)


def upper_bound(k: int, n: int, alpha: float) -> float:
    """One-sided Clopper-Pearson upper bound; 1 when nothing was observed to pass."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = 0.5 * (low + high)
        if binomial_cdf(k, n, mid) > alpha:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def largest_allowed(n: int, epsilon: float, alpha: float) -> int:
    """Largest k whose upper bound stays within epsilon; -1 when even k = 0 fails.

    ``upper_bound(k, n) <= eps`` says the same as ``P(X <= k | n, eps) <= alpha``, which is
    monotone in k, so bisection on k replaces both the inversion and the search.
    """
    if n <= 0 or binomial_cdf(0, n, epsilon) > alpha:
        return -1
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if mid < n and binomial_cdf(mid, n, epsilon) <= alpha:
            low = mid
        else:
            high = mid
    return low


def smallest_sample(k: int, epsilon: float, alpha: float, limit: int = 1 << 40) -> int | None:
    """Fewest positives for which k false bypasses are still within epsilon."""
    high = max(1, k + 1)
    while binomial_cdf(k, high, epsilon) > alpha:
        high *= 2
        if high > limit:
            return None
    low = max(k, high // 2)
    while high - low > 1:
        mid = (low + high) // 2
        if binomial_cdf(k, mid, epsilon) <= alpha:
            high = mid
        else:
            low = mid
    return high


@pandas_udf(DoubleType())
def _upper_bound(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([upper_bound(int(a), int(b), float(c)) for a, b, c in zip(k, n, alpha)])


@pandas_udf(LongType())
def _largest_allowed(n: pd.Series, epsilon: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([largest_allowed(int(a), float(b), float(c)) for a, b, c in zip(n, epsilon, alpha)])


@pandas_udf(LongType())
def _smallest_sample(k: pd.Series, epsilon: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series(
        [smallest_sample(int(a), float(b), float(c)) for a, b, c in zip(k, epsilon, alpha)], dtype="Int64"
    )


@pandas_udf(DoubleType())
def _just_below(x: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(dtype=float), -np.inf))


def _num(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def cp_upper(k: Column, n: Column, alpha: Column | float = 0.05) -> Column:
    return _upper_bound(k.cast("bigint"), n.cast("bigint"), _num(alpha))


def max_allowed(n: Column, epsilon: Column | float, alpha: Column | float = 0.05) -> Column:
    return _largest_allowed(n.cast("bigint"), _num(epsilon), _num(alpha))


def min_positives(k: Column, epsilon: Column | float, alpha: Column | float = 0.05) -> Column:
    return _smallest_sample(k.cast("bigint"), _num(epsilon), _num(alpha))


def just_below(x: Column) -> Column:
    """The next representable double below x (null stays null)."""
    return _just_below(x.cast("double"))


def wilson(k: Column, n: Column, z: float = lx.NORMAL_95) -> tuple[Column, Column]:
    """Wilson score interval, (0, 0) when n is 0."""
    kd, nd = k.cast("double"), F.greatest(n, F.lit(1)).cast("double")
    z2 = z * z
    p = kd / nd
    scale = 1.0 + z2 / nd
    centre = (p + z2 / (2.0 * nd)) / scale
    half = z * F.sqrt(p * (1.0 - p) / nd + z2 / (4.0 * nd * nd)) / scale
    empty = n == 0
    low = F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


def exposure(rate: Column, n: Column) -> Column:
    """Chance that at least one of n bypassed rows is audited."""
    return 1.0 - F.pow(1.0 - rate, n)
