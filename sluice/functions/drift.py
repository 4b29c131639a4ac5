"""Closed forms used by the shift monitor."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARE_FLOOR = 1e-6
TERMS = 12


def psi_term(reference_share: Column, current_share: Column) -> Column:
    """One bin's contribution to the population stability index."""
    r = F.greatest(reference_share, F.lit(SHARE_FLOOR))
    c = F.greatest(current_share, F.lit(SHARE_FLOOR))
    return (c - r) * F.log(c / r)


def ks_pvalue(statistic: Column, n1: Column, n2: Column) -> Column:
    """Two-sided asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic.

    Two series of the same limit distribution: one converges fast for small arguments,
    the other for large ones, so a dozen terms of each are exact to double precision.
    """
    n = n1.cast("double") * n2.cast("double") / (n1 + n2).cast("double")
    x = F.sqrt(n) * statistic
    safe = F.greatest(x, F.lit(0.05))
    small_sum = reduce(
        lambda a, b: a + b,
        [F.exp(-((2 * j - 1) ** 2) * math.pi**2 / (8.0 * safe * safe)) for j in range(1, TERMS + 1)],
    )
    large_sum = reduce(
        lambda a, b: a + b,
        [F.lit(float((-1) ** (j - 1))) * F.exp(-2.0 * j * j * safe * safe) for j in range(1, TERMS + 1)],
    )
    small = 1.0 - math.sqrt(2.0 * math.pi) / safe * small_sum
    p = F.when(x < 0.05, 1.0).when(x < 1.18, small).otherwise(2.0 * large_sum)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def trigger_columns(
    psi: Column, ks_p: Column, keyword_diff: Column, psi_limit: Column, ks_limit: Column, keyword_limit: Column
) -> dict[str, Column]:
    return {
        "psi_trigger": psi >= psi_limit,
        "ks_trigger": ks_p < ks_limit,
        "keyword_trigger": F.abs(keyword_diff) >= keyword_limit,
    }


def trigger_codes(psi: Column, ks: Column, keyword: Column) -> Column:
    """Active triggers as short codes, e.g. ``PSI,KW``; ``--`` when none fired."""
    codes = F.array_compact(
        F.array(F.when(psi, F.lit("PSI")), F.when(ks, F.lit("KS")), F.when(keyword, F.lit("KW")))
    )
    return F.when(F.size(codes) == 0, F.lit("--")).otherwise(F.array_join(codes, ","))
