"""Published figures that must come out again."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import binomial as bn
from sluice.functions.rates import with_rates
from sluice.operators import policy as po


@pytest.mark.parametrize(
    "counts, expected",
    [
        ((2094, 83, 261, 562), (0.885, 0.871, 0.683, 0.962, 0.766)),
        ((962, 38, 346, 654), (0.808, 0.945, 0.654, 0.962, 0.773)),
        ((0, 0, 103, 897), (0.897, 1.0, 0.897, 0.0, 0.946)),
        ((333, 6, 0, 0), (0.982, 0.0, 0.0, 0.982, 0.0)),
    ],
)
def test_rates_from_counts(spark, counts, expected):
    df = spark.createDataFrame([counts], "tn bigint, fp bigint, fn bigint, tp bigint")
    row = with_rates(df).first()
    got = tuple(round(row[c], 3) for c in ("accuracy", "precision", "recall", "specificity", "f1"))
    assert got == expected


def test_balanced_accuracy_of_one_class(spark):
    rows = [(0, 0, 103, 897), (333, 6, 0, 0)]
    df = with_rates(spark.createDataFrame(rows, "tn bigint, fp bigint, fn bigint, tp bigint"))
    got = {r["tn"]: r["balanced_accuracy"] for r in df.collect()}
    assert got[0] == pytest.approx(0.897)
    assert got[333] == pytest.approx(333 / 339)


@pytest.mark.parametrize(
    "k, n, bound",
    [
        (6, 2560, 0.004620658453207529),
        (17, 2560, 0.0099440949912433),
        (2, 1273, 0.004937297192660461),
        (2, 1287, 0.004883678864149062),
    ],
)
def test_exact_upper_bound(k, n, bound):
    assert bn.upper_bound(k, n, 0.05) == pytest.approx(bound, rel=1e-11)


def test_upper_bound_edges():
    assert bn.upper_bound(0, 0, 0.05) == 1.0
    assert bn.upper_bound(5, 5, 0.05) == 1.0
    assert bn.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-12)


def test_binomial_cdf_against_sums():
    from math import comb

    for n, p in ((7, 0.3), (40, 0.02), (200, 0.5)):
        total = 0.0
        for k in range(n):
            total += comb(n, k) * p**k * (1 - p) ** (n - k)
            assert bn.binomial_cdf(k, n, p) == pytest.approx(total, abs=1e-12)


def test_allowed_and_needed_counts():
    assert bn.largest_allowed(2560, 0.005, 0.05) == 6
    assert bn.largest_allowed(2560, 0.01, 0.05) == 17
    assert bn.largest_allowed(100, 0.005, 0.05) == -1
    needed = [bn.smallest_sample(k, 0.005, 0.05) for k in (0, 1, 2, 5, 6, 10, 20)]
    assert needed == [598, 947, 1258, 2100, 2366, 3389, 5808]


def test_allowed_count_is_monotone_and_fits_the_bound():
    last = -1
    for n in range(300, 6000, 411):
        k = bn.largest_allowed(n, 0.005, 0.05)
        assert k >= last
        last = k
        if k >= 0:
            assert bn.upper_bound(k, n, 0.05) <= 0.005 < bn.upper_bound(k + 1, n, 0.05)


def test_bounds_of_very_large_counts():
    k = bn.largest_allowed(1_000_000_000, 0.005, 0.05)
    assert 4_990_000 < k < 5_000_000
    assert bn.upper_bound(k, 1_000_000_000, 0.05) <= 0.005


def test_audit_exposure(spark):
    rows = [("a", 20, 0.239, 0.0, False), ("b", 100, 0.2, 0.0, False), ("c", 200, 0.2, 0.0, True), ("d", 0, 0.2, 0.0, False)]
    schema = "stream string, adaptive_bypass_count int, naive_reduction double, failsafe_reduction double, shift_detected boolean"
    out = po.audit_exposure(spark.createDataFrame(rows, schema)).collect()
    got = {(r["stream"], r["audit_rate"]): r for r in out}
    shown = [round(100 * got[s, r]["exposure_probability"], 1) for s in "abc" for r in (0.01, 0.05, 0.1)]
    assert shown == [18.2, 64.2, 87.8, 63.4, 99.4, 100.0, 86.6, 100.0, 100.0]
    assert round(100 * got["a", 0.05]["final_reduction"], 1) == 22.7
    assert got["c", 0.05]["final_reduction"] == 0.0
    assert not any(r["stream"] == "d" for r in out)


def test_wilson_interval(spark):
    df = spark.createDataFrame([(0, 0), (0, 50), (1, 823), (50, 50)], "k bigint, n bigint")
    low, high = bn.wilson(F.col("k"), F.col("n"))
    rows = df.select("k", "n", low.alias("low"), high.alias("high")).collect()
    assert (rows[0]["low"], rows[0]["high"]) == (0.0, 0.0)
    assert rows[1]["low"] == pytest.approx(0.0, abs=1e-12) and rows[1]["high"] == pytest.approx(0.0713, abs=1e-3)
    assert rows[2]["low"] < 1 / 823 < rows[2]["high"]
    assert rows[3]["high"] == pytest.approx(1.0)
