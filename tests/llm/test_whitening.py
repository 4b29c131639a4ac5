"""Whitening against NumPy on the whole table."""

import math
from collections import defaultdict

import numpy as np
import pytest

from sluice.llm import whitening
from sluice.llm.whitening import Whitening

SCHEMA = "vec_id long, embedding array<float>, label int, at long, x string, fit string"


def expected(vectors, components=16):
    """Per usable vector: deviation and whitened values up to sign; and n, explained."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in vectors.items()}
    fit = [list(v) for v in dict.fromkeys(tuple(v) for v in x.values())]
    n, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    white = {i: np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)]) @ axes / np.sqrt(values) for i, v in x.items()}
    return n, deviation, white, values / np.trace(centred.T @ centred / n)


def usable_rows(rng, n, d):
    rows = {i: [float(c) for c in rng.normal(0, 2, d) * np.linspace(1, 3, d)] for i in range(n)}
    for i in range(n, n + n // 2):  # a third of all rows are one vector
        rows[i] = rows[0]
    return rows


@pytest.mark.parametrize("d, block, columns", [(20, None, 1 << 10), (20, 16, 8), (5, 1 << 10, 4)])
def test_against_numpy(spark, monkeypatch, d, block, columns):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", columns)
    monkeypatch.setattr(whitening, "GROUP", 3)
    vectors = usable_rows(np.random.default_rng(d), 150, d)
    bad = [(900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] + [0.0] * (d - 1)), (903, [float("inf")] * d), (904, []), (905, [1.0] * (d + 1))]
    rows = [(i, v, 1, 7, "x", "y") for i, v in [*vectors.items(), *bad]]
    got = defaultdict(list)
    for r in Whitening(block_rows=block).apply(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        got[r.vec_id].append(r)
    n, deviation, white, explained = expected(vectors)
    assert set(got) == set(vectors)
    k = min(16, d)
    signs = None
    for i, found in got.items():
        found.sort(key=lambda r: r.component)
        assert [r.component for r in found] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in found} == {(n, deviation[i])}
        assert np.allclose([r.explained for r in found], explained, rtol=1e-9)
        values = np.array([r.whitened for r in found])
        signs = np.sign(values * white[i]) if signs is None else signs
        assert signs.all() and np.allclose(values, signs * white[i], atol=1e-7)
        assert all(r.identity_error < 1e-9 for r in found)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert Whitening().apply(make([])).collect() == []
    assert Whitening().apply(make([("a", None), ("b", [])])).collect() == []
    alone = Whitening().apply(make([("a", [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert sorted((r.component, r.n, r.deviation, r.whitened, r.explained) for r in alone) == [(1, 1, 0, None, None)] * 2 + [(2, 1, 0, None, None)] * 2
    line = Whitening().apply(make([("a", [1.0, 5.0]), ("b", [2.0, 5.0]), ("c", [3.0, 5.0])])).orderBy("component", "vec_id").collect()
    assert [r.whitened for r in line[3:]] == [None] * 3 and [r.explained for r in line] == [1.0] * 3 + [0.0] * 3
    assert np.allclose([abs(r.whitened) for r in line[:3]], [1.5**0.5, 0, 1.5**0.5])
    huge = Whitening().apply(make([("a", [1e300, 1.0]), ("b", [-1e300, 2.0])])).collect()
    assert len(huge) == 4 and huge[0].deviation is None
