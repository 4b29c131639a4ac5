"""Quality metrics, thresholds, calibration, monitor and gates against plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.functions import draws
from sluice.functions import lexicons as lx
from sluice.functions.hashing import audit_flag
from sluice.operators import calibration as ca
from sluice.operators import gates as ga
from sluice.operators import monitor as mo
from sluice.operators import policy as po
from sluice.operators import quality as qu
from sluice.operators import thresholds as th


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    label = (rng.random(800) < 0.3).astype(int)
    score = np.round(np.clip(rng.normal(0.3 + 0.3 * label, 0.2), 0, 1), 2)
    judge = np.where(rng.random(800) < 0.1, 1 - label, label)
    pdf = pd.DataFrame(
        {"sample_id": [f"s{i}" for i in range(800)], "label": label, "router_score": score, "llm_prediction": judge}
    )
    return pdf, spark.createDataFrame(pdf).withColumns(
        {c: F.col(c).cast("int") for c in ("label", "llm_prediction")}
    )


def curve_of(pdf):
    rows = {}
    for t in sorted(set(np.arange(1001) * 0.001) | set(pdf.router_score)):
        p = pdf.router_score >= t
        tp, fp = int((p & (pdf.label == 1)).sum()), int((p & (pdf.label == 0)).sum())
        fn = int((pdf.label == 1).sum()) - tp
        rows[t] = (tp, fp, fn, int((pdf.router_score <= t).sum()), int(((pdf.router_score <= t) & (pdf.label == 1)).sum()))
    return rows


def test_curve_and_choices(scored):
    pdf, df = scored
    want = curve_of(pdf)
    curve = th.metric_curve(df)
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["bypass_count"], r["false_bypass_count"]) for r in curve.collect()}
    assert got == want

    def f1(t):
        tp, fp, fn, *_ = want[t]
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0

    best = max(want, key=lambda t: (f1(t), want[t][0], -t))
    assert th.best_f1(curve).first()["threshold"] == best
    pos = int((pdf.label == 1).sum())
    assert th.recall_target(curve, 0.99).first()["threshold"] == max(t for t in want if want[t][0] / pos >= 0.99)
    fits = [t for t in want if want[t][4] / pos <= 0.01]
    assert th.safe_bypass(curve, 0.01).first()["threshold"] == max(fits, key=lambda t: (want[t][3], -want[t][4], -t))
    points = {r["policy"]: r["tau"] for r in th.threshold_set(curve).collect()}
    assert len(points) == 7 and points["best_f1"] == best and points["threshold_0_5"] == pytest.approx(0.5)


def test_thresholds_keep_both_comparisons_at_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 1)], "sample_id string, label int, router_score double, llm_prediction int")
    row = th.at_thresholds(df, [0.5]).first()
    assert (row["tp"], row["bypass_count"]) == (1, 1)  # at the threshold: classified and bypassed
    judged = th.at_thresholds(df, [0.5], judge="llm_prediction").first()
    assert (judged["tp"], judged["fn"]) == (0, 1)


def test_sweep_identities(scored):
    _, df = scored
    rows = th.at_thresholds(df, lx.SWEEP_TAUS, judge="llm_prediction").collect()
    assert len(rows) == 8
    last = -1
    for r in sorted(rows, key=lambda r: r["tau"]):
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == r["n"] == 800
        assert r["cost_reduction"] + r["call_rate"] == pytest.approx(1.0)
        assert r["bypass_count"] >= last
        last = r["bypass_count"]


def test_ranking_quality_and_calibration_error(scored):
    pdf, df = scored
    pos, neg = pdf[pdf.label == 1].router_score.to_numpy(), pdf[pdf.label == 0].router_score.to_numpy()
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    row = qu.ranking_quality(df).first()
    assert row["roc_auc"] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted(set(pdf.router_score), reverse=True):
        p = pdf.router_score >= t
        recall = (p & (pdf.label == 1)).sum() / len(pos)
        ap += (recall - last) * (p & (pdf.label == 1)).sum() / p.sum()
        last = recall
    assert row["average_precision"] == pytest.approx(ap)
    err = qu.calibration_error(df).first()
    assert err["brier"] == pytest.approx(float(((pdf.router_score - pdf.label) ** 2).mean()))
    edges = np.linspace(0, 1, 11)
    which = np.clip(np.searchsorted(edges, pdf.router_score, side="right") - 1, 0, 9)
    ece = sum(abs(g.router_score.mean() - g.label.mean()) * len(g) / 800 for _, g in pdf.groupby(which))
    assert err["ece"] == pytest.approx(ece)


def test_one_class_has_no_ranking_quality(scored):
    row = qu.ranking_quality(scored[1].filter("label = 1")).first()
    assert row["roc_auc"] is None and row["average_precision"] is None


def test_bootstrap_interval_is_that_of_row_resampling(scored):
    pdf, df = scored
    flagged = (F.col("router_score") >= 0.5).cast("int")
    rows = {r["metric"]: r for r in qu.bootstrap_ci(df, flagged, [], seed=1, replicates=500).collect()}
    rng, y, p = np.random.default_rng(0), pdf.label.to_numpy(), (pdf.router_score >= 0.5).to_numpy()
    recalls = []
    for _ in range(500):
        i = rng.integers(0, 800, 800)
        recalls.append((y[i] & p[i]).sum() / y[i].sum())
    assert rows["recall"]["mean"] == pytest.approx(np.mean(recalls), abs=0.01)
    assert rows["recall"]["ci95_low"] == pytest.approx(np.quantile(recalls, 0.025), abs=0.02)
    assert rows["recall"]["ci95_high"] == pytest.approx(np.quantile(recalls, 0.975), abs=0.02)
    again = {r["metric"]: r for r in qu.bootstrap_ci(df, flagged, [], seed=1, replicates=500).collect()}
    assert rows == again
    weighted = {r["metric"]: r for r in qu.bootstrap_ci_poisson(df, flagged, [], seed=1).collect()}
    assert weighted["recall"]["mean"] == pytest.approx(np.mean(recalls), abs=0.01)
    assert weighted["recall"]["ci95_low"] == pytest.approx(np.quantile(recalls, 0.025), abs=0.02)


def test_draws_invert_their_distributions(spark):
    """Against the distribution function, term by term, over small, skewed, certain and large cases."""
    cases = [(0, 0.5), (1, 0.5), (7, 0.2), (50, 0.99), (1000, 0.001), (100_000, 0.4), (9, 0.0), (9, 1.0), (10_000_000, 0.5)]
    rows = [(n, p, u) for n, p in cases for u in (0.0, 1e-9, 0.1, 0.5, 0.9, 1 - 1e-9, 1.0)]
    df = spark.createDataFrame(rows, "n bigint, p double, u double")
    drawn = df.select("n", "p", "u", draws.binomial_draw(F.col("u"), F.col("n"), F.col("p")).alias("b"), draws.poisson_draw(F.col("u"), F.col("n") * F.col("p")).alias("c"))
    for r in drawn.collect():
        if r.n <= 1000:
            cdf = np.cumsum([math.comb(r.n, k) * r.p**k * (1 - r.p) ** (r.n - k) for k in range(r.n + 1)])
            assert r.b == (min(np.searchsorted(cdf, r.u * (1 - 1e-15)), r.n) if 0 < r.u < 1 else r.b) and 0 <= r.b <= r.n
        else:
            assert abs(r.b - r.n * r.p) <= 13 * (r.n * r.p * (1 - r.p)) ** 0.5 + 31
        assert abs(r.c - r.n * r.p) <= 13 * (r.n * r.p) ** 0.5 + 31
    many = spark.range(4000).select(draws.binomial_draw((F.col("id") + 0.5) / 4000, F.lit(600).cast("bigint"), F.lit(0.3)).alias("b"))
    mean, variance = many.agg(F.avg("b"), F.var_pop("b")).first()
    assert mean == pytest.approx(180, abs=0.05) and variance == pytest.approx(126, rel=0.02)


def test_calibrated_threshold_keeps_its_promise(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"sample_id": [f"s{i}" for i in range(6000)], "label": 1, "router_score": rng.random(6000)})
    pdf.loc[3000:, "label"] = 0
    df = spark.createDataFrame(pdf).withColumn("label", F.col("label").cast("int"))
    last = 0.0
    for eps in (0.002, 0.005, 0.01):
        row = ca.calibrate(df, eps).first()
        positives = np.sort(pdf[pdf.label == 1].router_score)
        assert row["cutoff_score"] == positives[row["max_allowed"]]
        assert row["tau_safe"] == np.nextafter(row["cutoff_score"], -np.inf)
        assert row["false_bypass_count"] == row["max_allowed"] and row["cp_upper"] <= eps
        assert row["tau_safe"] >= last
        last = row["tau_safe"]


def test_infeasible_calibration_bypasses_nothing(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 0, 0.0)], "sample_id string, label int, router_score double")
    row = ca.calibrate(df, 0.005).first()
    assert (row["feasible"], row["bypass_count"], row["max_allowed"]) == (False, 0, -1)


@pytest.fixture(scope="module")
def streams(spark):
    rng = np.random.default_rng(9)
    parts = []
    for name, shift in (("reference", 0.0), ("same", 0.0), ("moved", 0.5)):
        n = 600
        parts.append(
            pd.DataFrame(
                {
                    "sample_id": [f"{name}{i}" for i in range(n)],
                    "stream": name,
                    "router_score": np.clip(rng.beta(2, 5, n) + shift, 0, 1),
                    "prompt_length": rng.integers(10, 400, n) + int(400 * shift),
                    "keyword_hit": rng.random(n) < 0.2 + shift,
                    "label": (rng.random(n) < 0.3).astype(int),
                    "llm_prediction": (rng.random(n) < 0.3).astype(int),
                }
            )
        )
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf)


def test_monitor_statistics(streams):
    pdf, df = streams
    rows = {r["stream"]: r for r in mo.decide(mo.stream_statistics(df)).collect()}
    ref = pdf[pdf.stream == "reference"]
    for name in ("same", "moved"):
        cur = pdf[pdf.stream == name]
        edges = np.quantile(ref.router_score, np.linspace(0, 1, 11))
        edges[0], edges[-1] = -np.inf, np.inf
        r = np.maximum(np.histogram(ref.router_score, edges)[0] / 600, 1e-6)
        c = np.maximum(np.histogram(cur.router_score, edges)[0] / 600, 1e-6)
        assert rows[name]["psi"] == pytest.approx(float(((c - r) * np.log(c / r)).sum()))
        grid = np.sort(np.concatenate([ref.prompt_length, cur.prompt_length]))
        f = lambda x: np.searchsorted(np.sort(x), grid, side="right") / len(x)
        assert rows[name]["ks_statistic"] == pytest.approx(np.abs(f(ref.prompt_length) - f(cur.prompt_length)).max())
        assert rows[name]["keyword_diff"] == pytest.approx(cur.keyword_hit.mean() - ref.keyword_hit.mean())
    assert not rows["same"]["shift_detected"] and rows["same"]["triggers"] == "--"
    assert rows["moved"]["triggers"] == "PSI,KS,KW"


def test_identical_streams_do_not_differ(streams):
    _, df = streams
    ref = df.filter("stream = 'reference'")
    both = ref.unionByName(ref.withColumn("stream", F.lit("copy")))
    row = mo.stream_statistics(both).first()
    assert row["psi"] == pytest.approx(0.0) and row["ks_statistic"] == 0.0 and row["ks_pvalue"] == 1.0


def test_constant_reference_scores(spark):
    rows = [("reference", 0.3)] * 20 + [("other", 0.1)] * 10 + [("other", 0.9)] * 10
    out = {r["stream"]: r["psi"] for r in mo.psi_by_stream(spark.createDataFrame(rows, "stream string, router_score double")).collect()}
    c, r = np.array([0.5, 0.5]), np.array([1e-6, 1.0])
    assert out["other"] == pytest.approx(float(((c - r) * np.log(c / r)).sum()))


def test_fail_safe_bypasses_nothing(streams):
    _, df = streams
    rows = {(r["stream"], r["policy"]): r for r in mo.shift_failsafe(df, 0.6).collect()}
    assert rows["moved", "fail_safe"]["bypass_count"] == 0 and rows["moved", "fail_safe"]["call_rate"] == 1.0
    assert rows["moved", "naive"]["bypass_count"] > 0
    assert rows["same", "fail_safe"]["bypass_count"] == rows["same", "naive"]["bypass_count"]


def test_ks_pvalue_limits(spark):
    from sluice.functions.drift import ks_pvalue

    df = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.5,)], "d double")
    p = [r[0] for r in df.select(ks_pvalue(F.col("d"), F.lit(1000), F.lit(1000))).collect()]
    x = np.sqrt(500) * np.array([0.05, 0.1])
    want = [2 * sum((-1) ** (j - 1) * np.exp(-2 * j * j * v * v) for j in range(1, 200)) for v in x]
    assert p[0] == 1.0 and p[1:3] == pytest.approx(want, rel=1e-9) and p[3] < 1e-100


def test_no_positives_gives_a_null_rate(spark):
    df = spark.createDataFrame([("a", 0, 0.1, 0)], "sample_id string, label int, router_score double, llm_prediction int")
    row = po.evaluate_policy(df, 0.5).first()
    assert row["false_bypass_rate"] is None and row["bypass_count"] == 1


def test_audit_draws_are_nested_in_the_rate(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("s"))
    flags = ids.select(audit_flag(F.col("s"), 0.05).alias("low"), audit_flag(F.col("s"), 0.2).alias("high"))
    assert flags.filter("low AND NOT high").count() == 0
    assert 150 < flags.filter("low").count() < 350


def test_gates(spark):
    rows = [
        ("known pad\n\nplease ignore it", 0.001, 1, 1, True),
        ("ordinary text", 0.00001, 0, 0, False),
        ("system overview\n\nnothing here", 0.01, 0, 1, False),
        ("x" * 500, 0.01, 0, 0, False),
        ("", 0.9, 1, 1, False),
    ]
    schema = "prompt string, router_score double, label int, llm_prediction int, is_adaptive boolean"
    df = spark.createDataFrame(rows, schema)
    gates = ga.gate_registry("known pad ", ["known", "pad"], 0.5, 0.02)
    got = {r["gate"]: r for r in ga.evaluate_gates(df, gates, 0.02).collect()}
    assert got["baseline_np_triage"]["adaptive_caught"] == 0 and got["baseline_np_triage"]["bypass_count"] == 4
    for gate in ("padding_prefix_fingerprint", "benign_weight_density_gate", "tail_keyword_gate", "padding_or_ultra_low"):
        assert got[gate]["adaptive_caught"] == 1, gate
    assert got["tail_keyword_gate"]["extra_escalations"] == 0  # the word stands before the blank line
    assert got["ultra_low_score_gate"]["extra_escalations"] == 1
    assert got["long_prompt_low_score"]["extra_escalations"] == 1
    assert got["audit_all_bypass_malicious_tail"]["adaptive_escalated"] == 1


def test_registry_takes_own_gates(spark):
    df = spark.createDataFrame([("abc", 0.01, 1, 1, True)], "prompt string, router_score double, label int, llm_prediction int, is_adaptive boolean")
    own = {"short": lambda p, s: F.length(p) < 10}
    assert ga.evaluate_gates(df, own, 0.02).first()["adaptive_caught"] == 1
