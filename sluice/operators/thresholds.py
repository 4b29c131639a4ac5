"""Threshold sweeps and the choice of operating points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions import lexicons as lx
from sluice.functions.rates import ratio, weighted_confusion, with_rates
from sluice.operators.prefix import running_sums

GRID_POINTS = 1001


def _grid(df: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """The fixed candidate grid with zero weight, once per group that occurs."""
    step = 1.0 / (GRID_POINTS - 1)
    points = F.transform(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1)), lambda i: i * F.lit(step))
    seen = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    return seen.select(*groups, F.explode(points).alias(score), zero.alias("n"), zero.alias("pos"))


def metric_curve(
    df: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "router_score"
) -> DataFrame:
    """Confusion counts, rates and bypass figures at every candidate threshold.

    Candidates are the grid and all scores.  Each row is read off running sums, so the
    cost is one aggregation and one distributed sort instead of candidates times rows.
    Classification is ``score >= threshold``; bypass is ``score <= threshold``.
    """
    groups = list(groups)
    per_score = df.groupBy(*groups, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    both = per_score.unionByName(_grid(per_score, groups, score))
    points = both.groupBy(*groups, score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    ladder = running_sums(points, [score], ["n", "pos"], groups)
    below, below_pos = F.col("cum_n") - F.col("n"), F.col("cum_pos") - F.col("pos")
    counted = ladder.select(
        *groups,
        F.col(score).alias("threshold"),
        F.col("total_n").alias("n"),
        F.col("total_pos").alias("positives"),
        (below - below_pos).alias("tn"),
        (F.col("total_n") - F.col("total_pos") - (below - below_pos)).alias("fp"),
        below_pos.alias("fn"),
        (F.col("total_pos") - below_pos).alias("tp"),
        F.col("cum_n").alias("bypass_count"),
        F.col("cum_pos").alias("false_bypass_count"),
    )
    rated = with_rates(counted, ["accuracy", "precision", "recall", "specificity", "f1"])
    return rated.withColumns(
        {
            "bypass_rate": F.col("bypass_count") / F.col("n"),
            "false_bypass_rate": ratio(F.col("false_bypass_count"), F.col("positives")),
        }
    )


ROW = [
    "threshold", "n", "positives", "tn", "fp", "fn", "tp", "bypass_count", "false_bypass_count",
    "accuracy", "precision", "recall", "specificity", "f1", "bypass_rate", "false_bypass_rate",
]


def _best(rank: Sequence[Column], where: Column | None = None) -> Column:
    """Aggregate that keeps the best row; the comparison is a struct, so it combines map-side."""
    entry = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.struct(*ROW).alias("row"))
    return F.max(entry if where is None else F.when(where, entry)).getField("row")


def pick_best_f1() -> Column:
    return _best([F.col("f1"), F.col("recall"), F.col("precision"), -F.col("threshold")])


def pick_recall(target: float) -> Column:
    """Largest threshold that reaches the recall; else the row with the best recall."""
    reached = _best([F.col("threshold")], F.col("recall") >= target)
    fallback = [F.col("recall"), F.col("precision"), F.col("f1"), -F.col("threshold")]
    return F.coalesce(reached, _best(fallback))


def _is_fixed(value: float) -> Column:
    return F.abs(F.col("threshold") - value) <= 1e-9 * value


def pick_fixed(value: float = 0.5) -> Column:
    return _best([-F.col("threshold")], _is_fixed(value))


def pick_safe_bypass(limit: float) -> Column:
    """Highest bypass rate with the false-bypass rate within the limit; else the lowest rate."""
    rank = [F.col("bypass_count"), -F.col("false_bypass_count"), -F.col("threshold")]
    fits = _best(rank, F.col("false_bypass_rate") <= limit)
    return F.coalesce(fits, _best([-F.col("false_bypass_rate"), -F.col("threshold")]))


def select_point(curve: DataFrame, pick: Column, groups: Sequence[str] = ()) -> DataFrame:
    """One operating point per group."""
    return curve.groupBy(*groups).agg(pick.alias("_r")).select(*groups, "_r.*")


def best_f1(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return select_point(curve, pick_best_f1(), groups)


def recall_target(curve: DataFrame, target: float, groups: Sequence[str] = ()) -> DataFrame:
    return select_point(curve, pick_recall(target), groups)


def fixed_threshold(curve: DataFrame, value: float = 0.5) -> DataFrame:
    return curve.filter(_is_fixed(value))


def safe_bypass(curve: DataFrame, limit: float, groups: Sequence[str] = ()) -> DataFrame:
    return select_point(curve, pick_safe_bypass(limit), groups)


def threshold_set(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """All selected operating points as one long table (family, policy, tau, metrics).

    Every pick is an aggregate of the same pass over the curve.
    """
    picks = {("classification", "threshold_0_5"): pick_fixed(0.5), ("classification", "best_f1"): pick_best_f1()}
    for t in lx.RECALL_TARGETS:
        picks["classification", f"recall_ge_{t:g}".replace(".", "_")] = pick_recall(t)
    for t in lx.FALSE_BYPASS_LIMITS:
        picks["triage", f"max_fb_rate_{t:g}".replace(".", "_")] = pick_safe_bypass(t)
    points = [
        F.struct(F.lit(family).alias("family"), F.lit(policy).alias("policy"), pick.alias("row"))
        for (family, policy), pick in picks.items()
    ]
    chosen = curve.groupBy(*groups).agg(F.array(*points).alias("_points"))
    return chosen.select(*groups, F.explode("_points").alias("_p")).select(
        *groups, "_p.family", "_p.policy", F.col("_p.row.threshold").alias("tau"), *[f"_p.row.{c}" for c in ROW[1:]]
    )


def tau_array(thresholds: DataFrame, tau: str = "tau") -> Column:
    """The distinct thresholds of a policy table (a handful) as a sorted array."""
    return thresholds.agg(F.array_sort(F.collect_set(tau)).alias("t")).scalar()


def at_thresholds(
    df: DataFrame,
    taus: Column | Sequence[float],
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "router_score",
    judge: str | None = None,
) -> DataFrame:
    """Figures of every group at every threshold, from one pass that does not multiply rows.

    Each row is reduced to how many thresholds lie at or below, and strictly below, its
    score.  Rows are counted per such interval, and only that small table is unfolded.
    Without ``judge`` the confusion is of ``score >= tau``; with it, of the cascade that
    predicts 0 for bypassed rows and the judge's answer otherwise.
    """
    groups = list(groups)
    array = taus if isinstance(taus, Column) else F.array(*[F.lit(float(t)) for t in sorted(taus)])
    judged = F.col(judge) if judge else F.lit(0)
    s = F.col(score)
    cells = (
        df.select(*groups, F.col(label).alias("_y"), judged.alias("_j"), s.alias("_s"), array.alias("_taus"))
        .withColumns(
            {
                "_ge": F.size(F.filter("_taus", lambda t: t <= F.col("_s"))),
                "_gt": F.size(F.filter("_taus", lambda t: t < F.col("_s"))),
            }
        )
        .groupBy(*groups, "_y", "_j", "_ge", "_gt")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    unfolded = cells.select("*", array.alias("_taus")).select("*", F.posexplode("_taus").alias("_i", "tau"))
    bypass = F.col("_gt") <= F.col("_i")
    flagged = F.col("_ge") > F.col("_i")
    predicted = F.when(bypass, 0).otherwise(F.col("_j")) if judge else flagged.cast("int")
    weight, y = F.col("_n"), F.col("_y")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, weight).otherwise(0))

    counted = unfolded.groupBy(*groups, "tau").agg(
        F.sum(weight).alias("n"),
        total(y == 1).alias("positives"),
        total(bypass).alias("bypass_count"),
        total(bypass & (y == 1)).alias("false_bypass_count"),
        *weighted_confusion(y, predicted, weight),
    )
    return with_rates(counted).withColumns(
        {
            "call_rate": 1.0 - F.col("bypass_count") / F.col("n"),
            "cost_reduction": F.col("bypass_count") / F.col("n"),
            "false_bypass_rate": F.try_divide("false_bypass_count", "positives"),
        }
    )


def apply_threshold_set(
    df: DataFrame,
    thresholds: DataFrame,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "router_score",
    judge: str | None = None,
) -> DataFrame:
    """Evaluate chosen policies (family, policy, tau) on other data."""
    policies = thresholds.select("family", "policy", "tau")
    figures = at_thresholds(df, tau_array(policies), groups, label, score, judge)
    return policies.join(figures, "tau")


def cascade_sweep(
    df: DataFrame,
    selected: DataFrame,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "router_score",
    judge: str = "llm_prediction",
    fixed: Sequence[float] = tuple(lx.SWEEP_TAUS),
) -> DataFrame:
    """Selected bypass policies and a fixed grid of thresholds through router and judge."""
    named = F.explode(
        F.array(*[F.struct(F.lit(f"fixed_tau_{t:g}").alias("policy"), F.lit(t).alias("tau")) for t in fixed])
    )
    grid = df.sparkSession.range(1).select(named.alias("_f")).select("_f.policy", "_f.tau")
    policies = selected.select("policy", "tau").unionByName(grid)
    figures = at_thresholds(df, tau_array(policies), groups, label, score, judge)
    return policies.join(figures, "tau")


def frontier(points: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mark operating points that no other point beats in both cost and false bypass.

    Input is a policy table (a few rows per group), so one window per group is enough.
    """
    order = Window.partitionBy(*groups).orderBy(
        "false_bypass_rate", F.col("cost_reduction").desc(), "tau", "policy"
    )
    best_before = F.max("cost_reduction").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.col("cost_reduction") > F.coalesce(best_before, F.lit(-1.0))
    return points.withColumn("on_frontier", ahead)


def pick_policy(figures: DataFrame, policy: str) -> DataFrame:
    return figures.filter(F.col("policy") == policy)
