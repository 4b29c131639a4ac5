"""Bypass-threshold calibration with exact binomial guarantees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import binomial as bn
from sluice.functions.hashing import parity_bit
from sluice.functions.rates import confusion_counts, ratio, with_rates
from sluice.operators.prefix import running_sums
from sluice.session import join_small, stored


def attach(df: DataFrame, small: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Bring a one-row-per-group table to the rows; without groups, one scalar row."""
    if groups:
        return join_small(df, small, list(groups))
    fields = small.columns
    return df.withColumn("_row", small.select(F.struct(*fields).alias("r")).scalar()).select(
        *df.columns, *[F.col(f"_row.{f}").alias(f) for f in fields]
    )


def positive_budget(
    df: DataFrame, epsilon: float, alpha: float, groups: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Positives per group and how many of them may be bypassed."""
    counted = df.groupBy(*groups).agg(F.count_if(F.col(label) == 1).alias("positives"))
    return counted.withColumn("max_allowed", bn.max_allowed(F.col("positives"), epsilon, alpha))


def choose_threshold(
    df: DataFrame,
    epsilon: float,
    alpha: float = 0.05,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "router_score",
) -> DataFrame:
    """Largest tau whose exact upper bound on the false-bypass rate is within epsilon.

    With k allowed false bypasses the cut lies just below the (k+1)-th smallest positive
    score, which is read off running counts of the positives; nothing is collected or
    limited, although k grows with the data.  When even k = 0 cannot be certified,
    ``feasible`` is false and tau is 0, with nothing bypassed.
    """
    groups = list(groups)
    positives = df.filter(F.col(label) == 1).groupBy(*groups, score).agg(F.count(F.lit(1)).alias("n"))
    ladder = running_sums(positives, [score], ["n"], groups)
    budget = positive_budget(df, epsilon, alpha, groups, label)
    cut = (
        attach(ladder, budget, groups)
        .filter(F.col("cum_n") > F.col("max_allowed"))
        .groupBy(*groups)
        .agg(F.min(score).alias("cutoff_score"))
    )
    if groups:
        chosen = budget.join(cut, groups, "left")
    else:
        chosen = budget.withColumn("cutoff_score", cut.select("cutoff_score").scalar())
    k = F.col("max_allowed")
    tau = F.when(k < 0, 0.0).when(k >= F.col("positives"), 1.0).otherwise(bn.just_below(F.col("cutoff_score")))
    # One row per group that the next steps read several times.
    picked = chosen.select(
        *groups,
        F.lit(epsilon).alias("epsilon"),
        F.lit(alpha).alias("alpha"),
        "positives",
        "max_allowed",
        (k >= 0).alias("feasible"),
        F.when(k >= 0, F.col("cutoff_score")).alias("cutoff_score"),
        tau.alias("tau_safe"),
    )
    return stored(picked, "thresholds")


def bypassed(score: Column, tau: Column, feasible: Column | None = None) -> Column:
    flag = score <= tau
    return flag if feasible is None else flag & feasible


def risk_at(
    df: DataFrame,
    chosen: DataFrame,
    groups: Sequence[str] = (),
    alpha: float = 0.05,
    label: str = "label",
    score: str = "router_score",
) -> DataFrame:
    """False-bypass count, rate and upper bound of a chosen tau on (other) rows."""
    groups = list(groups)
    rows = attach(df.select(*groups, label, score), chosen.select(*groups, "tau_safe", "feasible"), groups)
    by = bypassed(F.col(score), F.col("tau_safe"), F.col("feasible"))
    pos = F.col(label) == 1
    counted = rows.groupBy(*groups).agg(
        F.first("tau_safe").alias("tau_safe"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos).alias("positives"),
        F.count_if(by).alias("bypass_count"),
        F.count_if(by & pos).alias("false_bypass_count"),
    )
    return counted.withColumns(
        {
            "false_bypass_rate": ratio(F.col("false_bypass_count"), F.col("positives")),
            "cp_upper": bn.cp_upper(F.col("false_bypass_count"), F.col("positives"), alpha),
            "call_reduction": ratio(F.col("bypass_count"), F.col("n")),
        }
    )


def calibrate(
    df: DataFrame,
    epsilon: float,
    alpha: float = 0.05,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "router_score",
) -> DataFrame:
    """Chosen tau together with its figures on the calibration rows."""
    groups = list(groups)
    chosen = choose_threshold(df, epsilon, alpha, groups, label, score)
    risk = risk_at(df, chosen, groups, alpha, label, score).drop("tau_safe", "positives")
    return attach(chosen, risk, groups)


def interval_columns(alpha: float = 0.05) -> dict[str, Column]:
    k, n = F.col("false_bypass_count"), F.col("positives")
    low, high = bn.wilson(k, n)
    return {
        "false_bypass_rate": ratio(k, n),
        "wilson_low": low,
        "wilson_high": high,
        "cp_upper": bn.cp_upper(k, n, alpha),
    }


def router_only(
    df: DataFrame, tau: float, groups: Sequence[str] = (), label: str = "label", score: str = "router_score"
) -> DataFrame:
    """Call reduction and false bypass with both intervals; no judge answers needed."""
    by, pos = F.col(score) <= tau, F.col(label) == 1
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos).alias("positives"),
        F.count_if(by).alias("bypass_count"),
        F.count_if(by & pos).alias("false_bypass_count"),
    )
    cols = {"tau_safe": F.lit(tau), "call_reduction": ratio(F.col("bypass_count"), F.col("n"))}
    return counted.withColumns(cols | interval_columns())


def judged_with_intervals(
    df: DataFrame,
    tau: float,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "router_score",
    judge: str = "llm_prediction",
) -> DataFrame:
    """Cascade quality plus both intervals of the false-bypass rate."""
    by, pos = F.col(score) <= tau, F.col(label) == 1
    final = F.when(by, 0).otherwise(F.col(judge))
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos).alias("positives"),
        F.count_if(by).alias("bypass_count"),
        F.count_if(by & pos).alias("false_bypass_count"),
        *confusion_counts(F.col(label), final),
    )
    cols = {
        "tau_safe": F.lit(tau),
        "call_rate": 1.0 - F.col("bypass_count") / F.col("n"),
        "cost_reduction": F.col("bypass_count") / F.col("n"),
    }
    return with_rates(counted, ["accuracy", "precision", "recall", "specificity", "f1"]).withColumns(
        cols | interval_columns()
    )


def fixed_tau_risk(
    df: DataFrame,
    tau: float,
    groups: Sequence[str] = (),
    alpha: float = 0.05,
    label: str = "label",
    score: str = "router_score",
) -> DataFrame:
    by, pos = F.col(score) <= tau, F.col(label) == 1
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos).alias("positives"),
        F.count_if(by & pos).alias("false_bypass_count"),
        (F.count_if(by) / F.count(F.lit(1))).alias("call_reduction"),
    )
    k, n = F.col("false_bypass_count"), F.col("positives")
    return counted.withColumns(
        {"tau_safe": F.lit(tau), "false_bypass_rate": ratio(k, n), "cp_upper": bn.cp_upper(k, n, alpha)}
    )


def hash_split_confirmation(
    df: DataFrame,
    epsilon: float,
    alpha: float = 0.05,
    label: str = "label",
    score: str = "router_score",
    id_col: str = "sample_id",
) -> DataFrame:
    """Choose on one hash half and confirm on the other, both ways, then min tau on all rows.

    Both halves are calibrated in one grouped pass.  The chosen table has two rows; its
    other-half lookup is the bit flipped, so no row meets any other row.
    """
    halves = df.select(label, score, parity_bit(F.col(id_col)).alias("bit"))
    chosen = choose_threshold(halves, epsilon, alpha, ["bit"], label, score)
    for_other = chosen.select((1 - F.col("bit")).alias("bit"), "tau_safe", "feasible")
    confirmed = risk_at(halves, for_other, ["bit"], alpha, label, score)
    confirmed = confirmed.withColumn("selection", (1 - F.col("bit")).cast("string")).drop("bit")
    lowest = chosen.agg(F.min("tau_safe").alias("tau_safe"), F.bool_and("feasible").alias("feasible"))
    overall = risk_at(halves, lowest, (), alpha, label, score).withColumn("selection", F.lit("min_of_halves"))
    return confirmed.unionByName(overall).withColumn("passes", F.col("cp_upper") <= epsilon)
