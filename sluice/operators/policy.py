"""Cost and false-bypass evaluation of routing and audit policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import lexicons as lx
from sluice.functions.binomial import exposure
from sluice.functions.hashing import audit_flag
from sluice.functions.rates import confusion_counts, ratio, with_rates

RATES = ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1"]


def cascade_prediction(score: Column, tau: Column | float, judge: Column) -> Column:
    return F.when(score <= tau, 0).otherwise(judge)


def policy_counts(
    label: Column, score: Column, judge: Column, tau: Column | float, prefix: str = ""
) -> list[Column]:
    """Aggregates of one policy; several policies can share a pass through ``prefix``."""
    by = score <= tau
    final = cascade_prediction(score, tau, judge)
    cols = [F.count_if(by).alias(f"{prefix}bypass_count")]
    cols.append(F.count_if(by & (label == 1)).alias(f"{prefix}false_bypass_count"))
    for c, name in zip(confusion_counts(label, final), ["tn", "fp", "fn", "tp"]):
        cols.append(c.alias(f"{prefix}{name}"))
    return cols


def rated_policy(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rates and cost figures of a frame with n, positives, bypass and confusion counts.

    The false-bypass rate is null where there are no positives.
    """
    return with_rates(df, RATES).withColumns(
        {
            "call_rate": 1.0 - F.col("bypass_count") / F.col("n"),
            "cost_reduction": F.col("bypass_count") / F.col("n"),
            "false_bypass_rate": F.try_divide("false_bypass_count", "positives"),
        }
    )


def evaluate_policy(
    df: DataFrame,
    tau: float,
    groups: Sequence[str] = (),
    fail_safe: bool = False,
    label: str = "label",
    score: str = "router_score",
    judge: str = "llm_prediction",
) -> DataFrame:
    """Router-then-judge figures per group; in fail-safe mode nothing is bypassed."""
    limit: Column | float = F.lit(float("-inf")) if fail_safe else tau
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("positives"),
        *policy_counts(F.col(label), F.col(score), F.col(judge), limit),
    )
    return rated_policy(counted)


def audit_policy(
    df: DataFrame,
    tau: float,
    rate: float = lx.AUDIT_RATE,
    seed: int = 0,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "router_score",
    judge: str = "llm_prediction",
    adaptive: str = "is_adaptive",
    id_col: str = "sample_id",
) -> DataFrame:
    """Bypass with a hash-drawn share of the bypassed rows sent to the judge anyway."""
    by = F.col(score) <= tau
    rows = df.withColumns({"_by": by, "_audit": by & audit_flag(F.col(id_col), rate, seed)})
    rows = rows.withColumn("_called", ~F.col("_by") | F.col("_audit"))
    rows = rows.withColumn("_pred", F.when(F.col("_called"), F.col(judge)).otherwise(0))
    pos, adapt = F.col(label) == 1, F.col(adaptive) & (F.col(label) == 1)
    audit, hit = F.col("_audit"), F.col("_pred") == 1
    counted = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos).alias("positives"),
        F.count_if("_called").alias("called_count"),
        F.count_if(audit).alias("audited_bypass_count"),
        F.count_if(pos & F.col("_by") & ~audit).alias("malicious_false_bypass_count"),
        F.count_if(pos & ~hit).alias("malicious_e2e_fn_count"),
        F.count_if(adapt).alias("adaptive_count"),
        F.count_if(adapt & audit).alias("adaptive_audited_count"),
        F.count_if(adapt & ~hit).alias("adaptive_e2e_fn_count"),
        F.count_if(adapt & audit & hit).alias("adaptive_caught_when_audited"),
        F.count_if(pos & audit).alias("malicious_bypass_audited_count"),
        F.count_if(pos & audit & hit).alias("malicious_caught_when_audited"),
        F.count_if(F.col("_by")).alias("naive_bypass_count"),
        *confusion_counts(F.col(label), F.col("_pred")),
    )
    n = F.col("n")
    figures = {
        "audit_rate": F.lit(rate),
        "audit_seed": F.lit(seed),
        "call_rate": F.col("called_count") / n,
        "cost_reduction": 1.0 - F.col("called_count") / n,
        "naive_cost_reduction": F.col("naive_bypass_count") / n,
        "malicious_false_bypass_rate": ratio(F.col("malicious_false_bypass_count"), F.col("positives")),
        "malicious_e2e_fn_rate": ratio(F.col("malicious_e2e_fn_count"), F.col("positives")),
        "adaptive_e2e_fn_rate": ratio(F.col("adaptive_e2e_fn_count"), F.col("adaptive_count")),
        "adaptive_judge_miss_when_audited": F.col("adaptive_audited_count")
        - F.col("adaptive_caught_when_audited"),
        "malicious_judge_miss_when_audited": F.col("malicious_bypass_audited_count")
        - F.col("malicious_caught_when_audited"),
    }
    return with_rates(counted, RATES).withColumns(figures)


def audit_seed_sensitivity(
    df: DataFrame,
    tau: float,
    rate: float = lx.AUDIT_RATE,
    seeds: int = 100,
    label: str = "label",
    score: str = "router_score",
    judge: str = "llm_prediction",
    adaptive: str = "is_adaptive",
    id_col: str = "sample_id",
) -> DataFrame:
    """Per audit seed: missed and audited adaptive rows.

    Only bypassed adaptive positives depend on the seed, so only they meet the seeds; rows
    that went to the judge anyway are counted once.
    """
    adaptive_rows = df.filter(F.col(adaptive) & (F.col(label) == 1))
    by = F.col(score) <= tau
    fixed = adaptive_rows.agg(
        F.count(F.lit(1)).alias("adaptive_count"),
        F.count_if(~by & (F.col(judge) == 0)).alias("judge_miss"),
    )
    spread = adaptive_rows.filter(by).select(
        id_col, judge, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("audit_seed")
    )
    drawn = audit_flag(F.col(id_col), rate, F.col("audit_seed"))
    per_seed = (
        spread.withColumn("_audit", drawn)
        .groupBy("audit_seed")
        .agg(
            F.count_if("_audit").alias("adaptive_audited_count"),
            F.count_if(~F.col("_audit") | (F.col(judge) == 0)).alias("_missed"),
        )
    )
    per_seed = per_seed.withColumn("_f", fixed.select(F.struct("*")).scalar())
    missed = F.col("_missed") + F.col("_f.judge_miss")
    return per_seed.select(
        "audit_seed",
        "adaptive_audited_count",
        missed.alias("adaptive_e2e_fn_count"),
        ratio(missed, F.col("_f.adaptive_count")).alias("adaptive_e2e_fn_rate"),
    )


def seed_means(per_seed: DataFrame) -> DataFrame:
    return per_seed.agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg("adaptive_e2e_fn_rate").alias("mean_adaptive_e2e_fn_rate"),
        F.avg("adaptive_audited_count").alias("mean_adaptive_audited_count"),
    )


def audit_exposure(streams: DataFrame, rates: Sequence[float] = tuple(lx.AUDIT_RATES)) -> DataFrame:
    """What an audit rate means for streams with bypassed attacks.

    Input, one row per stream: ``adaptive_bypass_count, naive_reduction,
    failsafe_reduction, shift_detected``.
    """
    n, naive, shift = F.col("adaptive_bypass_count"), F.col("naive_reduction"), F.col("shift_detected")
    rate = F.col("audit_rate")
    return (
        streams.filter(n > 0)
        .withColumn("audit_rate", F.explode(F.array(*[F.lit(r) for r in rates])))
        .withColumns(
            {
                "exposure_probability": exposure(rate, n),
                "expected_audited": rate * n,
                "extra_call_rate": F.when(shift, 0.0).otherwise(rate * naive),
                "final_reduction": F.when(shift, F.col("failsafe_reduction")).otherwise(naive - rate * naive),
            }
        )
    )


def outcome_by_rate(
    df: DataFrame, rate: str = "mixture_rate", bypass: str = "router_bypass", judge: str = "llm_prediction"
) -> DataFrame:
    """What the judge would have said about bypassed attacks, per mixing rate."""
    by, miss = F.col(bypass), F.col(judge) == 0
    counted = df.groupBy(rate).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(by).alias("router_bypass_count"),
        F.count_if(by & miss).alias("judge_would_miss"),
        F.count_if(by & ~miss).alias("judge_would_catch"),
        F.count_if(by | miss).alias("observed_e2e_fn"),
    )
    return counted.withColumns(
        {
            "observed_e2e_fn_rate": ratio(F.col("observed_e2e_fn"), F.col("n")),
            "counterfactual_e2e_fn_rate": ratio(F.col("judge_would_miss"), F.col("router_bypass_count")),
        }
    )
