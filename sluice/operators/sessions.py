"""Per-session quarantine: after one audited catch nothing of the session is bypassed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import lexicons as lx
from sluice.functions.hashing import audit_flag
from sluice.functions.rates import ratio
from sluice.operators.prefix import ranked
from sluice.session import join_hot


def numbered_attempts(df: DataFrame, session: str, order: Sequence[str], name: str = "attempt_no") -> DataFrame:
    """Number the attempts of each session in order.

    A session may hold a large part of all rows, so this ranks over sort ranges rather
    than with one window per session.
    """
    return ranked(df, order, [session], name)


def attempt_audit(sample_id: Column, attempt: Column, rate: float = lx.AUDIT_RATE, seed: int = 0) -> Column:
    return audit_flag(F.concat(sample_id.cast("string"), F.lit(":attempt:"), attempt.cast("string")), rate, seed)


def caught(score: Column, tau: float, audited: Column, judge: Column) -> Column:
    """A bypassed attempt that was audited and judged positive."""
    return (score <= tau) & audited & (judge == 1)


def first_catches(df: DataFrame, hit: Column, session: str, attempt: str) -> DataFrame:
    """Attempt number of the first catch per session that has one (combined map-side)."""
    return df.filter(hit).groupBy(session).agg(F.min(attempt).alias("first_catch"))


def flag_after(df: DataFrame, catches: DataFrame, session: str = "session_id", attempt: str = "attempt_no") -> DataFrame:
    """Append ``quarantined``: the attempt comes after the session's first catch."""
    joined = join_hot(df, catches, [session])
    after = F.coalesce(F.col(attempt) > F.col("first_catch"), F.lit(False))
    return joined.withColumn("quarantined", after).drop("first_catch")


def with_quarantine(df: DataFrame, hit: Column, session: str = "session_id", attempt: str = "attempt_no") -> DataFrame:
    """Append ``quarantined``: an earlier attempt of the session was caught.

    The first catch fixes the state for good, so the running state equals a comparison
    with one number per session.  That needs no ordered pass over a session, and the join
    keeps the rows of hot sessions where they are.
    """
    return flag_after(df, first_catches(df, hit, session, attempt), session, attempt)


def session_outcomes(
    df: DataFrame,
    tau: float,
    session: str = "session_id",
    attempt: str = "attempt_no",
    label: str = "label",
    score: str = "router_score",
    judge: str = "llm_prediction",
    audited: str = "audited",
) -> DataFrame:
    """One row per session, with and without quarantine, from the same attempts.

    ``df`` needs the audit flag of every attempt; it only counts for bypassed ones.
    """
    s, j, y = F.col(score), F.col(judge), F.col(label)
    hit = caught(s, tau, F.col(audited), j)
    rows = with_quarantine(df, hit, session, attempt)
    by = s <= tau
    audit = by & F.col(audited)
    plain_call = ~by | audit
    call = F.col("quarantined") | plain_call
    missed = y == 1
    grouped = rows.groupBy(session).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(missed).alias("positives"),
        F.count_if(missed & ~(call & (j == 1))).alias("fn_quarantine"),
        F.count_if(missed & ~(plain_call & (j == 1))).alias("fn_audit_only"),
        F.count_if(call).alias("calls_quarantine"),
        F.count_if(plain_call).alias("calls_audit_only"),
        F.count_if(audit & ~F.col("quarantined")).alias("audited_quarantine"),
        F.count_if(audit).alias("audited_audit_only"),
        F.min(F.when(hit, F.col(attempt))).alias("quarantine_at"),
    )
    return grouped.withColumn("quarantined", F.col("quarantine_at").isNotNull())


def session_summary(outcomes: DataFrame) -> DataFrame:
    """Means over sessions for both policies."""
    policies = F.array(
        *[
            F.struct(
                F.lit(name).alias("policy"),
                F.col(f"fn_{name}").alias("fn"),
                F.col(f"calls_{name}").alias("calls"),
                F.col(f"audited_{name}").alias("audited"),
                (F.col("quarantined") & F.lit(name == "quarantine")).alias("q"),
            )
            for name in ("audit_only", "quarantine")
        ]
    )
    rows = outcomes.select("attempts", "positives", "quarantine_at", F.explode(policies).alias("p"))
    return rows.groupBy(F.col("p.policy").alias("policy")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg(F.when(F.col("positives") > 0, ratio(F.col("p.fn"), F.col("positives")))).alias("mean_fn_rate"),
        F.avg("p.fn").alias("mean_fn_count"),
        F.avg(F.col("p.q").cast("double")).alias("quarantine_rate"),
        F.avg(F.when(F.col("p.q"), F.col("quarantine_at"))).alias("mean_quarantine_at"),
        F.avg("p.calls").alias("mean_judge_calls"),
        F.avg("p.audited").alias("mean_audited"),
    )
