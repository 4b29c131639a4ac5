"""Stateless routing and duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import lexicons as lx
from sluice.functions.hashing import audit_flag


def route(
    df: DataFrame, tau: float = lx.DEPLOYED_TAU, rate: float = lx.AUDIT_RATE, seed: int = 0, score: str = "router_score", id_col: str = "sample_id"
) -> DataFrame:
    """``judge``, ``audit`` (bypassed but drawn) or ``bypass`` for every row."""
    by = F.col(score) <= tau
    drawn = audit_flag(F.col(id_col), rate, seed)
    return df.withColumn("route", F.when(~by, "judge").when(drawn, "audit").otherwise("bypass"))


def unseen(df: DataFrame, delay: str = "1 hour", time: str = "ts", id_col: str = "sample_id") -> DataFrame:
    """First arrival of each id within the watermark; state expires with it."""
    if not df.isStreaming:
        return df.dropDuplicates([id_col])
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_col])


def attempts_per_session(
    df: DataFrame, gap: str = "1 hour", delay: str = "1 hour", session: str = "session_id", time: str = "ts", score: str = "router_score", tau: float = lx.DEPLOYED_TAU
) -> DataFrame:
    """Bursts of attempts separated by a pause."""
    timed = df.withWatermark(time, delay) if df.isStreaming else df
    grouped = timed.groupBy(session, F.session_window(time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col(score) <= tau).alias("bypassed")
    )
    return grouped.select(
        session, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "attempts", "bypassed"
    )
