"""Shift monitoring per event-time window."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import drift
from sluice.functions import lexicons as lx
from sluice.operators import monitor as mo
from sluice.operators.policy import policy_counts
from sluice.operators.prefix import value_counts
from sluice.session import scratch_path
from sluice.streaming.run import drain_batches

SKETCH_K = 2048
RANKS = 256


@dataclass(frozen=True)
class Profile:
    """The reference window: a few hundred numbers, and where the exact counts of its lengths are.

    ``points`` are quantiles of the lengths, from a sketch, and ``ranks`` the sketch's ranks of them.
    """

    n: int
    edges: list[float]
    bins: list[int]
    keyword_rate: float
    known: int
    points: list[float]
    ranks: list[float]
    counts_path: str
    k: int


def reference_profile(
    reference: DataFrame,
    score: str = "router_score",
    length: str = "prompt_length",
    flag: str = "keyword_hit",
    bins: int = 10,
    k: int = SKETCH_K,
) -> Profile:
    """Computed once in batch when a stream starts; one row reaches the driver.

    Rows per distinct length are written to the shared folder, for windows that the sketches leave open.
    """
    edges = mo.reference_edges(reference, score, bins)
    value = F.col(length).cast("double")
    row = (
        reference.withColumn("_edges", edges)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("_edges").alias("edges"),
            mo.bin_counts(F.col(score), F.col("_edges"), bins).alias("bins"),
            F.avg(F.col(flag).cast("double")).alias("rate"),
            F.count(value).alias("known"),
            F.kll_sketch_agg_double(value, k).alias("sketch"),
        )
        .withColumn("points", F.when(F.col("known") > 0, F.array_distinct(F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(i / RANKS) for i in range(RANKS + 1)))))))
        .first()
    )
    points = row["points"] or []
    sketch, at = F.lit(bytearray(row["sketch"] or b"")), F.array(*(F.lit(p) for p in points))
    ranks = reference.sparkSession.range(1).select(F.kll_sketch_get_rank_double(sketch, at).alias("r")).first()["r"] if points else []
    path = scratch_path(reference.sparkSession, "reference-lengths")
    value_counts(reference.select(value.alias("value")), "value").write.parquet(path)
    return Profile(row["n"], row["edges"], row["bins"], row["rate"], row["known"], points, ranks, path, k)


def rank_error(k: int, n: Column) -> Column:
    """How far a rank in a KLL sketch may be off: three times its error at 99 %; a sketch of k values or fewer is exact.

    Fixed values: the published error of KLL ranks is 2.296 / k ** 0.9723 with 99 % confidence.  Errors
    have the tails of a normal distribution, so three times that is beyond seven standard deviations.
    """
    return F.when(n <= k, 0.0).otherwise(3 * 2.296 / k**0.9723)


def ks_bounds(current: Column, n: Column, profile: Profile) -> tuple[Column, Column]:
    """Bounds of the KS statistic between a window's sketch and the reference's.

    Both distributions are looked up at quantiles of the reference.  Between two such points each only
    rises from its value at the first to that at the second, which bounds their distance from above.
    """
    c = F.kll_sketch_get_rank_double(current, F.array(*(F.lit(p) for p in profile.points)))
    r = F.array(*(F.lit(v) for v in profile.ranks))
    error = rank_error(profile.k, n) + rank_error(profile.k, F.lit(profile.known))
    at = F.array_max(F.zip_with(c, r, lambda x, y: F.abs(x - y)))
    before = lambda x: F.slice(F.concat(F.array(F.lit(0.0)), x), 1, len(profile.points))
    rises = F.array_max(F.concat(F.zip_with(c, before(r), lambda x, y: x - y), F.zip_with(r, before(c), lambda x, y: x - y)))
    return F.greatest(at - error, F.lit(0.0)), F.least(F.greatest(at, rises) + error, F.lit(1.0))


def window_counts(
    rows: DataFrame, profile: Profile, width: str, slide: str | None, time: str, score: str, length: str, flag: str, sketch: bool
) -> DataFrame:
    """Per window: n, PSI, keyword drift, and the rows with a length; with ``sketch`` a sketch of the lengths."""
    bins = len(profile.bins)
    edges = F.array(*[F.lit(float(e)) for e in profile.edges])
    index = mo.bin_index(F.col(score), edges, bins)
    value = F.col(length).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("hits"), F.count(value).alias("known")]
    aggs += [F.count_if(index == i).alias(f"_bin{i}") for i in range(bins)]
    aggs += [F.kll_sketch_agg_double(value, profile.k).alias("sketch")] if sketch else []
    n, psi = F.col("n"), F.lit(0.0)
    for i in range(bins):
        psi = psi + drift.psi_term(F.lit(profile.bins[i] / profile.n), F.col(f"_bin{i}") / n)
    return rows.groupBy(F.window(time, width, slide).alias("w")).agg(*aggs).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", psi.alias("psi"),
        (F.col("hits") / n - F.lit(profile.keyword_rate)).alias("keyword_diff"), "known", *(["sketch"] if sketch else []),
    )


def window_sketches(
    stream: DataFrame,
    profile: Profile,
    width: str = "1 day",
    slide: str | None = None,
    delay: str = "1 hour",
    time: str = "ts",
    score: str = "router_score",
    length: str = "prompt_length",
    flag: str = "keyword_hit",
    ks_limit: float = lx.KS_P_LIMIT,
) -> DataFrame:
    """Per window, from a state of fixed size (counters and one sketch): what ``window_counts`` has, ``ks_low``,
    ``ks_high`` and ``ks_trigger`` (null where the bounds don't settle it)."""
    timed = stream.withWatermark(time, delay) if stream.isStreaming else stream
    counted = window_counts(timed, profile, width, slide, time, score, length, flag, True)
    some = F.col("known") > 0
    if profile.known:
        low, high = ks_bounds(F.col("sketch"), F.col("known"), profile)
    else:  # no length to compare with
        low, high, some = F.lit(0.0), F.lit(0.0), F.lit(False)
    bounded = counted.withColumns({"ks_low": F.when(some, low), "ks_high": F.when(some, high)}).drop("sketch")
    surely, never = (drift.ks_pvalue(F.col(c), F.col("known"), F.lit(profile.known)) for c in ("ks_low", "ks_high"))
    settled = F.when(~some, False).when(surely < ks_limit, True).when(never >= ks_limit, False)
    return bounded.withColumn("ks_trigger", settled)


def exact_window_ks(
    rows: DataFrame, profile: Profile, width: str, slide: str | None, time: str, length: str
) -> DataFrame:
    """window_start, ks_statistic and ks_pvalue of every window of rows, from counts per window and distinct length."""
    value = F.col(length).cast("double").alias("value")
    counts = value_counts(rows.select(F.window(time, width, slide)["start"].alias("window_start"), value), "value", ["window_start"])
    reference = rows.sparkSession.read.schema("value double, n bigint").parquet(profile.counts_path)
    return mo.ks_against(counts, reference, "value", ["window_start"]).select("window_start", "ks_statistic", "ks_pvalue")


def window_statistics(
    rows: DataFrame,
    profile: Profile,
    width: str = "1 day",
    slide: str | None = None,
    time: str = "ts",
    score: str = "router_score",
    length: str = "prompt_length",
    flag: str = "keyword_hit",
) -> DataFrame:
    """Batch: PSI, exact KS, keyword drift and the decision per window; null lengths don't count in KS."""
    counted = window_counts(rows, profile, width, slide, time, score, length, flag, False)
    ks = exact_window_ks(rows, profile, width, slide, time, length)
    stats = counted.join(ks, "window_start", "left").drop("known")
    return mo.decide(stats.withColumns({"ks_statistic": F.coalesce("ks_statistic", F.lit(0.0)), "ks_pvalue": F.coalesce("ks_pvalue", F.lit(1.0))}))


def run_window_monitor(
    stream: DataFrame,
    history: DataFrame,
    profile: Profile,
    path: str,
    width: str = "1 day",
    slide: str | None = None,
    delay: str = "1 hour",
    time: str = "ts",
    score: str = "router_score",
    length: str = "prompt_length",
    flag: str = "keyword_hit",
) -> DataFrame:
    """Decide every closed window of a stream as exact KS does; returns the table of decisions.

    The state per window is bounded, whatever its rows and distinct lengths.  For windows that the bounds
    leave open, and only these, exact counts are taken from ``history``, a table of the same rows (what
    the stream reads, or where it is archived).  It must not hold rows that the watermark has dropped.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, sketched = batch.sparkSession, f"{path}/sketched/batch={number}"
        batch.write.mode("overwrite").parquet(sketched)
        closed = spark.read.schema(batch.schema).parquet(sketched)
        is_open = closed.filter("ks_trigger is null")
        reach = is_open.agg(F.min("window_start").alias("low"), F.max("window_end").alias("high"), F.count(F.lit(1)).alias("n")).first()
        exact = None
        if reach.n:
            starts = F.window(time, width, slide)["start"]
            kept = history.filter((F.col(time) >= F.lit(reach.low)) & (F.col(time) < F.lit(reach.high)))
            kept = kept.withColumn("_start", starts).join(is_open.select(F.col("window_start").alias("_start")), "_start", "left_semi").drop("_start")
            exact = exact_window_ks(kept, profile, width, slide, time, length).join(is_open.select("window_start"), "window_start", "left_semi")
        told = closed if exact is None else closed.join(exact, "window_start", "left")
        if exact is None:
            told = told.withColumns({"ks_statistic": F.lit(None).cast("double"), "ks_pvalue": F.lit(None).cast("double")})
        trigger = F.coalesce("ks_trigger", F.col("ks_pvalue") < lx.KS_P_LIMIT, F.lit(False))
        told = mo.with_triggers(told, trigger).drop("known")
        told.write.mode("overwrite").parquet(f"{path}/decided/batch={number}")

    sketches = window_sketches(stream, profile, width, slide, delay, time, score, length, flag)
    drain_batches(sketches, handle, path)
    return stream.sparkSession.read.option("recursiveFileLookup", True).schema(DECIDED).parquet(f"{path}/decided")


DECIDED = (
    "window_start timestamp, window_end timestamp, n bigint, psi double, keyword_diff double, ks_low double, ks_high double, "
    "ks_statistic double, ks_pvalue double, psi_trigger boolean, ks_trigger boolean, keyword_trigger boolean, shift_detected boolean, triggers string"
)


def window_rates(
    stream: DataFrame,
    tau: float,
    width: str = "1 day",
    slide: str = "6 hours",
    delay: str = "1 hour",
    time: str = "ts",
    score: str = "router_score",
    flag: str = "keyword_hit",
) -> DataFrame:
    """Keyword rate and judge-call rate in sliding windows."""
    timed = stream.withWatermark(time, delay) if stream.isStreaming else stream
    counted = timed.groupBy(F.window(time, width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(flag).cast("double")).alias("keyword_rate"),
        (1.0 - F.count_if(F.col(score) <= tau) / F.count(F.lit(1))).alias("call_rate"),
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "keyword_rate", "call_rate"
    )


def batch_decision(batch: DataFrame, profile: Profile, tau: float) -> DataFrame:
    """One row: statistics of a whole micro-batch, the decision, and the policy figures."""
    one_window = batch.withColumn("_at", F.lit(0).cast("timestamp"))
    stats = window_statistics(one_window, profile, "1 day", time="_at").drop("window_start", "window_end")
    counts = batch.agg(
        F.count_if(F.col("label") == 1).alias("positives"),
        *policy_counts(F.col("label"), F.col("router_score"), F.col("llm_prediction"), tau, "naive_"),
    ).select(F.struct("positives", "naive_bypass_count", "naive_false_bypass_count").alias("c"))
    return stats.withColumn("_c", counts.scalar()).select("*", "_c.*").drop("_c")


def run_fail_safe(
    stream: DataFrame, profile: Profile, path: str, tau: float = lx.DEPLOYED_TAU, columns: tuple[str, ...] = ("sample_id", "router_score")
) -> Callable[[], tuple[DataFrame, DataFrame]]:
    """Route each micro-batch by its own shift decision; writes policy rows and routed rows.

    The policy row is written first and read back, so routing uses exactly the decision on
    record, also when the batch is repeated after a failure.
    """

    def handle(batch: DataFrame, number: int) -> None:
        policy_path = f"{path}/policy/batch={number}"
        batch_decision(batch, profile, tau).write.mode("overwrite").parquet(policy_path)
        shift = batch.sparkSession.read.parquet(policy_path).select("shift_detected").scalar()
        bypass = (F.col("router_score") <= tau) & ~F.coalesce(F.col("_shift"), F.lit(True))
        routed = batch.withColumn("_shift", shift).select(
            *columns, F.when(bypass, "bypass").otherwise("judge").alias("route")
        )
        routed.write.mode("overwrite").parquet(f"{path}/routed/batch={number}")

    drain_batches(stream, handle, path)
    spark = stream.sparkSession
    return lambda: (spark.read.parquet(f"{path}/policy"), spark.read.parquet(f"{path}/routed"))
