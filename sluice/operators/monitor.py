"""Distribution-shift monitoring of streams against a reference window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions import drift
from sluice.functions import lexicons as lx
from sluice.operators.policy import policy_counts, rated_policy
from sluice.operators.prefix import exact_quantiles, running_sums, value_counts

REFERENCE = "reference"


def reference_edges(reference: DataFrame, value: str, bins: int = 10) -> Column:
    """Inner bin edges: reference quantiles, equal ones merged; outer edges are infinite.

    A scalar column of at most ``bins - 1`` numbers.
    """
    probs = [i * (1.0 / bins) for i in range(1, bins)] or [0.5]
    q = exact_quantiles(reference, value, probs, name="q")
    inner = F.array_distinct("q") if bins > 1 else F.array(F.lit(0.5))
    return q.select(inner.alias("edges")).scalar()


def bin_index(value: Column, edges: Column, bins: int = 10) -> Column:
    """Number of inner edges at or below the value; missing edges never count."""
    index = F.lit(0)
    for i in range(bins - 1):
        index = index + F.coalesce((F.get(edges, F.lit(i)) <= value).cast("int"), F.lit(0))
    return index


def bin_counts(value: Column, edges: Column, bins: int = 10) -> Column:
    """Aggregate: rows per bin as an array of fixed length."""
    at = bin_index(value, edges, bins)
    return F.array(*[F.count_if(at == i) for i in range(bins)])


def psi(current: Column, n: Column, reference: Column, n_reference: Column, bins: int = 10) -> Column:
    total = F.lit(0.0)
    for i in range(bins):
        total = total + drift.psi_term(reference[i] / n_reference, current[i] / n)
    return total


def _reference_row(stream: str, name: str, fields: Sequence[str]) -> Column:
    """The reference's fields next to every stream, from the per-stream table itself.

    That table has one row per monitored stream, so one window over it is small, and the
    pass over the rows is not repeated.
    """
    whole = Window.partitionBy(F.lit(0))
    return F.first(F.when(F.col(stream) == name, F.struct(*fields)), ignorenulls=True).over(whole)


def psi_by_stream(
    df: DataFrame,
    value: str = "router_score",
    stream: str = "stream",
    reference: str = REFERENCE,
    bins: int = 10,
) -> DataFrame:
    """Population stability index of every stream; one pass after the reference quantiles."""
    edges = reference_edges(df.filter(F.col(stream) == reference), value, bins)
    binned = df.select(stream, F.col(value).alias("_v"), edges.alias("_edges"))
    stats = binned.groupBy(stream).agg(
        F.count(F.lit(1)).alias("n"), bin_counts(F.col("_v"), F.col("_edges"), bins).alias("_bins")
    )
    joined = stats.withColumn("_ref", _reference_row(stream, reference, ["n", "_bins"]))
    value_of = psi(F.col("_bins"), F.col("n"), F.col("_ref._bins"), F.col("_ref.n"), bins)
    return joined.select(stream, "n", value_of.alias("psi"))


def ks_against(current: DataFrame, reference: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Two-sample KS statistic of every group's counts against one reference's: groups, n, n_reference, ks_statistic, ks_pvalue.

    Both inputs hold rows per distinct value (``value_counts``).  The distance is greatest at a value of the
    group, or just below one, so the reference's running counts are only looked up there: one running sum
    over distinct values for the reference, one per group for the rest, and nothing is repeated per group.
    """
    at, size = F.col(value).alias("_v"), F.col("n")
    values = (
        reference.select(at, size.alias("_r"))
        .unionByName(current.select(at, F.lit(0).cast("bigint").alias("_r")))
        .groupBy("_v")
        .agg(F.sum("_r").alias("_r"))
    )
    ladder = running_sums(values, ["_v"], ["_r"]).withColumnRenamed("_v", "_value")
    own = running_sums(current.select(*groups, at, size.alias("_c")), ["_v"], ["_c"], groups)
    met = own.join(ladder, F.col("_v") == F.col("_value"))
    upto = F.abs(F.col("cum__c") / F.col("total__c") - F.col("cum__r") / F.col("total__r"))
    below = F.abs((F.col("cum__c") - F.col("_c")) / F.col("total__c") - (F.col("cum__r") - F.col("_r")) / F.col("total__r"))
    stat = met.groupBy(*groups).agg(
        F.max("total__c").alias("n"), F.max("total__r").alias("n_reference"), F.max(F.greatest(upto, below)).alias("ks_statistic")
    )
    return stat.withColumn("ks_pvalue", drift.ks_pvalue(F.col("ks_statistic"), F.col("n"), F.col("n_reference")))


def ks_by_stream(
    df: DataFrame, value: str = "prompt_length", stream: str = "stream", reference: str = REFERENCE
) -> DataFrame:
    """KS statistic of every stream against the reference, and its asymptotic p-value."""
    counts = value_counts(df, value, [stream])
    of_reference = F.col(stream) == reference
    return ks_against(counts.filter(F.col(stream) != reference), counts.filter(of_reference).drop(stream), value, [stream])


def keyword_drift(
    df: DataFrame, flag: str = "keyword_hit", stream: str = "stream", reference: str = REFERENCE
) -> DataFrame:
    rates = df.groupBy(stream).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("keyword_rate")
    )
    ref = _reference_row(stream, reference, ["keyword_rate"]).getField("keyword_rate")
    return rates.withColumn("reference_keyword_rate", ref).withColumn(
        "keyword_diff", F.col("keyword_rate") - F.col("reference_keyword_rate")
    )


def decide(
    stats: DataFrame,
    psi_limit: Column | float = lx.PSI_LIMIT,
    ks_limit: Column | float = lx.KS_P_LIMIT,
    keyword_limit: Column | float = lx.KEYWORD_DRIFT_LIMIT,
) -> DataFrame:
    """Trigger flags, their short codes, and the decision (any trigger)."""
    as_col = [v if isinstance(v, Column) else F.lit(v) for v in (psi_limit, ks_limit, keyword_limit)]
    out = stats.withColumns(
        drift.trigger_columns(F.col("psi"), F.col("ks_pvalue"), F.col("keyword_diff"), *as_col)
    )
    return _decided(out)


def with_triggers(stats: DataFrame, ks_trigger: Column) -> DataFrame:
    """The decision where KS is settled without a p-value of every row."""
    limits = (F.lit(lx.PSI_LIMIT), F.lit(lx.KS_P_LIMIT), F.lit(lx.KEYWORD_DRIFT_LIMIT))
    flags = drift.trigger_columns(F.col("psi"), F.lit(1.0), F.col("keyword_diff"), *limits) | {"ks_trigger": ks_trigger}
    return _decided(stats.withColumns(flags))


def _decided(flagged: DataFrame) -> DataFrame:
    p, k, w = (F.col(c) for c in ("psi_trigger", "ks_trigger", "keyword_trigger"))
    return flagged.withColumns({"shift_detected": p | k | w, "triggers": drift.trigger_codes(p, k, w)})


def stream_statistics(
    df: DataFrame,
    tau: float | None = None,
    stream: str = "stream",
    reference: str = REFERENCE,
    score: str = "router_score",
    length: str = "prompt_length",
    flag: str = "keyword_hit",
    label: str = "label",
    judge: str = "llm_prediction",
    bins: int = 10,
) -> DataFrame:
    """PSI, KS, keyword drift and (with ``tau``) both policies' counts, one row per stream.

    Bins, keyword counts and policy counts share one pass over the rows; the KS ladder is
    the only other one.
    """
    edges = reference_edges(df.filter(F.col(stream) == reference), score, bins)
    rows = df.withColumn("_edges", edges)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        bin_counts(F.col(score), F.col("_edges"), bins).alias("_bins"),
        F.avg(F.col(flag).cast("double")).alias("keyword_rate"),
    ]
    if tau is not None:
        y, s, j = F.col(label), F.col(score), F.col(judge)
        aggs.append(F.count_if(y == 1).alias("positives"))
        aggs += policy_counts(y, s, j, tau, "naive_")
        aggs += policy_counts(y, s, j, F.lit(float("-inf")), "safe_")
    stats = rows.groupBy(stream).agg(*aggs)
    ref = _reference_row(stream, reference, ["n", "_bins", "keyword_rate"])
    stats = stats.withColumn("_ref", ref).filter(F.col(stream) != reference)
    stats = stats.withColumns(
        {
            "psi": psi(F.col("_bins"), F.col("n"), F.col("_ref._bins"), F.col("_ref.n"), bins),
            "keyword_diff": F.col("keyword_rate") - F.col("_ref.keyword_rate"),
        }
    ).drop("_ref", "_bins")
    ks = ks_by_stream(df, length, stream, reference).select(stream, "ks_statistic", "ks_pvalue")
    return stats.join(ks, stream)


def fail_safe_figures(decided: DataFrame) -> DataFrame:
    """Turn the shared counts into naive and monitored figures.

    A triggered stream takes the judge-only counts, so it bypasses nothing.
    """
    counts = ["bypass_count", "false_bypass_count", "tn", "fp", "fn", "tp"]
    both = [f"{p}_{c}" for p in ("naive", "safe") for c in counts]
    naive = [F.col(f"naive_{c}").alias(c) for c in counts]
    monitored = [
        F.when(F.col("shift_detected"), F.col(f"safe_{c}")).otherwise(F.col(f"naive_{c}")).alias(c) for c in counts
    ]
    policies = F.array(
        F.struct(F.lit("naive").alias("policy"), *naive), F.struct(F.lit("fail_safe").alias("policy"), *monitored)
    )
    return rated_policy(decided.select("*", F.inline(policies)).drop(*both))


def shift_failsafe(df: DataFrame, tau: float = lx.DEPLOYED_TAU, **columns) -> DataFrame:
    """Monitor decision plus naive and fail-safe policy rows for every stream."""
    return fail_safe_figures(decide(stream_statistics(df, tau, **columns)))


def psi_sensitivity(
    df: DataFrame, tau: float = lx.DEPLOYED_TAU, limits: Sequence[float] = tuple(lx.PSI_GRID), **columns
) -> DataFrame:
    """Decision and final figures per stream and PSI limit; statistics are computed once."""
    stats = stream_statistics(df, tau, **columns)
    grid = stats.withColumn("psi_limit", F.explode(F.array(*[F.lit(v) for v in limits])))
    decided = decide(grid, psi_limit=F.col("psi_limit"))
    n, positives = F.col("n"), F.col("positives")

    def rate(count: str) -> Column:
        return F.try_divide(count, positives)

    shift = F.col("shift_detected")
    naive_cut = F.col("naive_bypass_count") / n
    return decided.withColumns(
        {
            "naive_call_reduction": naive_cut,
            "naive_false_bypass_rate": rate(F.col("naive_false_bypass_count")),
            "final_call_reduction": F.when(shift, 0.0).otherwise(naive_cut),
            "final_false_bypass_rate": rate(F.when(shift, 0).otherwise(F.col("naive_false_bypass_count"))),
        }
    )
