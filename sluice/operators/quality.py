"""Detector quality, calibration and audit metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import lexicons as lx
from sluice.functions.draws import binomial_draw, poisson_draw
from sluice.functions.hashing import unit_bucket
from sluice.functions.rates import confusion_counts, with_rates
from sluice.functions.text import keyword_hit
from sluice.operators.prefix import counted_quantiles, exact_quantiles, running_sums
from sluice.session import stored

COUNTS = ["tn", "fp", "fn", "tp"]


def confusion(df: DataFrame, predicted: Column, groups: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Counts and rates per group; one map-side combined pass."""
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 0).alias("n_negatives"),
        *confusion_counts(F.col(label), predicted),
    )
    return with_rates(counted)


def label_counts(df: DataFrame, groups: Sequence[str] = (), label: str = "label") -> DataFrame:
    return df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n"))


def score_bin(score: Column, bins: int = 10) -> Column:
    """Equal-width bin on [0, 1]; the last bin is closed."""
    index = F.lit(0)
    for i in range(1, bins):
        index = index + (score >= F.lit(float(np.linspace(0.0, 1.0, bins + 1)[i]))).cast("int")
    return index


def calibration_error(
    df: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "router_score", bins: int = 10
) -> DataFrame:
    """Brier score and expected calibration error."""
    s, y = F.col(score), F.col(label)
    per_bin = df.groupBy(*groups, score_bin(s, bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(s).alias("_s"),
        F.sum(y).alias("_y"),
        F.sum((s - y) * (s - y)).alias("_se"),
    )
    n = F.sum("_n")
    gap = F.sum(F.abs(F.col("_s") / F.col("_n") - F.col("_y") / F.col("_n")) * F.col("_n"))
    return per_bin.groupBy(*groups).agg(
        n.alias("n"), (F.sum("_se") / n).alias("brier"), (gap / n).alias("ece")
    )


def score_ladder(
    df: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "router_score"
) -> DataFrame:
    """One row per distinct score: rows, positives and their ascending running sums."""
    per_score = df.groupBy(*groups, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    return running_sums(per_score, [score], ["n", "pos"], groups)


def ranking_quality(
    df: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "router_score"
) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null unless both classes occur."""
    rows = score_ladder(df, groups, label, score)
    neg = F.col("n") - F.col("pos")
    neg_below = F.col("cum_n") - F.col("cum_pos") - neg
    found = F.col("total_pos") - (F.col("cum_pos") - F.col("pos"))
    flagged = F.col("total_n") - (F.col("cum_n") - F.col("n"))
    summed = rows.groupBy(*groups).agg(
        F.max("total_n").alias("n"),
        F.max("total_pos").alias("positives"),
        F.sum(F.col("pos") * (neg_below + neg / 2.0)).alias("_wins"),
        F.sum(F.col("pos") * (found / flagged)).alias("_ap"),
    )
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    both = (p > 0) & (q > 0)
    return summed.select(
        *groups,
        "n",
        "positives",
        F.when(both, F.col("_wins") / p / q).alias("roc_auc"),
        F.when(both, F.col("_ap") / p).alias("average_precision"),
    )


def score_summary(
    df: DataFrame,
    value: str = "router_score",
    groups: Sequence[str] = (),
    probs: Sequence[float] = (0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0),
    names: Sequence[str] = ("min", "p01", "p05", "p50", "p95", "p99", "max"),
    taus: Sequence[float] = (0.01, lx.DEPLOYED_TAU, 0.03),
) -> DataFrame:
    """Exact quantiles and the bypass rate at a few thresholds."""
    groups = list(groups)
    spread = exact_quantiles(df, value, probs, groups)
    spread = spread.select(*groups, "n", *[F.col("quantiles")[i].alias(m) for i, m in enumerate(names)])
    rates = df.groupBy(*groups).agg(
        *[
            (F.count_if(F.col(value) <= t) / F.count(F.lit(1))).alias(f"bypass_rate_{i}")
            for i, t in enumerate(taus)
        ]
    )
    if groups:
        return spread.join(rates, groups)
    return spread.withColumn("_r", rates.select(F.struct("*")).scalar()).select("*", "_r.*").drop("_r")


def dataset_audit(df: DataFrame, words: Sequence[str] = tuple(lx.AUDIT_WORDS)) -> DataFrame:
    """Size, duplicates, lengths and keyword rate by dataset, by label and by split.

    Long form: ``level`` is ``dataset``, ``label`` or ``split`` and ``member`` the value.
    Duplicate texts are counted over digests, so the texts themselves are not shuffled.
    """
    counted = df.select(
        "dataset",
        "split",
        "label",
        F.sha2("prompt", 256).alias("_digest"),
        F.length("prompt").alias("chars"),
        keyword_hit("prompt", words).cast("int").alias("_hit"),
    )
    # One read of the texts: what follows reads this narrow table of distinct rows.
    rows = stored(counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("rows")), "audit")
    cells = rows.groupBy("dataset", "split", "label").agg(
        F.sum("rows").alias("n"),
        F.sum(F.col("_hit") * F.col("rows")).alias("_hits"),
        F.sum(F.col("chars") * F.col("rows")).alias("_chars"),
    )
    dataset, split, label = (F.col(c) for c in ("dataset", "split", "label"))
    sets = cells.groupingSets([["dataset"], ["dataset", "label"], ["dataset", "split"]], "dataset", "label", "split").agg(
        F.grouping("label").alias("_no_label"),
        F.grouping("split").alias("_no_split"),
        F.sum("n").alias("n"),
        (F.sum("_hits") / F.sum("n")).alias("keyword_hit_rate"),
        (F.sum("_chars") / F.sum("n")).alias("mean_chars"),
    )
    of_label, of_split = F.col("_no_label") == 0, F.col("_no_split") == 0
    by_level = sets.select(
        "dataset",
        F.when(of_label, "label").when(of_split, "split").otherwise("dataset").alias("level"),
        F.when(of_label, label.cast("string")).when(of_split, split).otherwise(dataset).alias("member"),
        "n", "keyword_hit_rate", "mean_chars",
    )
    digests = rows.groupBy("dataset", "_digest").agg(F.sum("rows").alias("_n"))
    copies = digests.groupBy("dataset").agg((1.0 - F.count("_digest") / F.sum("_n")).alias("duplicate_prompt_rate"))
    copies = copies.select(
        "dataset", F.lit("dataset").alias("level"), F.col("dataset").alias("member"), "duplicate_prompt_rate"
    )
    lengths = rows.groupBy("dataset", "label", "chars").agg(F.sum("rows").alias("n")).filter("chars is not null")
    tagged = lengths.select(
        "dataset",
        F.explode(
            F.array(
                F.struct(F.lit("dataset").alias("level"), dataset.alias("member")),
                F.struct(F.lit("label").alias("level"), label.cast("string").alias("member")),
            )
        ).alias("_at"),
        "chars", "n",
    ).select("dataset", "_at.level", "_at.member", "chars", "n")
    keys = ["dataset", "level", "member"]
    merged = tagged.groupBy(*keys, "chars").agg(F.sum("n").alias("n"))
    spread = counted_quantiles(merged, "chars", [0.5, 0.95], keys).select(
        *keys, F.col("quantiles")[0].alias("median_chars"), F.col("quantiles")[1].alias("p95_chars")
    )
    return by_level.join(copies, keys, "left").join(spread, keys, "left")


def usage_totals(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Token sums over newly judged rows and the number of reused rows."""
    fields = ["prompt_tokens", "completion_tokens", "total_tokens"]
    return df.groupBy(*groups).agg(
        *[F.coalesce(F.sum(f"usage.{f}"), F.lit(0)).alias(f) for f in fields],
        F.count_if("reused").alias("reused_records"),
        F.count(F.lit(1)).alias("n"),
    )


BOOT_METRICS = ["accuracy", "precision", "recall", "f1", "fpr"]


def _interval(replicates: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean and 95 % bounds over replicates; a fixed number of rows per group."""
    rated = with_rates(replicates, BOOT_METRICS)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in BOOT_METRICS])
    )
    return (
        rated.select(*groups, pairs.alias("_p"))
        .groupBy(*groups, F.col("_p.metric").alias("metric"))
        .agg(
            F.avg("_p.value").alias("mean"),
            F.percentile("_p.value", F.lit(0.025)).alias("ci95_low"),
            F.percentile("_p.value", F.lit(0.975)).alias("ci95_high"),
        )
    )


def _replicates(df: DataFrame, predicted: Column, groups: Sequence[str], seed: int, replicates: int, label: str) -> DataFrame:
    """The confusion counts of every group, once per replicate, with a uniform number for each count (``_u0`` ...)."""
    counted = df.groupBy(*groups).agg(*confusion_counts(F.col(label), predicted))
    spread = counted.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    name = F.concat_ws("|", *(F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups), F.lit(f"boot:{seed}"), F.col("replicate").cast("string"))
    return spread.withColumns({f"_u{i}": unit_bucket(F.concat(name, F.lit(f"|{c}"))) for i, c in enumerate(COUNTS)})


def bootstrap_ci(
    df: DataFrame, predicted: Column, groups: Sequence[str], seed: int, replicates: int = 500, label: str = "label"
) -> DataFrame:
    """Resample-with-replacement intervals from one pass over the rows.

    The metrics depend on the four confusion counts only, and resampling n rows with replacement draws
    those counts from a multinomial: each count is binomial in what the ones before it have left.  So
    the rows are counted once, and the draws are columns over groups x replicates.
    """
    groups = list(groups)
    spread = _replicates(df, predicted, groups, seed, replicates, label)
    whole, left = spread, sum((F.col(c) for c in COUNTS), F.lit(0))
    whole = whole.withColumns({"_rows": left, "_left": left})
    for i, c in enumerate(COUNTS[:-1]):
        drawn = binomial_draw(F.col(f"_u{i}"), F.col("_left"), F.try_divide(F.col(c), F.col("_rows")))
        whole = whole.withColumn(f"_d{i}", F.coalesce(drawn, F.lit(0).cast("bigint")))
        whole = whole.withColumns({"_rows": F.col("_rows") - F.col(c), "_left": F.col("_left") - F.col(f"_d{i}")})
    last = len(COUNTS) - 1
    drawn = [F.col(f"_d{i}").alias(c) for i, c in enumerate(COUNTS[:-1])] + [F.col("_left").alias(COUNTS[last])]
    return _interval(whole.select(*groups, *drawn), groups)


def bootstrap_ci_poisson(
    df: DataFrame, predicted: Column, groups: Sequence[str], seed: int, replicates: int = 500, label: str = "label"
) -> DataFrame:
    """Poisson bootstrap: every row weighs Poisson(1), so a count of c rows weighs Poisson(c), drawn as one number."""
    groups = list(groups)
    spread = _replicates(df, predicted, groups, seed, replicates, label)
    drawn = spread.select(*groups, *(poisson_draw(F.col(f"_u{i}"), F.col(c)).alias(c) for i, c in enumerate(COUNTS)))
    return _interval(drawn, groups)
