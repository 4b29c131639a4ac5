"""Escalation gates: named rules that send a bypassed row to the judge anyway."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import lexicons as lx
from sluice.functions import text as tx
from sluice.functions.rates import ratio
from sluice.operators.prefix import exact_quantiles
from sluice.session import stored

Gate = Callable[[Column, Column], Column]


def gate_registry(
    known_prefix: str,
    lexicon: Sequence[str] = (),
    density_threshold: Column | float = 0.0,
    tau: float = lx.DEPLOYED_TAU,
    words: Sequence[str] = tuple(lx.MONITOR_WORDS),
) -> dict[str, Gate]:
    """The nine built-in gates, each a function of (prompt, score) columns.

    Callers add their own by extending the dict.
    """
    known = known_prefix.strip()

    def starts(p: Column, s: Column) -> Column:
        return p.startswith(known)

    def dense(p: Column, s: Column) -> Column:
        return tx.lexicon_density(p, lexicon) > density_threshold

    def tail_word(p: Column, s: Column) -> Column:
        return tx.keyword_hit(tx.tail(p), words)

    def ultra_low(p: Column, s: Column) -> Column:
        return s < lx.ULTRA_LOW_SCORE

    return {
        "baseline_np_triage": lambda p, s: F.lit(False),
        "padding_prefix_fingerprint": starts,
        "benign_weight_density_gate": dense,
        "tail_keyword_gate": tail_word,
        "ultra_low_score_gate": ultra_low,
        "long_prompt_low_score": lambda p, s: (F.length(p) > lx.LONG_PROMPT_CHARS) & (s <= tau),
        "padding_or_tail_keyword": lambda p, s: starts(p, s) | tail_word(p, s),
        "padding_or_ultra_low": lambda p, s: starts(p, s) | ultra_low(p, s),
        "audit_all_bypass_malicious_tail": lambda p, s: tail_word(p, s) & (s <= tau),
    }


def evaluate_gates(
    df: DataFrame,
    gates: dict[str, Gate],
    tau: float = lx.DEPLOYED_TAU,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "router_score",
    judge: str = "llm_prediction",
    adaptive: str = "is_adaptive",
    prompt: str = "prompt",
) -> DataFrame:
    """All gates in one pass over the texts.

    Rows are first counted per combination of flags (at most a few thousand, whatever the
    table size); only that table is unfolded to one row per gate.
    """
    names = list(gates)
    flags = [gates[g](F.col(prompt), F.col(score)).alias(f"_g{i}") for i, g in enumerate(names)]
    cells = (
        df.select(
            *groups,
            (F.col(label) == 1).alias("_pos"),
            (F.col(judge) == 1).alias("_judge"),
            F.col(adaptive).alias("_adaptive"),
            (F.col(score) <= tau).alias("_by"),
            *flags,
        )
        .groupBy(*groups, "_pos", "_judge", "_adaptive", "_by", *[f"_g{i}" for i in range(len(names))])
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    unfolded = cells.select(
        *groups, "_pos", "_judge", "_adaptive", "_by", "_n",
        F.explode(
            F.array(
                *[F.struct(F.lit(g).alias("gate"), F.col(f"_g{i}").alias("up")) for i, g in enumerate(names)]
            )
        ).alias("_gate"),
    )
    up, adapt, pos, n = F.col("_gate.up"), F.col("_adaptive"), F.col("_pos"), F.col("_n")
    bypass = F.col("_by") & ~up
    caught = ~bypass & F.col("_judge")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    counted = unfolded.groupBy(*groups, F.col("_gate.gate").alias("gate")).agg(
        F.sum(n).alias("n"),
        total(bypass).alias("bypass_count"),
        total(adapt).alias("adaptive_total"),
        total(adapt & caught).alias("adaptive_caught"),
        total(adapt & up).alias("adaptive_escalated"),
        total(~adapt).alias("other_total"),
        total(~adapt & up).alias("extra_escalations"),
        total(~adapt & up & F.col("_by")).alias("extra_escalations_of_bypassed"),
        total(~pos).alias("negatives"),
        total(~pos & up).alias("negative_escalations"),
        total(~pos & caught).alias("false_positives"),
    )
    return counted.withColumns(
        {
            "call_rate": 1.0 - F.col("bypass_count") / F.col("n"),
            "cost_reduction": F.col("bypass_count") / F.col("n"),
            "adaptive_e2e_fn_rate": ratio(
                F.col("adaptive_total") - F.col("adaptive_caught"), F.col("adaptive_total")
            ),
            "extra_escalation_rate": ratio(F.col("extra_escalations"), F.col("other_total")),
            "stream_fpr": ratio(F.col("false_positives"), F.col("negatives")),
        }
    )


def density_calibration(
    df: DataFrame,
    lexicon: Sequence[str],
    percentile: float = 0.995,
    groups: Sequence[str] = (),
    prompt: str = "prompt",
) -> DataFrame:
    """Density threshold (a high percentile) and maximum over ordinary traffic.

    The texts are read once; the order statistics work on the stored numbers.
    """
    dense = stored(df.select(*groups, tx.lexicon_density(prompt, lexicon).alias("density")), "density")
    q = exact_quantiles(dense, "density", [percentile, 1.0], groups)
    return q.select(
        *groups, "n", F.col("quantiles")[0].alias("density_threshold"), F.col("quantiles")[1].alias("max_density")
    )


def root_cause(
    df: DataFrame,
    reference: DataFrame,
    tau: float = lx.DEPLOYED_TAU,
    rate: float = lx.AUDIT_RATE,
    words: Sequence[str] = tuple(lx.MONITOR_WORDS),
    adaptive: str = "is_adaptive",
    score: str = "router_score",
    judge: str = "llm_prediction",
    prompt: str = "prompt",
) -> DataFrame:
    """One row that tells which layer let a padded subgroup through."""
    adapt, s = F.col(adaptive), F.col(score)
    tail_hit = tx.keyword_hit(tx.tail(prompt), words)
    full_hit = tx.keyword_hit(prompt, words)
    by = s <= tau
    lead = F.when(adapt, F.sha2(tx.prefix(prompt), 256))
    row = df.agg(
        F.count_if(adapt).alias("adaptive_count"),
        F.avg(F.when(adapt, by.cast("double"))).alias("adaptive_bypass_rate"),
        F.max(F.when(adapt, s)).alias("adaptive_score_max"),
        (F.count_if(adapt) * F.lit(rate)).alias("expected_adaptive_audited"),
        ratio(F.count_if(adapt & by & (F.col(judge) == 0)), F.count_if(adapt & by)).alias(
            "counterfactual_miss_rate"
        ),
        F.count_distinct(lead).alias("unique_adaptive_prefixes"),
        F.avg(F.when(adapt, tail_hit.cast("double"))).alias("tail_keyword_rate_adaptive"),
        F.avg(F.when(~adapt, tail_hit.cast("double"))).alias("tail_keyword_rate_other"),
        F.avg(F.when(~adapt, full_hit.cast("double"))).alias("full_keyword_rate_other"),
    )
    rest = exact_quantiles(df.filter(~adapt), score, [0.05]).select(F.col("quantiles")[0])
    ref = exact_quantiles(reference, score, [0.05]).select(F.col("quantiles")[0])
    return row.withColumns({"other_score_p05": rest.scalar(), "reference_score_p05": ref.scalar()})
