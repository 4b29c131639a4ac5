"""Keyed alignment of records, labels, scores and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.rates import confusion_counts, with_rates


def unique(df: DataFrame, key: str) -> DataFrame:
    """One row per key; a key with several rows fails the job, null keys go (they match nothing).

    A join to this table can't multiply rows.
    """
    fields = [c for c in df.columns if c != key]
    message = F.concat(F.lit("several rows for "), F.col(key).cast("string"))
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.any_value(F.struct(*fields)).alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    one = grouped.select(key, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_v")).alias("_v"))
    return one.select(key, "_v.*")


def _same_label(label: str) -> Column:
    """True when both labels are there and equal."""
    return F.col(label).isNotNull() & F.col("_label").eqNullSafe(F.col(label))


def alignment_faults(records: DataFrame, table: DataFrame, key: str = "sample_id", label: str = "label") -> DataFrame:
    """Count of records, of records without a table row, and of differing labels."""
    found = table.select(key, F.col(label).alias("_label"), F.lit(True).alias("_found"))
    return records.join(found, key, "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_found").isNull()).alias("missing"),
        F.count_if(F.col("_found") & ~_same_label(label)).alias("label_mismatch"),
    )


def align_records(records: DataFrame, table: DataFrame, key: str = "sample_id", label: str = "label") -> DataFrame:
    """Join records to their texts; a missing id, a doubled table id, or a differing or null label fails the job.

    The check sits in the rows themselves, so it needs no extra pass.
    """
    right = table.withColumnRenamed(label, "_label").withColumn("_found", F.lit(True))
    shared = [c for c in right.columns if c in records.columns and c != key]
    joined = records.join(unique(right.drop(*shared), key), key, "left")
    wrong = F.col("_found").isNull() | ~_same_label(label)
    message = F.concat(F.lit("record does not match the table: "), F.col(key).cast("string"))
    checked = F.when(wrong, F.raise_error(message).cast("int")).otherwise(F.col(label))
    return joined.withColumn(label, checked).drop("_label", "_found")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key (a rerun replaces an older answer); combines map-side."""
    fields = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_v")).select(key, "_v.*")


def judge_lookup(
    rows: DataFrame,
    base: DataFrame,
    fresh: DataFrame,
    key: str = "sample_id",
    judge: str = "llm_prediction",
    own_label: bool = True,
    order: str | None = None,
) -> DataFrame:
    """Judge answer per row: fresh over base over (optionally) the row's own.

    Of several answers for an id the last by ``order`` counts; without ``order`` they fail the job.
    ``label_origin`` tells which one was used; without own answers a missing id stays null
    with origin ``missing``, for the caller to reject.
    """
    def answers(table: DataFrame, name: str) -> DataFrame:
        one = unique(table.select(key, judge), key) if order is None else latest(table.select(key, judge, order), key, order)
        return one.select(key, F.col(judge).alias(name))

    own = F.col(judge) if own_label and judge in rows.columns else F.lit(None).cast("int")
    looked = (
        rows.withColumn("_own", own)
        .drop(judge)
        .join(answers(base, "_base"), key, "left")
        .join(answers(fresh, "_fresh"), key, "left")
    )
    origin = (
        F.when(F.col("_fresh").isNotNull(), "fresh")
        .when(F.col("_base").isNotNull(), "base")
        .when(F.col("_own").isNotNull(), "own")
        .otherwise("missing")
    )
    return looked.withColumns(
        {judge: F.coalesce("_fresh", "_base", "_own"), "label_origin": origin}
    ).drop("_own", "_base", "_fresh")


def flag_members(df: DataFrame, ids: DataFrame, name: str, key: str = "sample_id") -> DataFrame:
    marked = ids.select(key).distinct().withColumn("_in", F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def id_union(parts: Sequence[DataFrame], key: str = "sample_id") -> DataFrame:
    out = parts[0].select(key)
    for part in parts[1:]:
        out = out.unionByName(part.select(key))
    return out.distinct()


def pending_rows(candidates: DataFrame, done: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Rows still to be judged or embedded; key on (id, text hash) to notice changed texts.

    A record with an error or without an answer isn't done: its row is pending again.
    """
    if "error" in done.columns:
        done = done.filter("error IS NULL")
    if "llm_prediction" in done.columns:
        done = done.filter("llm_prediction IS NOT NULL")
    return candidates.join(done.select(*keys), list(keys), "left_anti")


def merge_attempts(pool: DataFrame, judged: DataFrame, key: str = "sample_id") -> DataFrame:
    """Pool rows with the judged row's fields on top; a pool id without a judged row, or with several, fails."""
    over = [c for c in judged.columns if c != key]
    right = unique(judged, key).select(key, F.struct(*over).alias("_j"))
    joined = pool.join(right, key, "left")
    message = F.concat(F.lit("no judged row for "), F.col(key).cast("string"))
    present = joined.withColumn(
        key, F.when(F.col("_j").isNull(), F.raise_error(message).cast("string")).otherwise(F.col(key))
    )
    merged = {c: F.coalesce(F.col(f"_j.{c}"), F.col(c)) if c in pool.columns else F.col(f"_j.{c}") for c in over}
    return present.withColumns(merged).drop("_j")


def replace_scores(records: DataFrame, scores: DataFrame, key: str = "sample_id", score: str = "router_score") -> DataFrame:
    """Records with a new router score; every record must have exactly one."""
    new = unique(scores.select(key, F.col(score).alias("_new")), key)
    joined = records.join(new, key, "left")
    message = F.concat(F.lit("no score for "), F.col(key).cast("string"))
    value = F.when(F.col("_new").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("_new"))
    return joined.withColumn(score, value).drop("_new")


def same_subset(
    judged: DataFrame,
    scores: DataFrame,
    thresholds: DataFrame,
    key: str = "sample_id",
    label: str = "label",
    judge: str = "llm_prediction",
    subset: str = "subset",
) -> DataFrame:
    """Detectors and judge on exactly the judged ids.

    ``scores``: (id, detector, score) in long form.  ``thresholds``: (detector, threshold
    name, threshold), a few rows.  Both kinds of answers end in one grouped count.
    """
    rows = judged.select(subset, key, F.col(label).alias("_y"), F.col(judge).alias("_j"))
    policy = thresholds.select("detector", "threshold_name", "threshold")
    detector_rows = (
        rows.drop("_j")
        .join(scores.select(key, "detector", "score"), key)
        .join(policy, "detector")
        .select(subset, "detector", "threshold_name", "_y", (F.col("score") >= F.col("threshold")).cast("int").alias("_p"))
    )
    judge_rows = rows.select(
        subset, F.lit("judge").alias("detector"), F.lit("--").alias("threshold_name"), "_y", F.col("_j").alias("_p")
    )
    answers = detector_rows.unionByName(judge_rows)
    counted = answers.groupBy(subset, "detector", "threshold_name").agg(
        F.count(F.lit(1)).alias("n"), *confusion_counts(F.col("_y"), F.col("_p"))
    )
    return with_rates(counted, ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1"])


def embedding_coverage(table: DataFrame, vectors: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows with and without a vector, vectors without a row, and the vector dimensions."""
    have = vectors.select(key, F.size("embedding").alias("_dim"))
    both = table.select(key, F.lit(1).alias("_row")).join(have, key, "full")
    return both.agg(
        F.count("_row").alias("n_rows"),
        F.count("_dim").alias("n_vectors"),
        F.count_if(F.col("_row").isNotNull() & F.col("_dim").isNull()).alias("rows_without_vector"),
        F.count_if(F.col("_row").isNull()).alias("vectors_without_row"),
        F.min("_dim").alias("min_dim"),
        F.max("_dim").alias("max_dim"),
    )


