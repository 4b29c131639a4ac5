"""Rates of a confusion matrix, from its four counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(label: Column, predicted: Column) -> list[Column]:
    """The four counts as aggregate columns tn, fp, fn, tp."""

    def cell(y: int, p: int, name: str) -> Column:
        return F.count_if((label == y) & (predicted == p)).alias(name)

    return [cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp")]


def weighted_confusion(label: Column, predicted: Column, n: Column) -> list[Column]:
    """Same four counts when each input row already stands for ``n`` rows."""

    def cell(y: int, p: int, name: str) -> Column:
        return F.sum(F.when((label == y) & (predicted == p), n).otherwise(0)).alias(name)

    return [cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp")]


def ratio(num: Column, den: Column) -> Column:
    """num / den, with 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def rate_columns(tn: str = "tn", fp: str = "fp", fn: str = "fn", tp: str = "tp") -> dict[str, Column]:
    tn_, fp_, fn_, tp_ = (F.col(c) for c in (tn, fp, fn, tp))
    pos, neg, total = fn_ + tp_, tn_ + fp_, tn_ + fp_ + fn_ + tp_
    recall, specificity = ratio(tp_, pos), ratio(tn_, neg)
    balanced = (
        F.when(pos == 0, specificity).when(neg == 0, recall).otherwise((recall + specificity) / 2.0)
    )
    return {
        "accuracy": ratio(tn_ + tp_, total),
        "balanced_accuracy": balanced,
        "precision": ratio(tp_, tp_ + fp_),
        "recall": recall,
        "specificity": specificity,
        "fpr": ratio(fp_, neg),
        "fnr": ratio(fn_, pos),
        "f1": ratio(2 * tp_, 2 * tp_ + fp_ + fn_),
        "positive_rate": ratio(tp_ + fp_, total),
    }


def with_rates(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Append the rates (all, or the named ones) to a frame with the four counts."""
    cols = rate_columns()
    return df.withColumns({k: v for k, v in cols.items() if names is None or k in names})
