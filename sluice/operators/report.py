"""Formatted metric rows from several figures tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _fixed(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Fixed decimals by the exact binary value, for the few rows of a report."""
    return pd.Series([None if pd.isna(v) else f"{v:.{int(d)}f}" for v, d in zip(value, digits)], dtype=object)


def number(value: Column, digits: int = 3) -> Column:
    """Fixed decimals; ``--`` for null."""
    return F.coalesce(_fixed(value.cast("double"), F.lit(digits)), F.lit("--"))


def percent(value: Column) -> Column:
    return F.coalesce(F.concat(_fixed(value.cast("double") * 100.0, F.lit(1)), F.lit("%")), F.lit("--"))


def confusion_text() -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in ("tn", "fp", "fn", "tp")])


def false_bypass_text(count: Column, rate: Column) -> Column:
    """``n (p%)``, or ``--`` when there are no positives."""
    shown = F.concat(count.cast("string"), F.lit(" ("), percent(rate), F.lit(")"))
    return F.when(rate.isNull(), F.lit("--")).otherwise(shown)


def metric_rows(figures: DataFrame, section: str, name: Column) -> DataFrame:
    """Quality rows of one report section."""
    return figures.select(
        F.lit(section).alias("section"),
        name.alias("name"),
        *[number(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")],
        confusion_text().alias("confusion"),
        F.lit("--").alias("call_reduction"),
        F.lit("--").alias("call_rate"),
        F.lit("--").alias("triggers"),
        F.lit("--").alias("false_bypass"),
    )


def policy_rows(figures: DataFrame, section: str, name: Column, triggers: Column | None = None) -> DataFrame:
    """Cascade rows of one report section."""
    return figures.select(
        F.lit(section).alias("section"),
        name.alias("name"),
        *[number(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")],
        confusion_text().alias("confusion"),
        percent(F.col("cost_reduction")).alias("call_reduction"),
        percent(F.col("call_rate")).alias("call_rate"),
        (F.lit("off") if triggers is None else triggers).alias("triggers"),
        false_bypass_text(F.col("false_bypass_count"), F.col("false_bypass_rate")).alias("false_bypass"),
    )


def note_rows(figures: DataFrame, section: str, name: Column, reduction: Column | None, note: Column) -> DataFrame:
    """Rows whose message is a short text: gates, audits, sessions, error categories."""
    dash = F.lit("--")
    return figures.select(
        F.lit(section).alias("section"),
        name.alias("name"),
        *[dash.alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1", "confusion")],
        (dash if reduction is None else percent(reduction)).alias("call_reduction"),
        *[dash.alias(c) for c in ("call_rate", "triggers", "false_bypass")],
        note.alias("note"),
    )


def caught_text(caught: Column, total: Column, miss_rate: Column) -> Column:
    """``caught/total, p% missed``."""
    return F.concat(
        caught.cast("string"), F.lit("/"), total.cast("string"), F.lit(", "), percent(miss_rate), F.lit(" missed")
    )


#: A part of a note: a text as it is, or a column with its form: i whole number or text, n three decimals, p percent.
Part = str | tuple[str, str]


def note_text(parts: list[Part]) -> Column:
    """A note from texts and columns; ``--`` for null figures."""
    shown = {"i": lambda c: F.coalesce(c.cast("string"), F.lit("--")), "n": number, "p": percent}
    return F.concat(*(F.lit(p) if isinstance(p, str) else shown[p[1]](F.col(p[0])) for p in parts))


def report_table(parts: dict[str, DataFrame | None]) -> DataFrame:
    """Stack the sections; a section without input is one row that says so."""
    present = [p for p in parts.values() if p is not None]
    if not present:
        raise ValueError("no report section has any input")
    full = [p if "note" in p.columns else p.withColumn("note", F.lit("--")) for p in present]
    table = full[0]
    for part in full[1:]:
        table = table.unionByName(part)
    missing = [name for name, p in parts.items() if p is None]
    if missing:
        dashes = [F.lit("--").alias(c) for c in table.columns if c not in ("section", "name", "note")]
        names = F.explode(F.array(*map(F.lit, missing))).alias("section")
        rows = table.sparkSession.range(1).select(names, F.lit("missing").alias("name"), *dashes, F.lit("no input").alias("note"))
        table = table.unionByName(rows)
    return table
