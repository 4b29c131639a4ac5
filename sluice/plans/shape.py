"""One column specification per query, applied to the Spark result and to its SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# s string, i bigint, f double rounded to six digits, b boolean, t time as text.


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def rounded(c: Column) -> Column:
    """``F.round(c, 6)``, which goes through decimal numbers as text only for values near a tie, or large ones."""
    millionths = c * 1e6
    low = F.floor(millionths)
    plain = (F.abs(millionths) < 1e9) & (F.abs(millionths - low - 0.5) > 1e-4)
    return F.when(plain, F.floor(millionths + 0.5).cast("double") / 1e6).otherwise(F.round(c, 6))


def shaped(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in parse(spec):
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "f":
            c = rounded(c.cast("double"))
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(sql: str, spec: str) -> str:
    forms = {
        "s": "CAST({0} AS VARCHAR)",
        "i": "CAST({0} AS BIGINT)",
        "f": "round(CAST({0} AS DOUBLE), 6) + 0.0",
        "b": "CAST({0} AS BOOLEAN)",
        "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
    }
    cols = ", ".join(f"{forms[kind].format(name)} AS {name}" for name, kind in parse(spec))
    return f"SELECT {cols} FROM (\n{sql}\n) AS result"
