"""Registration of queries: a Spark function, a column specification, and optional SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sluice.plans.shape import shaped, shaped_sql

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    spec: str
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shaped(self.build(spark, sf_dir), self.spec)

    def oracle(self) -> str | None:
        return None if self.sql is None else shaped_sql(self.sql, self.spec)


ENTRIES: dict[str, Entry] = {}


def query(name: str, spec: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(build, spec, sql)
        return build

    return register
