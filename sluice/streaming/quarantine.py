"""Session quarantine on a stream.

The only state a session needs is the attempt number of its first catch.  Catches are a
small part of the rows (bypassed, audited and judged positive), so only they are keyed to
sessions; ordinary attempts never pile up behind a hot session.  The state is one keyed
value per session, kept by Spark's state store, forgotten by TTL or by a timer once a
session has been quiet, and read back as a table where rows are flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.operators.sessions import caught, flag_after
from sluice.streaming.run import drain_batches

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE_CLASS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "first_catch"


class FirstCatch(StatefulProcessor):
    """Emit a session's catch when it is the first, or earlier than the one on record.

    ``ttl_ms`` bounds, by the clock, how long a catch counts after it was last written.  ``quiet_ms`` sets
    a timer in event time with every catch: a session is forgotten when the watermark is that far past its
    last one (column ``time``).
    """

    def __init__(self, ttl_ms: int | None = None, quiet_ms: int | None = None, time: str | None = None) -> None:
        self.ttl_ms, self.quiet_ms, self.time = ttl_ms, quiet_ms, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState(STATE, "attempt bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lowest, last = None, None
        for chunk in rows:
            least = int(chunk["attempt_no"].min())
            lowest = least if lowest is None else min(lowest, least)
            if self.quiet_ms:
                latest = int(chunk[self.time].max().timestamp() * 1000)
                last = latest if last is None else max(last, latest)
        if self.quiet_ms:
            due = last + self.quiet_ms
            for timer in list(self.handle.listTimers()):
                due = max(due, timer)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        known = self.first.get() if self.first.exists() else None
        if known is None or lowest < known[0]:
            self.first.update((lowest,))
            yield pd.DataFrame({"session_id": [key[0]], "first_catch": [lowest]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        yield pd.DataFrame({"session_id": pd.Series([], dtype="int64"), "first_catch": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def first_catch_stream(
    hits: DataFrame, ttl_ms: int | None = None, quiet_ms: int | None = None, time: str = "ts", delay: str = "1 hour"
) -> DataFrame:
    """(session, first catch) decisions of a stream of catches; needs the RocksDB state store.

    ``ttl_ms`` is for queries that keep running: Spark checks the clock in batches without data too, so
    a run that should end with its data never does.  ``quiet_ms`` needs the event time of the catches.
    """
    if ttl_ms and quiet_ms:
        raise ValueError("a state is forgotten by the clock or by event time, not both")
    timed = hits.withWatermark(time, delay) if quiet_ms else hits
    return timed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=FirstCatch(ttl_ms, quiet_ms, time),
        outputStructType=f"session_id {hits.schema['session_id'].dataType.simpleString()}, first_catch bigint",
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "EventTime" if quiet_ms else "None",
    )


def catch_stream(stream: DataFrame, tau: float, ttl_ms: int | None = None) -> DataFrame:
    """(session, first catch) decisions as they are made; needs the RocksDB state store."""
    hit = caught(F.col("router_score"), tau, F.col("audited"), F.col("llm_prediction"))
    return first_catch_stream(stream.filter(hit).select("session_id", "attempt_no"), ttl_ms)


def known_catches(spark: SparkSession, progress: str) -> DataFrame:
    """(session_id, first_catch): the state of a finished run of ``first_catch_stream``, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(progress)
    return state.select("key.session_id", F.col("value.attempt").alias("first_catch"))


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state needs, for as long as queries are started."""
    before = spark.conf.get(STORE_KEY, None)
    spark.conf.set(STORE_KEY, STORE_CLASS)
    try:
        yield
    finally:
        spark.conf.unset(STORE_KEY) if before is None else spark.conf.set(STORE_KEY, before)


def run_quarantine(
    stream: DataFrame, tau: float, path: str, quiet_ms: int | None = None, time: str = "ts", delay: str = "1 hour"
) -> None:
    """Flag every attempt against the catches known so far, batch by batch.

    The catches of a batch go into the keyed state, and the batch's rows meet the state as a table, hot
    sessions apart.  A batch costs its own rows and the sessions under quarantine, however many batches
    came before: the state is one row per session, and files of catches go once they are in it.  A
    repeated batch brings the same catches again, which changes nothing.  Attempts that arrive after
    later ones of their session are judged against what is known then.
    """
    hit = caught(F.col("router_score"), tau, F.col("audited"), F.col("llm_prediction"))

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hits = batch.filter(hit).select("session_id", "attempt_no", *([time] if quiet_ms else []))
        hits.write.mode("overwrite").parquet(f"{path}/hits/batch={number}")
        source = spark.readStream.schema(hits.schema).option("recursiveFileLookup", True).option("cleanSource", "delete")
        with state_store(spark):
            decisions = first_catch_stream(source.parquet(f"{path}/hits"), None, quiet_ms, time, delay)
            writer = decisions.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{path}/catching")
            writer.trigger(availableNow=True).start().awaitTermination()
        flagged = flag_after(batch, known_catches(spark, f"{path}/catching"))
        flagged.write.mode("overwrite").parquet(f"{path}/flagged/batch={number}")

    drain_batches(stream, handle, path)
