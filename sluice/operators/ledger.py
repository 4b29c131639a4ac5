"""A ledger of paid calls: answers by (id, text hash), kept per task, so that nothing is paid twice.

Calls run in tasks of at most ``calls_per_task`` rows, and what a task has paid is in the ledger as soon as
the task ends (its files are moved when the task commits, not when the job does).  A job that fails later,
a second action on the result, or a later run finds these answers and pays only for the rest; an executor
that is lost costs the calls of the tasks it was at.  A changed text has another hash and is paid for anew; a null text is the empty one.
Answers that came with an error count as not given.  The result is read from the ledger, never computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import truncate
from sluice.operators import judge as ju

KEY = ["sample_id", "text_hash"]
#: Fixed value: the committer that moves a task's files when the task commits.
BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


class Ledger:
    """Answers under ``path``; ``answer`` is the DDL of an answer's columns, ``given`` the one that is null without an answer."""

    def __init__(self, spark: SparkSession, path: str, answer: str, given: str):
        self.spark, self.path, self.given = spark, path, given
        self.schema = f"sample_id string, text_hash string, run bigint, {answer}"
        self.columns = [f.name for f in spark.createDataFrame([], answer).schema]
        spark.createDataFrame([], self.schema).write.mode("append").parquet(path)

    def rows(self) -> DataFrame:
        """Everything on record, also answers with errors and what a repeated task wrote twice."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def answers(self) -> DataFrame:
        """One row per key: an answer of the first run that gave one, else the last error."""
        given = F.col(self.given).isNotNull()
        found = F.struct("run", *self.columns)
        best = F.min_by(found, F.struct((~given).alias("missing"), F.when(given, F.col("run")).otherwise(-F.col("run"))))
        return self.rows().groupBy(*KEY).agg(best.alias("a")).select(*KEY, "a.*")

    def settle(
        self, df: DataFrame, call: Callable[[DataFrame], DataFrame], text: str, max_chars: int, calls_per_task: int, reused: str = "reused"
    ) -> DataFrame:
        """Pay for the rows of df that have no answer yet, and return df's rows (without the text) with their answers.

        ``call`` turns (sample_id, ``text``) rows into sample_id and the answer's columns, row by row.  Rows that share id and text are
        paid once; ``reused`` tells answers of earlier runs from those of this one.
        """
        keyed = df.withColumn("sample_id", F.col("sample_id").cast("string")).withColumn(
            "text_hash", F.sha2(F.coalesce(truncate(text, max_chars), F.lit("")), 256)
        )
        run = (self.rows().agg(F.max("run")).first()[0] or 0) + 1
        done = self.rows().filter(F.col(self.given).isNotNull()).select(*KEY).distinct()
        same = (F.col("sample_id").eqNullSafe(F.col("_id"))) & (F.col("text_hash") == F.col("_hash"))
        todo = keyed.select(*KEY, F.coalesce(text, F.lit("")).alias(text)).dropDuplicates(KEY).join(done.toDF("_id", "_hash"), same, "left_anti")
        rows = todo.count()
        if rows:
            tasks = -(-rows // calls_per_task)
            paid = call(todo.repartition(tasks, *KEY).withColumn("sample_id", F.to_json(F.struct(*KEY))))
            own = F.from_json("sample_id", "sample_id string, text_hash string")
            kept = paid.withColumn("_key", own).select("_key.*", F.lit(run).cast("bigint").alias("run"), *self.columns)
            kept.write.mode("append").options(**BY_TASK).parquet(self.path)
        told = self.answers().withColumnsRenamed({"sample_id": "_id", "text_hash": "_hash"})
        return keyed.join(told, same, "left").withColumn(reused, F.col("run") < run).drop("_id", "_hash", "run", text)


ANSWER = (
    "llm_prediction int, reason string, usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>, error string"
)


def judged_records(
    df: DataFrame, judge: ju.Judge, path: str, text: str = "prompt", retries: int = 3, max_chars: int = ju.JUDGE_CHARS,
    calls_per_task: int = 200, wait: Callable[[int], float] = ju.backoff,
) -> DataFrame:
    """The whole judged record: df's columns (position, label, score, ...) with answer, reason, usage, error and ``reused``."""

    def call(todo: DataFrame) -> DataFrame:
        return ju.judge_rows(todo.withColumnRenamed(text, "prompt"), judge, retries, max_chars, None, wait)

    return Ledger(df.sparkSession, path, ANSWER, "llm_prediction").settle(df, call, text, max_chars, calls_per_task)


def embedded_rows(
    df: DataFrame, embedder: ju.Embedder, path: str, text: str = "prompt", batch: int = 128, max_chars: int = ju.EMBED_CHARS, calls_per_task: int = 4096
) -> DataFrame:
    """df's columns with ``embedding`` and ``reused``; a vector on record serves as long as id and text are the same."""

    def call(todo: DataFrame) -> DataFrame:
        return ju.embed_rows(todo.withColumnRenamed(text, "prompt"), embedder, batch, max_chars)

    return Ledger(df.sparkSession, path, "embedding array<float>", "embedding").settle(df, call, text, max_chars, calls_per_task)
