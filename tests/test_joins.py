"""Joins by key: doubled keys and null labels fail or are settled, never multiply rows."""

import pytest
from pyspark.sql import functions as F

from sluice.functions.text import keyword_hit
from sluice.operators import joins as jo
from sluice.operators.judge import _one, backoff


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", 0, 1), ("b", 1, 0)], "sample_id string, label int, llm_prediction int")


def doubled(df):
    return df.unionByName(df)


def test_doubled_keys_fail(rows):
    table = doubled(rows.select("sample_id", "label", F.lit("t").alias("prompt")))
    scores = doubled(rows.select("sample_id", F.lit(0.5).alias("router_score")))
    answers = doubled(rows.select("sample_id", "llm_prediction"))
    for df in (
        jo.align_records(rows, table),
        jo.judge_lookup(rows, answers, answers),
        jo.merge_attempts(rows, answers),
        jo.replace_scores(rows, scores),
    ):
        with pytest.raises(Exception, match="several rows for"):
            df.collect()


def test_last_answer_counts(rows):
    old, new = (rows.select("sample_id", F.lit(v).alias("llm_prediction"), F.lit(v).alias("run")) for v in (0, 1))
    got = jo.judge_lookup(rows, old.unionByName(new), new.limit(0), order="run").collect()
    assert sorted((r.sample_id, r.llm_prediction, r.label_origin) for r in got) == [("a", 1, "base"), ("b", 1, "base")]


def test_null_labels_do_not_align(rows):
    table = rows.select("sample_id", F.lit(None).cast("int").alias("label"), F.lit("t").alias("prompt"))
    assert jo.alignment_faults(rows, table).first().label_mismatch == 2
    with pytest.raises(Exception, match="does not match"):
        jo.align_records(rows, table).collect()


def test_failed_rows_are_pending_again(spark, rows):
    done = spark.createDataFrame([("a", None, "Timeout"), ("b", 1, None)], "sample_id string, llm_prediction int, error string")
    assert [r.sample_id for r in jo.pending_rows(rows, done).collect()] == ["a"]


def test_words_are_matched_as_they_are(spark):
    df = spark.createDataFrame([("cost (a+b)",), ("aab",)], "t string")
    assert [r[0] for r in df.select(keyword_hit("t", ["(A+B)"])).collect()] == [True, False]


def test_retries_back_off():
    waits = []

    def fails(text):
        raise TimeoutError("busy")

    assert _one(fails, "x", 3, wait=lambda n: n + 1.0, sleep=waits.append)["error"].startswith("TimeoutError")
    assert waits == [1.0, 2.0, 3.0] and all(0.25 <= backoff(0) <= 0.5 and backoff(20) <= 30 for _ in range(20))
