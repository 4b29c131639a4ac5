"""The ledger of paid calls: over actions, runs, failed tasks, errors and changed texts."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from sluice.operators import judge as ju
from sluice.operators import ledger as le
from sluice.session import scratch_path

SCHEMA = "sample_id string, position bigint, label int, router_score double, prompt string"


def counting(folder, fatal=None):
    """The rule judge, leaving a file per call; ends its worker on one text while a marker is there."""

    def judge(text):
        if fatal and text == fatal and os.path.exists(f"{folder}/fatal"):
            raise SystemExit("worker lost")
        if text == "refused" and os.path.exists(f"{folder}/refuse"):
            raise ValueError("rate limit")
        with open(f"{folder}/call-{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        return ju.rule_judge(text)

    return judge


def calls(folder):
    return sum(name.startswith("call-") for name in os.listdir(folder))


@pytest.fixture
def docs(spark):
    rows = [(f"s{i}", i, i % 2, 0.1, f"text {i}{'?' if i % 3 == 0 else ''}") for i in range(40)]
    rows += [rows[0], (None, 40, 0, 0.2, None), ("s41", 41, 0, 0.2, ""), ("s42", 42, 0, 0.3, "refused")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_no_call_is_paid_twice(spark, docs, tmp_path):
    folder, path = str(tmp_path), scratch_path(spark, "ledger")
    records = le.judged_records(docs, counting(folder), path, calls_per_task=5)
    assert records.count() == docs.count() and records.filter("llm_prediction is null").count() == 0
    assert calls(folder) == 43  # 44 rows, one of them repeated
    again = le.judged_records(docs, counting(folder), path, calls_per_task=5)
    assert again.filter("reused").count() == 44 and calls(folder) == 43
    changed = docs.withColumn("prompt", F.when(F.col("position") < 3, F.concat(F.col("prompt"), F.lit("!"))).otherwise(F.col("prompt")))
    third = le.judged_records(changed, counting(folder), path)
    assert {r.position for r in third.filter("not reused").collect()} == {0, 1, 2} and calls(folder) == 46
    row = third.filter("position = 9").first()
    assert (row.label, row.router_score, row.llm_prediction, row.reason) == (1, 0.1, 1, "asks a question")


def test_a_failed_task_costs_its_own_calls_only(spark, docs, tmp_path):
    folder, path = str(tmp_path), scratch_path(spark, "ledger")
    (tmp_path / "fatal").touch()
    with pytest.raises(Exception):
        le.judged_records(docs, counting(folder, "text 7"), path, calls_per_task=5).count()
    paid, kept = calls(folder), le.Ledger(spark, path, le.ANSWER, "llm_prediction").rows().count()
    os.rename(tmp_path / "fatal", tmp_path / "mended")
    records = le.judged_records(docs, counting(folder, "text 7"), path, calls_per_task=5)
    assert records.filter("llm_prediction is null").count() == 0
    assert calls(folder) == paid + 43 - kept and kept > 0


def test_errors_are_pending_again(spark, docs, tmp_path):
    folder, path = str(tmp_path), scratch_path(spark, "ledger")
    (tmp_path / "refuse").touch()
    first = le.judged_records(docs, counting(folder), path, retries=0)
    assert [(r.sample_id, r.llm_prediction, r.error) for r in first.filter("error is not null").collect()] == [("s42", None, "ValueError: rate limit")]
    os.rename(tmp_path / "refuse", tmp_path / "fine")
    second = le.judged_records(docs, counting(folder), path, retries=0)
    assert second.filter("error is not null or llm_prediction is null").count() == 0 and second.filter("not reused").count() == 1
    assert calls(folder) == 43


def test_cascade_pays_once_over_actions(spark, docs, tmp_path):
    folder = str(tmp_path)
    rows = ju.run_cascade(docs.filter("sample_id is not null").dropDuplicates(["sample_id"]), counting(folder), 0.15, ledger=scratch_path(spark, "ledger"))
    assert rows.count() == 42 and rows.filter("route = 'judge'").count() == 2 and rows.filter("prediction is null").count() == 0
    assert calls(folder) == 2


def test_embeddings_are_kept_by_text(spark, docs):
    path = scratch_path(spark, "vectors")
    assert le.embedded_rows(docs, ju.length_embedder, path, batch=3).filter("embedding is null or reused").count() == 0
    longer = docs.withColumn("prompt", F.when(F.col("position") == 5, F.lit("longer text")).otherwise(F.col("prompt")))
    rows = le.embedded_rows(longer, ju.length_embedder, path).collect()
    assert [(r.position, r.embedding[0]) for r in rows if not r.reused] == [(5, 11.0)]
