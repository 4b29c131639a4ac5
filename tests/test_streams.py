"""Sessions and streams: batch loops, several micro-batches, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import sessions as se
from sluice.plans import fixtures as fx
from sluice.session import scratch_path
from sluice.streaming import monitor as sm
from sluice.streaming import quarantine as sq
from sluice.streaming import routing as sr
from sluice.streaming.run import drain, file_stream

TAU = 0.5


def attempts(n=600, seed=2):
    """One session holds half of the attempts."""
    rng, counters, rows = random.Random(seed), {}, []
    for i in range(n):
        s = 0 if rng.random() < 0.5 else rng.randrange(1, 40)
        counters[s] = counters.get(s, 0) + 1
        rows.append((f"s{i}", s, counters[s], int(rng.random() < 0.6), rng.random(), int(rng.random() < 0.7), rng.random() < 0.2))
    return rows


SCHEMA = (
    "sample_id string, session_id bigint, attempt_no bigint, label int, router_score double, "
    "llm_prediction int, audited boolean"
)


def loop(rows):
    """The rule, one attempt after the other."""
    state, flagged, out = {}, {}, {}
    for sid, s, no, label, score, judge, audited in sorted(rows, key=lambda r: (r[1], r[2])):
        o = out.setdefault(s, {"fn": 0, "plain_fn": 0, "calls": 0, "at": None})
        quarantined = state.get(s, False)
        flagged[sid] = quarantined
        by = score <= TAU
        plain = not by or audited
        call = quarantined or plain
        o["calls"] += call
        o["fn"] += label == 1 and not (call and judge == 1)
        o["plain_fn"] += label == 1 and not (plain and judge == 1)
        if by and audited and judge == 1 and not quarantined:
            state[s], o["at"] = True, no
    return flagged, out


def test_quarantine_against_a_loop(spark):
    rows = attempts()
    df = spark.createDataFrame(rows, SCHEMA)
    flagged, want = loop(rows)
    hit = se.caught(F.col("router_score"), TAU, F.col("audited"), F.col("llm_prediction"))
    got = {r["sample_id"]: r["quarantined"] for r in se.with_quarantine(df, hit).collect()}
    assert got == flagged
    for r in se.session_outcomes(df, TAU).collect():
        o = want[r["session_id"]]
        assert (r["fn_quarantine"], r["fn_audit_only"], r["calls_quarantine"], r["quarantine_at"]) == (
            o["fn"], o["plain_fn"], o["calls"], o["at"],
        )
        assert r["fn_quarantine"] <= r["fn_audit_only"]


def write_part(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_quarantine_stream_over_restarts(spark):
    rows = sorted(attempts(), key=lambda r: r[2])
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "out")
    flagged, _ = loop(rows)
    for part in (rows[:200], rows[200:400], rows[400:]):
        write_part(spark, part, folder)
        stream = file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
        sq.run_quarantine(stream, TAU, path)
    got = {r["sample_id"]: r["quarantined"] for r in spark.read.parquet(f"{path}/flagged").collect()}
    assert got == flagged


def test_stateful_catches_over_restarts(spark):
    rows = attempts()
    before = spark.conf.get(sq.STORE_KEY, None)
    spark.conf.set(sq.STORE_KEY, sq.STORE_CLASS)
    try:
        folder, path = scratch_path(spark, "in"), scratch_path(spark, "catches")
        for part in (rows[300:], rows[:300]):  # later attempts arrive first
            write_part(spark, part, folder)
            stream = file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
            out = drain(sq.catch_stream(stream, TAU), "catches", path)
    finally:
        spark.conf.unset(sq.STORE_KEY) if before is None else spark.conf.set(sq.STORE_KEY, before)
    got = {r[0]: r[1] for r in out.groupBy("session_id").agg(F.min("first_catch")).collect()}
    want = {}
    for _, s, no, _, score, judge, audited in rows:
        if score <= TAU and audited and judge == 1:
            want[s] = min(no, want.get(s, no))
    assert got == want


def test_late_rows_are_dropped_past_the_watermark(spark):
    t0 = dt.datetime(2024, 1, 1)
    schema = "sample_id string, ts timestamp, router_score double, prompt_length int, keyword_hit boolean"

    def rows(tag, hours):
        return [(f"{tag}{i}", t0 + dt.timedelta(hours=h), 0.1 + 0.01 * (i % 30), 10 + i % 9, i % 2 == 0) for i, h in enumerate(hours)]

    reference = spark.createDataFrame(rows("r", [0] * 40), schema)
    profile = sm.reference_profile(reference)
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "windows")
    results = None
    for batch in (rows("a", [1, 2, 3, 30, 31, 60]), rows("late", [4, 5]) + rows("b", [90])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = file_stream(spark, folder, reference.schema)
        results = drain(sm.window_sketches(stream, profile), "windows", path)
    got = {r["window_start"]: r["n"] for r in results.collect()}
    assert got == {t0: 3, t0 + dt.timedelta(days=1): 2, t0 + dt.timedelta(days=2): 1}


SHORT = "sample_id string, ts timestamp, router_score double, prompt_length int, keyword_hit boolean, label int, llm_prediction int"


def lengths_on(day, lengths):
    t0 = dt.datetime(2024, 1, 1)
    return [(f"{day}-{i}", t0 + dt.timedelta(days=day, seconds=i), 0.1 + 0.01 * (i % 30), v, i % 2 == 0, 0, 0) for i, v in enumerate(lengths)]


def ks_of(one, two):
    at = lambda xs, g: sum(x <= g for x in xs) / len(xs)
    return max(abs(at(one, g) - at(two, g)) for g in {*one, *two})


def test_bounds_hold_the_exact_ks_and_open_windows_are_counted(spark):
    rng = random.Random(1)
    reference = [rng.randrange(1000) for _ in range(6000)]
    days = {
        1: [rng.randrange(1000) for _ in range(3000)],  # no shift, sketch of more values than k
        2: [v // 2 for v in reference[:3000]],  # a clear one
        3: [int(v * 0.965) for v in reference[:3000]],  # near the limit
        4: [rng.randrange(1000) for _ in range(40)],
        5: [None, 7],
        6: [None],
    }
    known = {day: [v for v in lengths if v is not None] for day, lengths in days.items()}
    profile = sm.reference_profile(spark.createDataFrame(lengths_on(0, reference), SHORT), k=256)
    rows = [r for day, lengths in days.items() for r in lengths_on(day, lengths)]
    history = spark.createDataFrame(rows, SHORT)
    batch = {r["window_start"].day - 1: r for r in sm.window_statistics(history, profile).collect()}
    for day, values in known.items():
        want = ks_of(values, reference) if values else 0.0
        assert batch[day]["ks_statistic"] == pytest.approx(want) and batch[day]["n"] == len(days[day])
    sketched = {r["window_start"].day - 1: r for r in sm.window_sketches(history, profile).collect()}
    for day, values in known.items():
        if values:
            assert sketched[day]["ks_low"] - 1e-12 <= batch[day]["ks_statistic"] <= sketched[day]["ks_high"] + 1e-12
        assert sketched[day]["ks_trigger"] in (None, batch[day]["ks_trigger"])
    assert sketched[2]["ks_trigger"] and sketched[3]["ks_trigger"] is None and sketched[6]["ks_trigger"] is False
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "monitor")
    decided = None
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :] + lengths_on(20, [5])):
        spark.createDataFrame(part, SHORT).coalesce(1).write.mode("append").parquet(folder)
        decided = sm.run_window_monitor(file_stream(spark, folder, history.schema), history, profile, path)
    got = {r["window_start"].day - 1: r for r in decided.collect()}
    assert {d: (r["n"], r["ks_trigger"], r["shift_detected"], r["triggers"]) for d, r in got.items()} == {
        d: (r["n"], r["ks_trigger"], r["shift_detected"], r["triggers"]) for d, r in batch.items()
    }
    assert got[3]["ks_statistic"] == pytest.approx(batch[3]["ks_statistic"]) and got[2]["ks_statistic"] is None
    decision = sm.batch_decision(history.filter("sample_id like '2-%'"), profile, 0.2).first()
    assert decision["ks_trigger"] and decision["n"] == 3000


def test_routes_and_duplicates(spark, sf_dir):
    folder, rows = fx.event_folder(spark, sf_dir, "events", fx.judged_events(spark, sf_dir))
    rows.limit(100).write.mode("append").parquet(folder)
    stream = file_stream(spark, folder, rows.schema, per_trigger=1)
    once = drain(sr.unseen(stream.select("sample_id", "ts", "router_score"), "365 days"), "once")
    assert once.count() == rows.count() == once.select("sample_id").distinct().count()
    batch = {r[0]: r[1] for r in sr.route(rows, 0.3).groupBy("route").count().collect()}
    assert set(batch) <= {"judge", "audit", "bypass"} and sum(batch.values()) == rows.count()


@pytest.mark.parametrize("stream_name, expected", [("shifted", {"judge"}), ("holdout", {"judge", "bypass"})])
def test_fail_safe_switch(spark, sf_dir, stream_name, expected):
    events = fx.judged_events(spark, sf_dir)
    profile = sm.reference_profile(events.filter("stream = 'reference'"))
    # The holdout stream is the reference again: no shift, so low scores are bypassed.
    wanted = "reference" if stream_name == "holdout" else stream_name
    folder, rows = fx.event_folder(spark, sf_dir, "in", events.filter(F.col("stream") == wanted))
    results = sm.run_fail_safe(file_stream(spark, folder, rows.schema), profile, scratch_path(spark, "fs"), 0.2)
    policy, routed = results()
    assert policy.count() == 1 and policy.first()["shift_detected"] == (stream_name == "shifted")
    assert {r[0] for r in routed.select("route").distinct().collect()} == expected
    assert routed.count() == rows.count()


def test_state_is_the_table_of_catches(spark):
    """Five micro-batches of one state; a quiet session is forgotten by its timer."""
    rows = sorted(attempts(300), key=lambda r: r[2])
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "out")
    for i in range(5):
        write_part(spark, rows[60 * i : 60 * (i + 1)], folder)
    stream = file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, per_trigger=1)
    sq.run_quarantine(stream, TAU, path)
    flagged = spark.read.parquet(f"{path}/flagged")
    assert flagged.select("batch").distinct().count() == 5 and flagged.count() == 300
    got = {r["sample_id"]: r["quarantined"] for r in flagged.collect()}
    assert got == loop(rows)[0]
    want = {}
    for _, s, no, _, score, judge, audited in rows:
        if score <= TAU and audited and judge == 1:
            want[s] = min(no, want.get(s, no))
    assert {r.session_id: r.first_catch for r in sq.known_catches(spark, f"{path}/catching").collect()} == want


def test_quiet_sessions_are_forgotten(spark):
    """Timers in event time: the watermark passes the first session's last catch by more than an hour."""
    folder, path, t0 = scratch_path(spark, "in"), scratch_path(spark, "out"), dt.datetime(2024, 1, 1)
    schema = f"{SCHEMA}, ts timestamp"
    for part in ([("a", 1, 3, 1, 0.1, 1, True, t0)], [("b", 2, 4, 1, 0.1, 1, True, t0 + dt.timedelta(days=2))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        sq.run_quarantine(file_stream(spark, folder, spark.createDataFrame([], schema).schema), TAU, path, quiet_ms=3_600_000)
    assert [(r.session_id, r.first_catch) for r in sq.known_catches(spark, f"{path}/catching").collect()] == [(2, 4)]
