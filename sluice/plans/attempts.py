"""Queries: session quarantine in batch, and the streaming jobs next to their batch SQL."""

from pyspark.sql import functions as F

from sluice.operators import joins as jo
from sluice.operators import monitor as mo
from sluice.operators import sessions as se
from sluice.plans import fixtures as fx
from sluice.plans import sql as q
from sluice.plans.registry import query
from sluice.session import scratch_path
from sluice.streaming import monitor as sm
from sluice.streaming import quarantine as sq
from sluice.streaming import routing as sr
from sluice.streaming.run import drain, file_stream

TAU = 0.5
ROUTE_TAU = fx.EVENT_TAU


def hit():
    return se.caught(F.col("router_score"), TAU, F.col("audited"), F.col("llm_prediction"))


HIT = f"(router_score <= {TAU} AND audited AND llm_prediction = 1)"
FLAGGED = f"""{q.ATTEMPTS},
flagged AS (
  SELECT *, {HIT} AS hit, coalesce(max(CAST({HIT} AS INTEGER)) OVER (
    PARTITION BY session_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS quarantined
  FROM attempts)"""
ROUTED = "sample_id:s session_id:i attempt_no:i quarantined:b"


@query("session_quarantine", ROUTED, f"WITH {FLAGGED} SELECT * FROM flagged")
def session_quarantine(spark, d):
    return se.with_quarantine(fx.attempts(spark, d), hit())


OUTCOME = f"""{FLAGGED},
calls AS (
  SELECT *, router_score <= {TAU} AND audited AS audit, router_score > {TAU} OR (router_score <= {TAU} AND audited) AS plain,
    quarantined OR router_score > {TAU} OR (router_score <= {TAU} AND audited) AS called FROM flagged),
outcome AS (
  SELECT session_id, count(*) AS attempts, count(*) FILTER (WHERE label = 1) AS positives,
    count(*) FILTER (WHERE label = 1 AND NOT (called AND llm_prediction = 1)) AS fn_quarantine,
    count(*) FILTER (WHERE label = 1 AND NOT (plain AND llm_prediction = 1)) AS fn_audit_only,
    count(*) FILTER (WHERE called) AS calls_quarantine, count(*) FILTER (WHERE plain) AS calls_audit_only,
    count(*) FILTER (WHERE audit AND NOT quarantined) AS audited_quarantine, count(*) FILTER (WHERE audit) AS audited_audit_only,
    min(attempt_no) FILTER (WHERE hit) AS quarantine_at FROM calls GROUP BY session_id)"""


def outcomes(spark, d):
    return se.session_outcomes(fx.attempts(spark, d), TAU)


@query(
    "session_outcomes",
    "session_id:i attempts:i positives:i fn_quarantine:i fn_audit_only:i calls_quarantine:i calls_audit_only:i "
    "audited_quarantine:i audited_audit_only:i quarantine_at:i quarantined:b",
    f"WITH {OUTCOME} SELECT *, quarantine_at IS NOT NULL AS quarantined FROM outcome",
)
def session_outcomes(spark, d):
    return outcomes(spark, d)


def summary_side(name: str) -> str:
    quarantine = name == "quarantine"
    rate = "avg(CASE WHEN quarantine_at IS NOT NULL THEN 1.0 ELSE 0.0 END)" if quarantine else "0.0"
    at = "avg(quarantine_at)" if quarantine else "NULL"
    return f"""SELECT '{name}' AS policy, count(*) AS sessions, avg(fn_{name} / CAST(nullif(positives, 0) AS DOUBLE)) AS mean_fn_rate,
  avg(fn_{name}) AS mean_fn_count, {rate} AS quarantine_rate, {at} AS mean_quarantine_at, avg(calls_{name}) AS mean_judge_calls,
  avg(audited_{name}) AS mean_audited FROM outcome"""


SUMMARY = (
    "policy:s sessions:i mean_fn_rate:f mean_fn_count:f quarantine_rate:f mean_quarantine_at:f mean_judge_calls:f mean_audited:f"
)


@query(
    "session_summary",
    SUMMARY,
    f"WITH {OUTCOME} {summary_side('audit_only')} UNION ALL {summary_side('quarantine')}",
)
def session_summary(spark, d):
    return se.session_summary(outcomes(spark, d))


# Conversations as a second source of sessions: positive = asks a question.
TURNS = f"""turns AS (
  SELECT 'conv_' || conv_id || '_' || turn AS sample_id, conv_id AS session_id, turn + 1 AS attempt_no,
    CASE WHEN contains(text, '?') THEN 1 ELSE 0 END AS label, length(text) / (length(text) + CAST(500 AS DOUBLE)) AS router_score
  FROM conversations),
attempts AS (
  SELECT *, label AS llm_prediction,
    {q.bucket("sample_id || ':attempt:' || attempt_no || ':audit:0'")} < 0.3 AS audited FROM turns)"""


def turns(spark, d):
    c = fx.table(spark, d, "conversations")
    sample_id = F.concat_ws("_", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    chars = F.length("text")
    rows = c.select(
        sample_id.alias("sample_id"),
        F.col("conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("attempt_no"),
        F.col("text").contains("?").cast("int").alias("label"),
        (chars / (chars + 500.0)).alias("router_score"),
    )
    audited = se.attempt_audit(F.col("sample_id"), F.col("attempt_no"), 0.3)
    return rows.withColumns({"llm_prediction": F.col("label"), "audited": audited})


@query(
    "conversation_quarantine",
    ROUTED,
    "WITH " + TURNS + FLAGGED[len(q.ATTEMPTS):] + " SELECT * FROM flagged",
)
def conversation_quarantine(spark, d):
    return se.with_quarantine(turns(spark, d), hit())


@query(
    "attempt_merge",
    "sample_id:s attempt_no:i router_score:f llm_prediction:i reason:s",
    f"""WITH {q.ATTEMPTS} SELECT sample_id, attempt_no, router_score / 2 AS router_score, llm_prediction,
  'score ' || label AS reason FROM attempts WHERE router_score <= {TAU}""",
)
def attempt_merge(spark, d):
    rows = fx.attempts(spark, d).filter(F.col("router_score") <= TAU)
    pool = rows.select("sample_id", "attempt_no", "router_score")
    judged = rows.select(
        "sample_id",
        (F.col("router_score") / 2).alias("router_score"),
        "llm_prediction",
        F.concat(F.lit("score "), F.col("label").cast("string")).alias("reason"),
    )
    return jo.merge_attempts(pool, judged)


# Streaming jobs: the views are written as files by Spark and read back as a stream.
def event_stream(spark, d):
    folder, rows = fx.event_folder(spark, d, "events", fx.judged_events(spark, d))
    return file_stream(spark, folder, rows.schema)


def profile(spark, d):
    return sm.reference_profile(fx.judged_events(spark, d).filter("stream = 'reference'"))


CLOSED = "WHERE window_end <= (SELECT max(ts) FROM judged_events) - INTERVAL 1 HOUR"
PSI_CELLS = " + ".join(
    f"(greatest(c{i}, 1e-6) - greatest(r{i}, 1e-6)) * ln(greatest(c{i}, 1e-6) / greatest(r{i}, 1e-6))" for i in range(10)
)
BIN_SQL = "(SELECT count(*) FROM psi_edges WHERE edge <= router_score)"
MONITOR_SQL = f"""WITH {q.EVENTS},
psi_edges AS (
  SELECT DISTINCT unnest(quantile_cont(router_score, [{", ".join(repr(i * 0.1) for i in range(1, 10))}])) AS edge
  FROM judged_events WHERE stream = 'reference'),
binned AS (SELECT *, {BIN_SQL} AS bin, date_trunc('day', ts) AS window_start FROM judged_events),
ref AS (SELECT count(*) AS rn, avg(CASE WHEN keyword_hit THEN 1.0 ELSE 0.0 END) AS rk,
  {", ".join(f"count(*) FILTER (WHERE bin = {i}) / CAST(count(*) AS DOUBLE) AS r{i}" for i in range(10))}
  FROM binned WHERE stream = 'reference'),
win AS (SELECT window_start, count(*) AS n, avg(CASE WHEN keyword_hit THEN 1.0 ELSE 0.0 END) AS ck,
  {", ".join(f"count(*) FILTER (WHERE bin = {i}) / CAST(count(*) AS DOUBLE) AS c{i}" for i in range(10))}
  FROM binned GROUP BY window_start),
points AS (
  SELECT window_start, v, sum(cur) AS cur, sum(ref) AS ref FROM (
    SELECT window_start, prompt_length AS v, count(*) AS cur, 0 AS ref FROM binned GROUP BY ALL
    UNION ALL
    SELECT w.window_start, r.v, 0, r.c FROM win w,
      (SELECT prompt_length AS v, count(*) AS c FROM binned WHERE stream = 'reference' GROUP BY ALL) r)
  GROUP BY window_start, v),
sums AS (
  SELECT window_start, sum(cur) OVER o / CAST(sum(cur) OVER (PARTITION BY window_start) AS DOUBLE) AS fc,
    sum(ref) OVER o / CAST(sum(ref) OVER (PARTITION BY window_start) AS DOUBLE) AS fr
  FROM points WINDOW o AS (PARTITION BY window_start ORDER BY v)),
ksw AS (SELECT window_start, max(abs(fc - fr)) AS ks_statistic FROM sums GROUP BY window_start),
stats AS (
  SELECT w.window_start, w.window_start + INTERVAL 1 DAY AS window_end, n, {PSI_CELLS} AS psi, ks_statistic,
    ck - rk AS keyword_diff, {q.ks_pvalue('ks_statistic', 'n', 'rn')} AS ks_pvalue
  FROM win w JOIN ksw k ON k.window_start = w.window_start, ref)
SELECT *, {q.decision()} FROM stats """
WINDOW = (
    "window_start:t window_end:t n:i psi:f ks_statistic:f ks_pvalue:f keyword_diff:f psi_trigger:b ks_trigger:b "
    "keyword_trigger:b shift_detected:b triggers:s"
)


DECISION = " ".join(c for c in WINDOW.split() if c not in ("ks_statistic:f", "ks_pvalue:f"))


@query("stream_monitor", DECISION, MONITOR_SQL + CLOSED)
def stream_monitor(spark, d):
    """Decisions of exact KS from sketches; only windows that their bounds leave open are counted exactly."""
    rows = fx.judged_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return sm.run_window_monitor(event_stream(spark, d), rows, profile(spark, d), scratch_path(spark, "monitor"))


@query("window_monitor_batch", WINDOW, MONITOR_SQL)
def window_monitor_batch(spark, d):
    rows = fx.judged_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return sm.window_statistics(rows, profile(spark, d))


@query(
    "stream_rates",
    "window_start:t window_end:t n:i keyword_rate:f call_rate:f",
    f"""WITH {q.EVENTS}, w AS (
  SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k.k) AS window_start
  FROM judged_events, range(4) k(k)),
r AS (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS n,
    avg(CASE WHEN keyword_hit THEN 1.0 ELSE 0.0 END) AS keyword_rate,
    avg(CASE WHEN router_score <= {ROUTE_TAU} THEN 0.0 ELSE 1.0 END) AS call_rate FROM w GROUP BY window_start)
SELECT * FROM r {CLOSED}""",
)
def stream_rates(spark, d):
    return drain(sm.window_rates(event_stream(spark, d), ROUTE_TAU), "rates")


@query(
    "stream_route",
    "sample_id:s route:s",
    f"""WITH {q.EVENTS} SELECT sample_id, CASE WHEN router_score > {ROUTE_TAU} THEN 'judge'
  WHEN {q.bucket("sample_id || ':audit:0'")} < 0.05 THEN 'audit' ELSE 'bypass' END AS route FROM judged_events""",
)
def stream_route(spark, d):
    return drain(sr.route(event_stream(spark, d), ROUTE_TAU).select("sample_id", "route"), "routes")


def attempt_stream(spark, d):
    folder, rows = fx.event_folder(spark, d, "attempts", fx.attempts(spark, d))
    return file_stream(spark, folder, rows.schema)


#: Attempt numbers at which another part of the attempts arrives.
ARRIVALS = [2, 4, 8, 16, 32]
FILES_PER_PART = 2


@query("stream_quarantine", ROUTED, f"WITH {FLAGGED} SELECT * FROM flagged")
def stream_quarantine(spark, d):
    """Six micro-batches, in order of attempt numbers, against one state."""
    rows, folder, path = fx.attempts(spark, d), scratch_path(spark, "arriving"), scratch_path(spark, "quarantine")
    for low, high in zip([0, *ARRIVALS], [*ARRIVALS, 1 << 62], strict=True):
        part = rows.filter((F.col("attempt_no") >= low) & (F.col("attempt_no") < high))
        part.repartition(FILES_PER_PART).write.mode("append").parquet(folder)
    sq.run_quarantine(file_stream(spark, folder, rows.schema, per_trigger=FILES_PER_PART), TAU, path)
    return spark.read.parquet(f"{path}/flagged")


@query(
    "stream_catches",
    "session_id:i first_catch:i",
    f"WITH {FLAGGED} SELECT session_id, min(attempt_no) AS first_catch FROM flagged WHERE hit GROUP BY session_id",
)
def stream_catches(spark, d):
    """Stateful operator; the state store it needs is set for this query only."""
    with sq.state_store(spark):
        decisions = drain(sq.catch_stream(attempt_stream(spark, d), TAU), "catches")
    return decisions.groupBy("session_id").agg(F.min("first_catch").alias("first_catch"))


@query(
    "stream_sessions",
    "session_id:i burst_start:t burst_end:t attempts:i bypassed:i",
    f"""WITH {q.EVENTS}, m AS (
  SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM judged_events WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM m),
g AS (SELECT session_id, min(ts) AS burst_start, max(ts) + INTERVAL 1 HOUR AS window_end, count(*) AS attempts,
    count(*) FILTER (WHERE router_score <= {ROUTE_TAU}) AS bypassed FROM b GROUP BY session_id, burst)
SELECT *, window_end AS burst_end FROM g {CLOSED}""",
)
def stream_sessions(spark, d):
    bursts = sr.attempts_per_session(event_stream(spark, d), tau=ROUTE_TAU)
    return drain(bursts, "bursts")


@query(
    "stream_dedupe",
    "sample_id:s label:i",
    f"WITH {q.EVENTS} SELECT sample_id, label FROM judged_events",
)
def stream_dedupe(spark, d):
    """Every event arrives twice; each id must come out once."""
    folder, rows = fx.event_folder(spark, d, "twice", fx.judged_events(spark, d))
    rows.write.mode("append").parquet(folder)
    once = sr.unseen(file_stream(spark, folder, rows.schema).select("sample_id", "label", "ts"))
    return drain(once, "once")


@query(
    "stream_failsafe",
    "route:s stream:s n:i",
    f"""WITH {q.EVENTS},
arriving AS (SELECT * FROM judged_events WHERE stream = 'shifted'
  UNION ALL SELECT * REPLACE ('steady' AS stream) FROM judged_events WHERE stream = 'reference'),
watched AS (SELECT * FROM arriving UNION ALL SELECT * FROM judged_events WHERE stream = 'reference'),
{q.statistics('watched')}, dec AS (SELECT stream, {q.decision()} FROM stats)
SELECT CASE WHEN NOT shift_detected AND router_score <= {ROUTE_TAU} THEN 'bypass' ELSE 'judge' END AS route, a.stream, count(*) AS n
FROM arriving a JOIN dec USING (stream) GROUP BY ALL""",
)
def stream_failsafe(spark, d):
    """The shifted stream trips the monitor and is judged in full; the steady one, the reference again, isn't."""
    rows, watch, columns = fx.judged_events(spark, d), profile(spark, d), ("sample_id", "router_score", "stream")
    parts = {"shifted": rows.filter("stream = 'shifted'"), "steady": rows.filter("stream = 'reference'").withColumn("stream", F.lit("steady"))}
    out = []
    for name, part in parts.items():
        folder, arriving = fx.event_folder(spark, d, name, part)
        results = sm.run_fail_safe(file_stream(spark, folder, arriving.schema), watch, scratch_path(spark, "failsafe"), ROUTE_TAU, columns)
        out.append(results()[1])
    return out[0].unionByName(out[1]).groupBy("route", "stream").agg(F.count(F.lit(1)).alias("n"))


@query(
    "keyword_drift_events",
    "stream:s n:i keyword_rate:f reference_keyword_rate:f keyword_diff:f",
    f"WITH {q.EVENTS}, {q.keyword_drift('judged_events')} SELECT * FROM kw_result",
)
def keyword_drift_events(spark, d):
    return mo.keyword_drift(fx.judged_events(spark, d))
