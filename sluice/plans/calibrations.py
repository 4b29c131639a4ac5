"""Queries: exact binomial bounds and calibrated bypass thresholds."""

from pyspark.sql import functions as F

from sluice.functions import binomial as bn
from sluice.functions import hashing as hs
from sluice.operators import calibration as ca
from sluice.operators import joins as jo
from sluice.operators import sampling as sa
from sluice.plans import fixtures as fx
from sluice.plans import sql as q
from sluice.plans.registry import query
from sluice.session import stored

TAU = fx.EVENT_TAU
EPS, ALPHA = 0.005, 0.05

BYPASS = """count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,
    count(*) FILTER (WHERE router_score <= {t}) AS bypass_count,
    count(*) FILTER (WHERE router_score <= {t} AND label = 1) AS false_bypass_count"""
BY_STREAM = f"""{q.EVENTS}, b AS (SELECT stream, {BYPASS.format(t=TAU)} FROM judged_events GROUP BY stream)"""
LOW, HIGH = q.wilson("false_bypass_count", "positives")
RATE = f"{q.ratio('false_bypass_count', 'positives')} AS false_bypass_rate"


@query(
    "wilson",
    "stream:s n:i positives:i false_bypass_count:i false_bypass_rate:f wilson_low:f wilson_high:f",
    f"WITH {BY_STREAM} SELECT *, {RATE}, {LOW} AS wilson_low, {HIGH} AS wilson_high FROM b",
)
def wilson(spark, d):
    return ca.router_only(fx.judged_events(spark, d), TAU, ["stream"])


@query(
    "cp_upper",
    "stream:s positives:i false_bypass_count:i cp_upper:f",
    f"""WITH RECURSIVE {BY_STREAM}, {q.cp_upper('b', 'stream')}
SELECT b.*, cp.cp_upper FROM b JOIN cp ON cp.id = b.stream""",
)
def cp_upper(spark, d):
    return ca.router_only(fx.judged_events(spark, d), TAU, ["stream"])


# The bound is above the observed rate, so an allowed k is below positives * epsilon; all of
# those are listed and the largest whose binomial tail at epsilon stays within alpha is kept.
ALLOWED = f"""allowed AS (
  SELECT {{key}}, positives, coalesce(max(k), -1) AS max_allowed FROM (
    SELECT {{key}}, positives, k, {q.binomial_cdf('k', 'positives', str(EPS))} AS cdf
    FROM (SELECT {{key}}, positives, unnest(range(0, CAST(floor(positives * {EPS}) AS BIGINT) + 1)) AS k FROM {{source}})
    WHERE k < positives) WHERE cdf <= {ALPHA} GROUP BY {{key}}, positives
  UNION ALL
  SELECT {{key}}, positives, -1 FROM {{source}}
  WHERE positives = 0 OR {q.binomial_cdf('0', 'positives', str(EPS))} > {ALPHA})"""


@query(
    "max_allowed_fb",
    "stream:s positives:i max_allowed:i",
    f"WITH {BY_STREAM}, {ALLOWED.format(key='stream', source='b')} SELECT * FROM allowed",
)
def max_allowed_fb(spark, d):
    return ca.positive_budget(fx.judged_events(spark, d), EPS, ALPHA, ["stream"])


@query(
    "min_positives",
    "stream:s false_bypass_count:i positives_needed:i",
    f"""WITH {q.EVENTS}, b AS (SELECT stream, {BYPASS.format(t=0.005)} FROM judged_events GROUP BY stream),
c AS (
  SELECT stream, false_bypass_count, unnest(range(false_bypass_count + 1, CAST((2 * false_bypass_count + 10) / {EPS} AS BIGINT))) AS n FROM b),
s AS (SELECT stream, false_bypass_count, n, {q.binomial_cdf('false_bypass_count', 'n', str(EPS))} AS cdf FROM c)
SELECT stream, false_bypass_count, min(n) AS positives_needed FROM s WHERE cdf <= {ALPHA} GROUP BY ALL""",
)
def min_positives(spark, d):
    seen = ca.router_only(fx.judged_events(spark, d), 0.005, ["stream"])
    return seen.withColumn("positives_needed", bn.min_positives(F.col("false_bypass_count"), EPS, ALPHA))


def threshold_ctes(source: str, key: str) -> str:
    """CTE cut(key, positives, max_allowed, cutoff_score, tau_safe, feasible) over ``source``."""
    return f"""pos AS (SELECT {key}, count(*) FILTER (WHERE label = 1) AS positives FROM {source} GROUP BY {key}),
{ALLOWED.format(key=key, source='pos')},
ordered AS (
  SELECT {key}, router_score, row_number() OVER (PARTITION BY {key} ORDER BY router_score) AS place
  FROM {source} WHERE label = 1),
cut AS (
  SELECT a.{key}, a.positives, a.max_allowed, a.max_allowed >= 0 AS feasible, o.router_score AS cutoff_score,
    CASE WHEN a.max_allowed < 0 THEN 0 WHEN a.max_allowed >= a.positives THEN 1
      ELSE nextafter(o.router_score, CAST('-infinity' AS DOUBLE)) END AS tau_safe
  FROM allowed a LEFT JOIN ordered o ON o.{key} = a.{key} AND o.place = a.max_allowed + 1)"""


@query(
    "np_threshold",
    "whole:s epsilon:f alpha:f positives:i max_allowed:i feasible:b cutoff_score:f tau_safe:f n:i bypass_count:i "
    "false_bypass_count:i false_bypass_rate:f cp_upper:f call_reduction:f",
    f"""WITH RECURSIVE {q.EVENTS}, src AS (SELECT 'all' AS whole, * FROM judged_events), {threshold_ctes('src', 'whole')},
r AS (SELECT c.*, f.* FROM cut c, (SELECT count(*) AS n,
    count(*) FILTER (WHERE router_score <= (SELECT tau_safe FROM cut) AND (SELECT feasible FROM cut)) AS bypass_count,
    count(*) FILTER (WHERE label = 1 AND router_score <= (SELECT tau_safe FROM cut) AND (SELECT feasible FROM cut)) AS false_bypass_count
  FROM src) f),
{q.cp_upper('r', 'whole')}
SELECT r.*, {EPS} AS epsilon, {ALPHA} AS alpha, {RATE}, cp.cp_upper, bypass_count / CAST(n AS DOUBLE) AS call_reduction
FROM r JOIN cp ON cp.id = r.whole""",
)
def np_threshold(spark, d):
    return ca.calibrate(fx.judged_events(spark, d), EPS, ALPHA).withColumn("whole", F.lit("all"))


@query(
    "np_threshold_by_stream",
    "stream:s positives:i max_allowed:i feasible:b cutoff_score:f tau_safe:f n:i bypass_count:i false_bypass_count:i",
    f"""WITH {q.EVENTS}, {threshold_ctes('judged_events', 'stream')}
SELECT c.*, f.n, f.bypass_count, f.false_bypass_count FROM cut c JOIN (
  SELECT e.stream, count(*) AS n, count(*) FILTER (WHERE router_score <= tau_safe AND feasible) AS bypass_count,
    count(*) FILTER (WHERE label = 1 AND router_score <= tau_safe AND feasible) AS false_bypass_count
  FROM judged_events e JOIN cut x ON x.stream = e.stream GROUP BY e.stream) f ON f.stream = c.stream""",
)
def np_threshold_by_stream(spark, d):
    return ca.calibrate(fx.judged_events(spark, d), EPS, ALPHA, ["stream"])


INTERVALS = "false_bypass_rate:f wilson_low:f wilson_high:f cp_upper:f"


@query(
    "router_only",
    f"stream:s tau_safe:f n:i positives:i bypass_count:i false_bypass_count:i call_reduction:f {INTERVALS}",
    f"""WITH RECURSIVE {BY_STREAM}, {q.cp_upper('b', 'stream')}
SELECT b.*, {TAU} AS tau_safe, bypass_count / CAST(n AS DOUBLE) AS call_reduction, {RATE}, {LOW} AS wilson_low,
  {HIGH} AS wilson_high, cp.cp_upper FROM b JOIN cp ON cp.id = b.stream""",
)
def router_only(spark, d):
    return ca.router_only(fx.judged_events(spark, d), TAU, ["stream"])


@query(
    "judged_with_ci",
    "stream:s tau_safe:f n:i positives:i bypass_count:i false_bypass_count:i tn:i fp:i fn:i tp:i accuracy:f "
    f"precision:f recall:f specificity:f f1:f call_rate:f cost_reduction:f {INTERVALS}",
    f"""WITH RECURSIVE {q.EVENTS}, b AS (
  SELECT stream, {BYPASS.format(t=TAU)}, {q.confusion(q.cascade(str(TAU)))} FROM judged_events GROUP BY stream),
{q.cp_upper('b', 'stream')}
SELECT b.*, {q.RATES}, {TAU} AS tau_safe, 1 - bypass_count / CAST(n AS DOUBLE) AS call_rate,
  bypass_count / CAST(n AS DOUBLE) AS cost_reduction, {RATE}, {LOW} AS wilson_low, {HIGH} AS wilson_high, cp.cp_upper
FROM b JOIN cp ON cp.id = b.stream""",
)
def judged_with_ci(spark, d):
    return ca.judged_with_intervals(fx.judged_events(spark, d), TAU, ["stream"])


@query(
    "fixed_tau_risk",
    "stream:s tau_safe:f n:i positives:i false_bypass_count:i false_bypass_rate:f cp_upper:f call_reduction:f",
    f"""WITH RECURSIVE {BY_STREAM}, {q.cp_upper('b', 'stream')}
SELECT b.*, {TAU} AS tau_safe, {RATE}, cp.cp_upper, bypass_count / CAST(n AS DOUBLE) AS call_reduction
FROM b JOIN cp ON cp.id = b.stream""",
)
def fixed_tau_risk(spark, d):
    return ca.fixed_tau_risk(fx.judged_events(spark, d), TAU, ["stream"])


BIT = "CAST('0x' || right(sha256(sample_id), 1) AS INTEGER) % 2"


@query(
    "hash_split",
    "sample_id:s bit:i",
    f"WITH {q.EVENTS} SELECT sample_id, {BIT} AS bit FROM judged_events",
)
def hash_split(spark, d):
    rows = fx.judged_events(spark, d)
    return rows.select("sample_id", hs.parity_bit(F.col("sample_id")).alias("bit"))


@query(
    "hash_split_confirm",
    "selection:s tau_safe:f n:i positives:i bypass_count:i false_bypass_count:i false_bypass_rate:f cp_upper:f "
    "call_reduction:f passes:b",
    f"""WITH RECURSIVE {q.EVENTS}, halves AS (SELECT label, router_score, {BIT} AS bit FROM judged_events),
{threshold_ctes('halves', 'bit')},
plan AS (
  SELECT CAST(bit AS VARCHAR) AS selection, tau_safe, feasible, [1 - bit] AS bits FROM cut
  UNION ALL SELECT 'min_of_halves', min(tau_safe), bool_and(feasible), [0, 1] FROM cut),
b AS (
  SELECT selection, max(tau_safe) AS tau_safe, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,
    count(*) FILTER (WHERE router_score <= tau_safe AND feasible) AS bypass_count,
    count(*) FILTER (WHERE router_score <= tau_safe AND feasible AND label = 1) AS false_bypass_count
  FROM halves h JOIN plan p ON list_contains(p.bits, h.bit) GROUP BY selection),
{q.cp_upper('b', 'selection')}
SELECT b.*, {RATE}, cp.cp_upper, bypass_count / CAST(n AS DOUBLE) AS call_reduction, cp.cp_upper <= {EPS} AS passes
FROM b JOIN cp ON cp.id = b.selection""",
)
def hash_split_confirm(spark, d):
    return ca.hash_split_confirmation(fx.judged_events(spark, d), EPS, ALPHA)


# Two judged samples (every third event by hash order) and a calibration block outside them.
def judged_ids(spark, d):
    events = fx.judged_events(spark, d).select("sample_id", "label")
    third = sa.hash_sample(events, lambda n: F.floor(n / 3), "natural")
    return jo.id_union([third, sa.balanced_sample(events, 1000, "balanced")])


def pick(source: str, size: str, seed: str, part: str = "") -> str:
    over = f"PARTITION BY {part} " if part else ""
    return (
        f"SELECT * FROM {source} QUALIFY row_number() OVER ({over}ORDER BY sha256('{seed}:' || sample_id)) <= {size}"
    )


BALANCED = f"""halves_b AS ({pick('judged_events', '500', 'balanced:class', 'label')}),
rest_b AS (SELECT * FROM judged_events WHERE sample_id NOT IN (SELECT sample_id FROM halves_b)),
balanced AS (SELECT * FROM halves_b UNION ALL ({pick('rest_b', '(1000 - (SELECT count(*) FROM halves_b))', 'balanced:rest')}))"""
IDS = f"""{q.EVENTS}, {BALANCED},
natural_s AS ({pick('judged_events', '(SELECT count(*) // 3 FROM judged_events)', 'natural')}),
ids AS (SELECT sample_id FROM natural_s UNION SELECT sample_id FROM balanced)"""


@query("id_union", "sample_id:s", f"WITH {IDS} SELECT sample_id FROM ids")
def id_union(spark, d):
    return judged_ids(spark, d)


@query(
    "balanced_sample", "sample_id:s label:i", f"WITH {q.EVENTS}, {BALANCED} SELECT sample_id, label FROM balanced"
)
def balanced_sample(spark, d):
    events = fx.judged_events(spark, d).select("sample_id", "label")
    return sa.balanced_sample(events, 1000, "balanced")


@query(
    "random_sample",
    "sample_id:s position:i",
    f"""WITH {q.EVENTS}, s AS ({pick('judged_events', '(SELECT count(*) // 4 FROM judged_events)', '42')})
SELECT sample_id, row_number() OVER (ORDER BY sha256('43:' || sample_id)) - 1 AS position FROM s""",
)
def random_sample(spark, d):
    events = fx.judged_events(spark, d).select("sample_id", "label")
    return sa.shuffled(sa.hash_sample(events, lambda n: F.floor(n / 4), 42), 43)


@query(
    "calibration_exclusion",
    "bit:i n:i positives:i",
    f"""WITH {IDS}, c AS (SELECT * FROM judged_events WHERE sample_id NOT IN (SELECT sample_id FROM ids)),
k AS ({pick('c', '(SELECT count(*) // 2 FROM c)', 'calibration')})
SELECT 1 AS bit, count(*) AS n, sum(label) AS positives FROM k
UNION ALL SELECT 0, count(*), sum(label) FROM judged_events WHERE sample_id NOT IN (SELECT sample_id FROM k)""",
)
def calibration_exclusion(spark, d):
    """Calibration rows outside the judged samples, and everything outside the calibration rows."""
    events = fx.judged_events(spark, d).select("sample_id", "label")
    candidates = jo.without_ids(events, stored(judged_ids(spark, d), "judged-ids"))
    block = stored(sa.hash_sample(candidates, lambda n: F.floor(n / 2), "calibration"), "calibration")
    counts = [F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")]
    inside = block.agg(*counts).withColumn("bit", F.lit(1))
    return inside.unionByName(jo.without_ids(events, block).agg(*counts).withColumn("bit", F.lit(0)))
