"""Queries: prompt tables, quality by stream, and the shift monitor with its fail-safe."""

from pyspark.sql import functions as F

from sluice.functions import lexicons as lx
from sluice.operators import monitor as mo
from sluice.operators import policy as po
from sluice.operators import quality as qu
from sluice.plans import fixtures as fx
from sluice.plans import sql as q
from sluice.plans.registry import query

TAU = fx.EVENT_TAU
POLICY = "tn:i fp:i fn:i tp:i accuracy:f balanced_accuracy:f precision:f recall:f specificity:f f1:f"
COST = "call_rate:f cost_reduction:f bypass_count:i false_bypass_count:i false_bypass_rate:f"


@query(
    "normalise_prompts",
    "sample_id:s prompt:s label:i dataset:s split:s source_doc_id:i source_lang:s source_source:s source_quality:i",
    f"WITH {q.PROMPTS} SELECT * FROM prompts",
)
def normalise_prompts(spark, d):
    return fx.prompts(spark, d)


@query(
    "label_counts",
    "dataset:s split:s label:i n:i",
    f"WITH {q.PROMPTS} SELECT dataset, split, label, count(*) AS n FROM prompts GROUP BY ALL",
)
def label_counts(spark, d):
    return qu.label_counts(fx.prompts(spark, d), ["dataset", "split"])


@query(
    "confusion_rates",
    "stream:s n:i n_negatives:i " + POLICY + " fpr:f fnr:f positive_rate:f",
    f"""WITH {q.EVENTS}, c AS (
  SELECT stream, count(*) AS n, count(*) FILTER (WHERE label = 0) AS n_negatives, {q.confusion('llm_prediction')}
  FROM judged_events GROUP BY stream)
SELECT *, {q.RATES} FROM c""",
)
def confusion_rates(spark, d):
    return qu.confusion(fx.judged_events(spark, d), F.col("llm_prediction"), ["stream"])


POLICY_SQL = f"""WITH {q.EVENTS}, c AS (
  SELECT stream, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,
    count(*) FILTER (WHERE router_score <= {{tau}}) AS bypass_count,
    count(*) FILTER (WHERE router_score <= {{tau}} AND label = 1) AS false_bypass_count,
    {q.confusion(q.cascade('{tau}'))}
  FROM judged_events GROUP BY stream)
SELECT *, {q.RATES}, 1 - bypass_count / CAST(n AS DOUBLE) AS call_rate, bypass_count / CAST(n AS DOUBLE) AS cost_reduction,
  false_bypass_count / CAST(nullif(positives, 0) AS DOUBLE) AS false_bypass_rate FROM c"""


@query("policy_naive_by_stream", f"stream:s n:i positives:i {COST} {POLICY}", POLICY_SQL.format(tau=TAU))
def policy_naive_by_stream(spark, d):
    return po.evaluate_policy(fx.judged_events(spark, d), TAU, ["stream"])


@query("policy_failsafe_by_stream", f"stream:s n:i positives:i {COST} {POLICY}", POLICY_SQL.format(tau=-1))
def policy_failsafe_by_stream(spark, d):
    return po.evaluate_policy(fx.judged_events(spark, d), TAU, ["stream"], fail_safe=True)


@query(
    "psi_by_stream", "stream:s n:i psi:f", f"WITH {q.DOCS}, {q.psi('judged_docs')} SELECT * FROM psi_result"
)
def psi_by_stream(spark, d):
    return mo.psi_by_stream(fx.judged_docs(spark, d))


@query(
    "psi_by_event_stream",
    "stream:s n:i psi:f",
    f"WITH {q.EVENTS}, {q.psi('judged_events')} SELECT * FROM psi_result",
)
def psi_by_event_stream(spark, d):
    return mo.psi_by_stream(fx.judged_events(spark, d))


KS_SPEC = "stream:s n:i n_reference:i ks_statistic:f ks_pvalue:f"


@query("ks_stat_by_stream", KS_SPEC, f"WITH {q.DOCS}, {q.ks('judged_docs')} SELECT * FROM ks_result")
def ks_stat_by_stream(spark, d):
    return mo.ks_by_stream(fx.judged_docs(spark, d))


@query("ks_stat_by_event_stream", KS_SPEC, f"WITH {q.EVENTS}, {q.ks('judged_events')} SELECT * FROM ks_result")
def ks_stat_by_event_stream(spark, d):
    return mo.ks_by_stream(fx.judged_events(spark, d))


@query(
    "keyword_drift",
    "stream:s n:i keyword_rate:f reference_keyword_rate:f keyword_diff:f",
    f"WITH {q.DOCS}, {q.keyword_drift('judged_docs')} SELECT * FROM kw_result",
)
def keyword_drift(spark, d):
    return mo.keyword_drift(fx.judged_docs(spark, d))


STATS = "psi:f ks_statistic:f ks_pvalue:f keyword_diff:f"
DECISION = "psi_trigger:b ks_trigger:b keyword_trigger:b shift_detected:b triggers:s"


@query(
    "shift_decision",
    f"stream:s n:i {STATS} {DECISION}",
    f"WITH {q.DOCS}, {q.statistics('judged_docs')} SELECT *, {q.decision()} FROM stats",
)
def shift_decision(spark, d):
    return mo.decide(mo.stream_statistics(fx.judged_docs(spark, d)))


def failsafe_sql(source: str, cte: str, tau: float) -> str:
    def side(name: str, limit: str) -> str:
        return f"""SELECT d.*, '{name}' AS policy, c.* EXCLUDE (stream) FROM decided d JOIN (
    SELECT s.stream, count(*) FILTER (WHERE label = 1) AS positives,
      count(*) FILTER (WHERE router_score <= {limit}) AS bypass_count,
      count(*) FILTER (WHERE router_score <= {limit} AND label = 1) AS false_bypass_count,
      {q.confusion(q.cascade(limit))}
    FROM {source} s JOIN decided x ON s.stream = x.stream GROUP BY s.stream) c ON c.stream = d.stream"""

    return f"""WITH {cte}, {q.statistics(source)},
decided AS (SELECT *, {q.decision()} FROM stats),
both_policies AS ({side('naive', str(tau))} UNION ALL
  {side('fail_safe', f'(CASE WHEN x.shift_detected THEN -1 ELSE {tau} END)')})
SELECT *, {q.RATES}, 1 - bypass_count / CAST(n AS DOUBLE) AS call_rate, bypass_count / CAST(n AS DOUBLE) AS cost_reduction,
  false_bypass_count / CAST(nullif(positives, 0) AS DOUBLE) AS false_bypass_rate FROM both_policies"""


FAILSAFE = f"stream:s policy:s n:i positives:i {STATS} {DECISION} {COST} {POLICY}"


@query("shift_failsafe", FAILSAFE, failsafe_sql("judged_events", q.EVENTS, TAU))
def shift_failsafe(spark, d):
    return mo.shift_failsafe(fx.judged_events(spark, d), TAU)


@query("shift_failsafe_docs", FAILSAFE, failsafe_sql("judged_docs", q.DOCS, 0.3))
def shift_failsafe_docs(spark, d):
    """Monitors read every text; figures that need a label count the labelled ones."""
    return mo.shift_failsafe(fx.judged_docs(spark, d), 0.3)


GRID = ", ".join(str(v) for v in lx.PSI_GRID)


@query(
    "monitor_sensitivity",
    "stream:s psi_limit:f shift_detected:b psi:f keyword_diff:f naive_call_reduction:f "
    "naive_false_bypass_rate:f final_call_reduction:f final_false_bypass_rate:f",
    f"""WITH {q.EVENTS}, {q.statistics('judged_events')},
decided AS (SELECT *, {q.decision('psi_limit')} FROM stats CROSS JOIN (SELECT unnest([{GRID}]) AS psi_limit)),
naive AS (
  SELECT stream, count(*) FILTER (WHERE router_score <= {TAU}) / CAST(count(*) AS DOUBLE) AS cut,
    count(*) FILTER (WHERE router_score <= {TAU} AND label = 1) AS fb, count(*) FILTER (WHERE label = 1) AS pos
  FROM judged_events GROUP BY stream)
SELECT d.*, cut AS naive_call_reduction, CAST(fb AS DOUBLE) / nullif(pos, 0) AS naive_false_bypass_rate,
  CASE WHEN shift_detected THEN 0 ELSE cut END AS final_call_reduction,
  CASE WHEN shift_detected THEN 0 ELSE CAST(fb AS DOUBLE) END / nullif(pos, 0) AS final_false_bypass_rate
FROM decided d JOIN naive v ON d.stream = v.stream""",
)
def monitor_sensitivity(spark, d):
    return mo.psi_sensitivity(fx.judged_events(spark, d), TAU)
