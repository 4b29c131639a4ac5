"""Queries: audit draws, gates, mixtures, label lookups."""

from pyspark.sql import functions as F

from sluice.functions import hashing as hs
from sluice.functions import lexicons as lx
from sluice.functions import text as tx
from sluice.operators import gates as ga
from sluice.operators import joins as jo
from sluice.operators import monitor as mo
from sluice.operators import policy as po
from sluice.operators import sampling as sa
from sluice.plans import fixtures as fx
from sluice.plans import sql as q
from sluice.plans.calibrations import pick
from sluice.plans.policies import failsafe_sql
from sluice.plans.registry import query
from sluice.session import join_small, stored

TAU = fx.GATE_TAU
POLICY = "tn:i fp:i fn:i tp:i accuracy:f balanced_accuracy:f precision:f recall:f specificity:f f1:f"


@query(
    "audit_bucket",
    "sample_id:s audited:b bucket:f",
    f"""WITH {q.EVENTS} SELECT sample_id, {q.bucket("sample_id || ':audit:3'")} < 0.1 AS audited,
  {q.bucket("sample_id || ':audit:3'")} AS bucket FROM judged_events""",
)
def audit_bucket(spark, d):
    rows = fx.judged_events(spark, d)
    return rows.select(
        "sample_id",
        hs.audit_flag(F.col("sample_id"), 0.1, 3).alias("audited"),
        hs.unit_bucket(F.concat(F.col("sample_id"), F.lit(":audit:3"))).alias("bucket"),
    )


AUDIT_SQL = f"""WITH {q.PLANTED}, a AS (
  SELECT *, router_score <= {TAU} AS bypass, router_score <= {TAU} AND {q.bucket("sample_id || ':audit:0'")} < 0.05 AS audit
  FROM planted_docs),
p AS (SELECT *, CASE WHEN NOT bypass OR audit THEN llm_prediction ELSE 0 END AS pred FROM a),
c AS (
  SELECT stream, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,
    count(*) FILTER (WHERE NOT bypass OR audit) AS called_count, count(*) FILTER (WHERE audit) AS audited_bypass_count,
    count(*) FILTER (WHERE label = 1 AND bypass AND NOT audit) AS malicious_false_bypass_count,
    count(*) FILTER (WHERE label = 1 AND pred = 0) AS malicious_e2e_fn_count,
    count(*) FILTER (WHERE is_adaptive) AS adaptive_count,
    count(*) FILTER (WHERE is_adaptive AND audit) AS adaptive_audited_count,
    count(*) FILTER (WHERE is_adaptive AND pred = 0) AS adaptive_e2e_fn_count,
    count(*) FILTER (WHERE is_adaptive AND audit AND pred = 1) AS adaptive_caught_when_audited,
    count(*) FILTER (WHERE label = 1 AND audit) AS malicious_bypass_audited_count,
    count(*) FILTER (WHERE label = 1 AND audit AND pred = 1) AS malicious_caught_when_audited,
    count(*) FILTER (WHERE bypass) AS naive, {q.confusion('pred')}
  FROM p GROUP BY stream)
SELECT *, {q.RATES}, called_count / CAST(n AS DOUBLE) AS call_rate, 1 - called_count / CAST(n AS DOUBLE) AS cost_reduction,
  naive / CAST(n AS DOUBLE) AS naive_cost_reduction,
  {q.ratio('malicious_false_bypass_count', 'positives')} AS malicious_false_bypass_rate,
  {q.ratio('malicious_e2e_fn_count', 'positives')} AS malicious_e2e_fn_rate,
  {q.ratio('adaptive_e2e_fn_count', 'adaptive_count')} AS adaptive_e2e_fn_rate,
  adaptive_audited_count - adaptive_caught_when_audited AS adaptive_judge_miss_when_audited FROM c"""


@query(
    "audit_policy",
    "stream:s n:i positives:i called_count:i audited_bypass_count:i malicious_false_bypass_count:i "
    "malicious_e2e_fn_count:i adaptive_count:i adaptive_audited_count:i adaptive_e2e_fn_count:i "
    "adaptive_caught_when_audited:i malicious_bypass_audited_count:i malicious_caught_when_audited:i call_rate:f "
    "cost_reduction:f naive_cost_reduction:f malicious_false_bypass_rate:f malicious_e2e_fn_rate:f "
    f"adaptive_e2e_fn_rate:f adaptive_judge_miss_when_audited:i {POLICY}",
    AUDIT_SQL,
)
def audit_policy(spark, d):
    return po.audit_policy(fx.planted_docs(spark, d).drop("prompt"), TAU, groups=["stream"])


SEEDS_SQL = f"""WITH {q.PLANTED}, s AS (
  SELECT r.seed AS audit_seed, router_score <= {TAU} AS bypass, llm_prediction,
    {q.bucket("sample_id || ':audit:' || r.seed")} < 0.05 AS audit
  FROM planted_docs, range(100) r(seed) WHERE is_adaptive),
c AS (SELECT audit_seed, count(*) AS n, count(*) FILTER (WHERE bypass AND audit) AS adaptive_audited_count,
    count(*) FILTER (WHERE (bypass AND NOT audit) OR llm_prediction = 0) AS adaptive_e2e_fn_count FROM s GROUP BY audit_seed),
f AS (SELECT *, adaptive_e2e_fn_count / CAST(n AS DOUBLE) AS adaptive_e2e_fn_rate FROM c)"""


def seed_rows(spark, d):
    return po.audit_seed_sensitivity(fx.planted_docs(spark, d).drop("prompt"), TAU)


@query(
    "audit_seed_rows",
    "audit_seed:i adaptive_audited_count:i adaptive_e2e_fn_count:i adaptive_e2e_fn_rate:f",
    f"{SEEDS_SQL} SELECT * FROM f",
)
def audit_seed_rows(spark, d):
    return seed_rows(spark, d)


@query(
    "audit_seed_sensitivity",
    "seeds:i mean_adaptive_e2e_fn_rate:f mean_adaptive_audited_count:f",
    f"""{SEEDS_SQL} SELECT count(*) AS seeds, avg(adaptive_e2e_fn_rate) AS mean_adaptive_e2e_fn_rate,
  avg(adaptive_audited_count) AS mean_adaptive_audited_count FROM f""",
)
def audit_seed_sensitivity(spark, d):
    return po.seed_means(seed_rows(spark, d))


GAP = "chr(10) || chr(10)"
PREFIX = f"(CASE WHEN instr(prompt, {GAP}) > 0 THEN substr(prompt, 1, instr(prompt, {GAP}) - 1) ELSE prompt END)"
TAIL = f"(CASE WHEN instr(prompt, {GAP}) > 0 THEN substr(prompt, instr(prompt, {GAP}) + 2) ELSE prompt END)"
HITS = "(" + " + ".join(f"CAST(contains(lower({PREFIX}), '{t}') AS INTEGER)" for t in fx.LEXICON) + ")"
DENSITY = f"({HITS} / CAST({len(fx.LEXICON)} AS DOUBLE))"


@query(
    "lexicon_density",
    "sample_id:s hits:i density:f",
    f"WITH {q.PLANTED} SELECT sample_id, {HITS} AS hits, {DENSITY} AS density FROM planted_docs",
)
def lexicon_density(spark, d):
    return fx.planted_docs(spark, d).select(
        "sample_id",
        tx.lexicon_hits(tx.prefix("prompt"), fx.LEXICON).alias("hits"),
        tx.lexicon_density("prompt", fx.LEXICON).alias("density"),
    )


@query(
    "density_calibration",
    "stream:s n:i density_threshold:f max_density:f",
    f"""WITH {q.PLANTED} SELECT stream, count(*) AS n, quantile_cont({DENSITY}, 0.995) AS density_threshold,
  max({DENSITY}) AS max_density FROM planted_docs WHERE NOT is_adaptive GROUP BY stream""",
)
def density_calibration(spark, d):
    return ga.density_calibration(fx.planted_docs(spark, d).filter("NOT is_adaptive"), fx.LEXICON, groups=["stream"])


WORD = f"regexp_matches(lower({TAIL}), '{'|'.join(lx.MONITOR_WORDS)}')"
STARTS = f"starts_with(prompt, '{fx.FIXED_PREFIX}')"
LOW = f"router_score < {lx.ULTRA_LOW_SCORE}"
GATE_SQL = {
    "baseline_np_triage": "FALSE",
    "padding_prefix_fingerprint": STARTS,
    "benign_weight_density_gate": f"{DENSITY} > 0.5",
    "tail_keyword_gate": WORD,
    "ultra_low_score_gate": LOW,
    "long_prompt_low_score": f"length(prompt) > {lx.LONG_PROMPT_CHARS} AND router_score <= {TAU}",
    "padding_or_tail_keyword": f"({STARTS} OR {WORD})",
    "padding_or_ultra_low": f"({STARTS} OR {LOW})",
    "audit_all_bypass_malicious_tail": f"{WORD} AND router_score <= {TAU}",
}
GATE_SPEC = (
    "gate:s n:i bypass_count:i adaptive_total:i adaptive_caught:i adaptive_escalated:i other_total:i "
    "extra_escalations:i extra_escalations_of_bypassed:i negatives:i negative_escalations:i false_positives:i "
    "call_rate:f cost_reduction:f adaptive_e2e_fn_rate:f extra_escalation_rate:f stream_fpr:f"
)


def gate_sql(rows: str, keys: str = "") -> str:
    """Figures per gate over a relation with columns gate, up, label, is_adaptive, router_score, llm_prediction."""
    k = f"{keys}, " if keys else ""
    return f"""c AS (
  SELECT {k}gate, count(*) AS n, count(*) FILTER (WHERE b) AS bypass_count, count(*) FILTER (WHERE is_adaptive) AS adaptive_total,
    count(*) FILTER (WHERE is_adaptive AND NOT b AND llm_prediction = 1) AS adaptive_caught,
    count(*) FILTER (WHERE is_adaptive AND up) AS adaptive_escalated, count(*) FILTER (WHERE NOT is_adaptive) AS other_total,
    count(*) FILTER (WHERE NOT is_adaptive AND up) AS extra_escalations,
    count(*) FILTER (WHERE NOT is_adaptive AND up AND router_score <= {TAU}) AS extra_escalations_of_bypassed,
    count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 0 AND up) AS negative_escalations,
    count(*) FILTER (WHERE label = 0 AND NOT b AND llm_prediction = 1) AS false_positives
  FROM (SELECT *, router_score <= {TAU} AND NOT up AS b FROM {rows}) GROUP BY {k}gate)
SELECT *, 1 - bypass_count / CAST(n AS DOUBLE) AS call_rate, bypass_count / CAST(n AS DOUBLE) AS cost_reduction,
  {q.ratio('adaptive_total - adaptive_caught', 'adaptive_total')} AS adaptive_e2e_fn_rate,
  {q.ratio('extra_escalations', 'other_total')} AS extra_escalation_rate, {q.ratio('false_positives', 'negatives')} AS stream_fpr FROM c"""


GATE_ROWS = " UNION ALL ".join(f"SELECT *, '{g}' AS gate, {cond} AS up FROM planted_docs" for g, cond in GATE_SQL.items())


@query("gate_eval", GATE_SPEC, f"WITH {q.PLANTED}, rows_g AS ({GATE_ROWS}), {gate_sql('rows_g')}")
def gate_eval(spark, d):
    gates = ga.gate_registry(fx.FIXED_PREFIX, fx.LEXICON, 0.5, TAU)
    return ga.evaluate_gates(fx.planted_docs(spark, d), gates, TAU)


@query(
    "root_cause",
    "adaptive_count:i adaptive_bypass_rate:f adaptive_score_max:f expected_adaptive_audited:f counterfactual_miss_rate:f "
    "unique_adaptive_prefixes:i tail_keyword_rate_adaptive:f tail_keyword_rate_other:f full_keyword_rate_other:f "
    "other_score_p05:f reference_score_p05:f",
    f"""WITH {q.PLANTED}, t AS (
  SELECT *, CAST(regexp_matches(lower({TAIL}), 'the|and|that') AS INTEGER) AS tw,
    CAST(regexp_matches(lower(prompt), 'the|and|that') AS INTEGER) AS fw, {PREFIX} AS lead FROM planted_docs)
SELECT count(*) FILTER (WHERE is_adaptive) AS adaptive_count,
  avg(CASE WHEN router_score <= {TAU} THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_adaptive) AS adaptive_bypass_rate,
  max(router_score) FILTER (WHERE is_adaptive) AS adaptive_score_max,
  0.05 * count(*) FILTER (WHERE is_adaptive) AS expected_adaptive_audited,
  {q.ratio(f'count(*) FILTER (WHERE is_adaptive AND router_score <= {TAU} AND llm_prediction = 0)', f'count(*) FILTER (WHERE is_adaptive AND router_score <= {TAU})')} AS counterfactual_miss_rate,
  count(DISTINCT lead) FILTER (WHERE is_adaptive) AS unique_adaptive_prefixes,
  avg(tw) FILTER (WHERE is_adaptive) AS tail_keyword_rate_adaptive, avg(tw) FILTER (WHERE NOT is_adaptive) AS tail_keyword_rate_other,
  avg(fw) FILTER (WHERE NOT is_adaptive) AS full_keyword_rate_other,
  quantile_cont(router_score, 0.05) FILTER (WHERE NOT is_adaptive) AS other_score_p05,
  quantile_cont(router_score, 0.05) FILTER (WHERE stream = 'reference') AS reference_score_p05 FROM t""",
)
def root_cause(spark, d):
    rows = fx.planted_docs(spark, d)
    return ga.root_cause(rows, rows.filter("stream = 'reference'"), TAU, words=fx.DOC_WORDS)


# Three padding variants of the attack rows: fixed, one shared draw, one draw per row.
def variants(spark, d):
    rows = fx.planted_docs(spark, d)
    plain, attack = rows.filter("NOT is_adaptive"), rows.filter("is_adaptive")
    pads = {
        "fixed": F.lit(" ".join(fx.LEXICON[:10])),
        "shared": sa.drawn_padding(fx.LEXICON, 10, 43),
        "per_row": sa.drawn_padding(fx.LEXICON, 10, 44, "sample_id"),
    }
    out = None
    for name, pad in pads.items():
        both = plain.unionByName(sa.padded_prompts(attack, pad)).withColumn("variant", F.lit(name))
        out = both if out is None else out.unionByName(both)
    return out


def drawn_sql(seed: int, row: str) -> str:
    terms = ", ".join(f"{{'k': sha256('{seed}:' || {row} || ':{t}'), 't': '{t}'}}" for t in fx.LEXICON)
    return f"array_to_string(list_transform(list_sort([{terms}])[1:10], lambda x: x.t), ' ')"


PAD_SQL = {
    "fixed": f"'{' '.join(fx.LEXICON[:10])}'",
    "shared": drawn_sql(43, "''"),
    "per_row": drawn_sql(44, "sample_id"),
}
VARIANT_ROWS = " UNION ALL ".join(
    f"SELECT * REPLACE (CASE WHEN is_adaptive THEN {pad} || {GAP} || prompt ELSE prompt END AS prompt), '{name}' AS variant FROM planted_docs"
    for name, pad in PAD_SQL.items()
)
FIXED_START = f"starts_with(prompt, '{' '.join(fx.LEXICON[:10])}')"
VARIANT_GATES = {
    "baseline_np_triage": "FALSE",
    "padding_prefix_fingerprint": FIXED_START,
    "benign_weight_density_gate": "density > density_threshold",
    "tail_keyword_gate": "tail_hit",
    "padding_or_ultra_low": f"({FIXED_START} OR {LOW})",
}
VARIANT_GATE_ROWS = " UNION ALL ".join(f"SELECT *, '{g}' AS gate, {c} AS up FROM measured" for g, c in VARIANT_GATES.items())


@query(
    "variant_gates",
    "variant:s " + GATE_SPEC,
    f"""WITH {q.PLANTED}, v AS ({VARIANT_ROWS}),
limits AS (SELECT variant, quantile_cont({DENSITY}, 0.995) AS density_threshold FROM v WHERE NOT is_adaptive GROUP BY variant),
measured AS (SELECT v.*, {DENSITY} AS density, {WORD} AS tail_hit, l.density_threshold FROM v JOIN limits l ON l.variant = v.variant),
rows_g AS ({VARIANT_GATE_ROWS}), {gate_sql('rows_g', 'variant')}""",
)
def variant_gates(spark, d):
    rows = variants(spark, d)
    limits = ga.density_calibration(rows.filter("NOT is_adaptive"), fx.LEXICON, groups=["variant"])
    joined = join_small(rows, limits.select("variant", "density_threshold"), ["variant"])
    gates = ga.gate_registry(" ".join(fx.LEXICON[:10]), fx.LEXICON, F.col("density_threshold"), TAU)
    kept = {g: gates[g] for g in VARIANT_GATES}
    return ga.evaluate_gates(joined, kept, TAU, ["variant"])


def mix_sql(rate: float) -> str:
    """A holdout stream in which bround(n * rate) rows are replaced by shifted ones."""
    size = f"CAST(round_even((SELECT count(*) FROM judged_events WHERE stream = 'holdout') * {rate}, 0) AS BIGINT)"
    kept = f"((SELECT count(*) FROM judged_events WHERE stream = 'holdout') - {size})"
    base = "(SELECT * FROM judged_events WHERE stream = 'holdout')"
    foreign = "(SELECT * FROM judged_events WHERE stream = 'shifted')"
    return (
        f"SELECT *, 'id' AS component, {rate} AS mixture_rate FROM ({pick(base, kept, '42:base')}) UNION ALL "
        f"SELECT *, 'ood', {rate} FROM ({pick(foreign, size, '42:foreign')})"
    )


MIXED = f"{q.EVENTS}, mixed AS ({' UNION ALL '.join(mix_sql(r) for r in lx.MIX_RATES)})"


def mixtures(spark, d):
    events = fx.judged_events(spark, d)
    base, foreign = events.filter("stream = 'holdout'"), events.filter("stream = 'shifted'")
    return sa.mix_streams(base, foreign, lx.MIX_RATES, 42)


@query(
    "mix_stream",
    "mixture_rate:f component:s sample_id:s",
    f"WITH {MIXED} SELECT mixture_rate, component, sample_id FROM mixed",
)
def mix_stream(spark, d):
    return mixtures(spark, d)


MIX_STREAMS = f"""{MIXED},
watched AS (
  SELECT * REPLACE ('mix_' || CAST(CAST(mixture_rate * 100 AS INTEGER) AS VARCHAR) AS stream) FROM mixed
  UNION ALL SELECT *, 'id', 0 FROM judged_events WHERE stream = 'reference')"""
STATS = "psi:f ks_statistic:f ks_pvalue:f keyword_diff:f"
DECISION = "psi_trigger:b ks_trigger:b keyword_trigger:b shift_detected:b triggers:s"
COST = "call_rate:f cost_reduction:f bypass_count:i false_bypass_count:i false_bypass_rate:f"


def watched(spark, d):
    name = F.concat(F.lit("mix_"), F.round(F.col("mixture_rate") * 100).cast("int").cast("string"))
    mixed = mixtures(spark, d).withColumn("stream", name).drop("component", "mixture_rate")
    reference = fx.judged_events(spark, d).filter("stream = 'reference'")
    return stored(mixed.unionByName(reference.select(*mixed.columns)), "watched")


@query(
    "mixed_shift_probe",
    f"stream:s policy:s n:i positives:i {STATS} {DECISION} {COST} {POLICY}",
    failsafe_sql("watched", MIX_STREAMS, fx.EVENT_TAU),
)
def mixed_shift_probe(spark, d):
    return mo.shift_failsafe(watched(spark, d), fx.EVENT_TAU)


EXPOSURE_SQL = f"""WITH {MIX_STREAMS}, {q.statistics('watched')}, dec AS (SELECT *, {q.decision()} FROM stats),
per AS (
  SELECT stream, count(*) AS n, count(*) FILTER (WHERE router_score <= {fx.EVENT_TAU}) / CAST(count(*) AS DOUBLE) AS naive_reduction,
    count(*) FILTER (WHERE component = 'ood' AND label = 1 AND router_score <= 0.8) AS adaptive_bypass_count
  FROM watched GROUP BY stream)
SELECT p.*, r.audit_rate, 1 - pow(1 - r.audit_rate, adaptive_bypass_count) AS exposure_probability,
  r.audit_rate * adaptive_bypass_count AS expected_audited,
  CASE WHEN shift_detected THEN 0 ELSE r.audit_rate * naive_reduction END AS extra_call_rate,
  CASE WHEN shift_detected THEN 0 ELSE naive_reduction - r.audit_rate * naive_reduction END AS final_reduction
FROM per p JOIN dec d ON p.stream = d.stream, (SELECT CAST(unnest([0.01, 0.05, 0.10]) AS DOUBLE) AS audit_rate) r
WHERE adaptive_bypass_count > 0"""


@query(
    "audit_exposure",
    "stream:s audit_rate:f adaptive_bypass_count:i naive_reduction:f exposure_probability:f expected_audited:f "
    "extra_call_rate:f final_reduction:f",
    EXPOSURE_SQL,
)
def audit_exposure(spark, d):
    """Exposure of the mixed-in positives of each watched stream."""
    rows = watched(spark, d)
    decided = mo.decide(mo.stream_statistics(rows)).select("stream", "shift_detected")
    foreign = F.col("sample_id").isNotNull() & (F.col("router_score") <= 0.8) & (F.col("label") == 1)
    shifted = fx.judged_events(spark, d).filter("stream = 'shifted'").select("sample_id")
    flagged = jo.flag_members(rows, shifted, "is_foreign")
    streams = flagged.groupBy("stream").agg(
        (F.count_if(F.col("router_score") <= fx.EVENT_TAU) / F.count(F.lit(1))).alias("naive_reduction"),
        F.count_if(F.col("is_foreign") & foreign).alias("adaptive_bypass_count"),
    )
    ready = streams.join(decided, "stream").withColumn("failsafe_reduction", F.lit(0.0))
    return po.audit_exposure(ready)


@query(
    "outcome_by_rate",
    "mixture_rate:f n:i router_bypass_count:i judge_would_miss:i judge_would_catch:i observed_e2e_fn_rate:f "
    "counterfactual_e2e_fn_rate:f",
    f"""WITH {MIXED}, a AS (SELECT *, router_score <= 0.8 AS b FROM mixed WHERE component = 'ood'),
c AS (SELECT mixture_rate, count(*) AS n, count(*) FILTER (WHERE b) AS router_bypass_count,
    count(*) FILTER (WHERE b AND llm_prediction = 0) AS judge_would_miss,
    count(*) FILTER (WHERE b AND llm_prediction = 1) AS judge_would_catch,
    count(*) FILTER (WHERE b OR llm_prediction = 0) AS fn FROM a GROUP BY mixture_rate)
SELECT *, {q.ratio('fn', 'n')} AS observed_e2e_fn_rate, {q.ratio('judge_would_miss', 'router_bypass_count')} AS counterfactual_e2e_fn_rate FROM c""",
)
def outcome_by_rate(spark, d):
    added = mixtures(spark, d).filter("component = 'ood'")
    return po.outcome_by_rate(added.withColumn("router_bypass", F.col("router_score") <= 0.8))


@query(
    "id_alignment",
    "sample_id:s label:i router_score:f prompt_chars:i",
    f"WITH {q.DOCS} SELECT sample_id, label, router_score, length(prompt) AS prompt_chars FROM judged_docs WHERE label IS NOT NULL",
)
def id_alignment(spark, d):
    docs = fx.judged_docs(spark, d)
    records = docs.filter("label IS NOT NULL").select("sample_id", "label", "router_score")
    joined = jo.align_records(records, docs.select("sample_id", "label", "prompt"))
    return joined.withColumn("prompt_chars", F.length("prompt"))


@query(
    "alignment_faults",
    "n:i missing:i label_mismatch:i",
    f"""WITH {q.DOCS}, r AS (
  SELECT CASE WHEN position % 50 = 0 THEN 'lost_' || position ELSE sample_id END AS sample_id,
    CASE WHEN position % 7 = 0 THEN 1 - label ELSE label END AS label FROM judged_docs WHERE label IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (WHERE d.sample_id IS NULL) AS missing,
  count(*) FILTER (WHERE d.label <> r.label) AS label_mismatch
FROM r LEFT JOIN judged_docs d ON d.sample_id = r.sample_id""",
)
def alignment_faults(spark, d):
    docs = fx.judged_docs(spark, d)
    p = F.col("position")
    records = docs.filter("label IS NOT NULL").select(
        F.when(p % 50 == 0, F.concat(F.lit("lost_"), p.cast("string"))).otherwise(F.col("sample_id")).alias("sample_id"),
        F.when(p % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"),
    )
    return jo.alignment_faults(records, docs)


@query(
    "judge_lookup",
    "sample_id:s llm_prediction:i label_origin:s",
    f"""WITH {q.EVENTS} SELECT sample_id, CASE WHEN position % 3 = 0 THEN 1 ELSE llm_prediction END AS llm_prediction,
  CASE WHEN position % 3 = 0 THEN 'fresh' WHEN position % 2 = 0 THEN 'base' ELSE 'own' END AS label_origin FROM judged_events""",
)
def judge_lookup(spark, d):
    rows = fx.judged_events(spark, d).select("sample_id", "position", "llm_prediction")
    base = rows.filter(F.col("position") % 2 == 0).select("sample_id", "llm_prediction")
    rerun = rows.filter(F.col("position") % 3 == 0)
    old = rerun.select("sample_id", F.lit(0).alias("llm_prediction"), F.lit(1).alias("run"))
    new = rerun.select("sample_id", F.lit(1).alias("llm_prediction"), F.lit(2).alias("run"))
    fresh = jo.latest(old.unionByName(new), "sample_id", "run")
    return jo.judge_lookup(rows, base, fresh)


@query(
    "judge_lookup_duplicates",
    "sample_id:s llm_prediction:i label_origin:s",
    f"""WITH {q.EVENTS} SELECT sample_id, CASE WHEN position % 3 = 0 THEN 1 ELSE llm_prediction END AS llm_prediction,
  CASE WHEN position % 3 = 0 THEN 'fresh' WHEN position % 2 = 0 THEN 'base' ELSE 'own' END AS label_origin FROM judged_events""",
)
def judge_lookup_duplicates(spark, d):
    """Reruns leave several answers per id in both tables; the last run counts and no row doubles."""
    rows = fx.judged_events(spark, d).select("sample_id", "position", "llm_prediction")
    even, third = rows.filter(F.col("position") % 2 == 0), rows.filter(F.col("position") % 3 == 0)
    base = even.select("sample_id", (1 - F.col("llm_prediction")).alias("llm_prediction"), F.lit(1).alias("run"))
    base = base.unionByName(even.select("sample_id", "llm_prediction", F.lit(2).alias("run")))
    fresh = third.select("sample_id", F.lit(1).alias("llm_prediction"), F.lit(9).alias("run"))
    fresh = fresh.unionByName(third.select("sample_id", F.lit(0).alias("llm_prediction"), F.lit(8).alias("run")))
    return jo.judge_lookup(rows, base, fresh, order="run")


@query(
    "judge_lookup_required",
    "sample_id:s llm_prediction:i label_origin:s",
    f"""WITH {q.EVENTS} SELECT sample_id,
  CASE WHEN position % 3 = 0 THEN 1 WHEN position % 2 = 0 THEN llm_prediction END AS llm_prediction,
  CASE WHEN position % 3 = 0 THEN 'fresh' WHEN position % 2 = 0 THEN 'base' ELSE 'missing' END AS label_origin FROM judged_events""",
)
def judge_lookup_required(spark, d):
    rows = fx.judged_events(spark, d).select("sample_id", "position", "llm_prediction")
    base = rows.filter(F.col("position") % 2 == 0).select("sample_id", "llm_prediction")
    fresh = rows.filter(F.col("position") % 3 == 0).select("sample_id", F.lit(1).alias("llm_prediction"))
    return jo.judge_lookup(rows, base, fresh, own_label=False)


@query(
    "membership_flag",
    "sample_id:s audited_member:b",
    f"WITH {q.EVENTS} SELECT sample_id, audited AS audited_member FROM judged_events",
)
def membership_flag(spark, d):
    rows = fx.judged_events(spark, d).select("sample_id", "audited")
    return jo.flag_members(rows.drop("audited"), rows.filter("audited"), "audited_member")


@query(
    "rescore",
    "sample_id:s router_score:f",
    f"WITH {q.EVENTS} SELECT sample_id, router_score / 2 AS router_score FROM judged_events",
)
def rescore(spark, d):
    rows = fx.judged_events(spark, d).select("sample_id", "router_score")
    new = rows.select("sample_id", (F.col("router_score") / 2).alias("router_score"))
    return jo.replace_scores(rows, new)
