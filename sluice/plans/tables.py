"""Queries: records, resume, vectors, detectors on judged ids, report table."""

import hashlib

from pyspark.sql import functions as F

from sluice.operators import joins as jo
from sluice.operators import judge as ju
from sluice.operators import ledger as le
from sluice.operators import monitor as mo
from sluice.operators import policy as po
from sluice.operators import quality as qu
from sluice.operators import report as rp
from sluice.operators import sampling as sa
from sluice.plans import calibrations, gating, modelling  # noqa: F401  (their finished tables are sections)
from sluice.plans import fixtures as fx
from sluice.plans import sql as q
from sluice.plans.attempts import OUTCOME, session_summary, summary_side
from sluice.plans.gating import GATE_ROWS, gate_eval, gate_sql
from sluice.plans.policies import POLICY_SQL, failsafe_sql
from sluice.plans.registry import ENTRIES, query
from sluice.plans.texts import CATEGORY, error_categories
from sluice.session import scratch_path, stored
from sluice.sources import judged as js
from sluice.sources import vectors as ve

TAU = fx.EVENT_TAU
PAGE = 100


def judged_records(spark, d):
    """Judged events with token usage, as the judge job writes them."""
    e = fx.judged_events(spark, d)
    words = F.col("prompt_length").cast("bigint")
    usage = F.struct(words.alias("prompt_tokens"), F.lit(5).cast("bigint").alias("completion_tokens"), (words + 5).alias("total_tokens"))
    reused = F.col("position") % 10 == 0
    return e.select(
        "position",
        F.col("position").alias("row_index"),
        "sample_id",
        "label",
        "router_score",
        "llm_prediction",
        F.lit("by rule").alias("reason"),
        F.when(~reused, usage).alias("usage"),
        reused.alias("reused"),
        "stream",
    )


@query(
    "records_inline",
    "dataset:s position:i sample_id:s label:i router_score:f llm_prediction:i total_tokens:i reused:b",
    f"""WITH {q.EVENTS} SELECT stream AS dataset, *, CASE WHEN position % 10 <> 0 THEN prompt_length + 5 END AS total_tokens,
  position % 10 = 0 AS reused FROM judged_events""",
)
def records_inline(spark, d):
    """Result payloads of at most a page of records each, written as JSON and read back."""
    rows = judged_records(spark, d)
    page = F.floor(F.col("position") / PAGE)
    fields = [f.name for f in js.RECORD.fields]
    payloads = rows.groupBy(F.col("stream").alias("dataset"), page.alias("_page")).agg(
        F.collect_list(F.struct(*fields)).alias("records")
    )
    path = scratch_path(spark, "payloads")
    js.write_metrics(payloads.drop("_page"), path, "json")
    return js.read_judged_json(spark, path, multi_line=False).withColumn("total_tokens", F.col("usage.total_tokens"))


@query(
    "usage_totals",
    "stream:s prompt_tokens:i completion_tokens:i total_tokens:i reused_records:i n:i",
    f"""WITH {q.EVENTS} SELECT stream, coalesce(sum(prompt_length) FILTER (WHERE position % 10 <> 0), 0) AS prompt_tokens,
  5 * count(*) FILTER (WHERE position % 10 <> 0) AS completion_tokens,
  coalesce(sum(prompt_length + 5) FILTER (WHERE position % 10 <> 0), 0) AS total_tokens,
  count(*) FILTER (WHERE position % 10 = 0) AS reused_records, count(*) AS n FROM judged_events GROUP BY stream""",
)
def usage_totals(spark, d):
    return qu.usage_totals(judged_records(spark, d), ["stream"])


@query(
    "resume_pending",
    "sample_id:s llm_prediction:i reused:b",
    f"""WITH {q.DOCS} SELECT sample_id, CASE WHEN position % 4 = 0 THEN llm_prediction
  ELSE CAST(contains(substr(prompt, 1, 2400), '?') AS INTEGER) END AS llm_prediction, position % 4 = 0 AS reused FROM judged_docs""",
)
def resume_pending(spark, d):
    """A quarter of the rows is on record; only the others are judged and appended."""
    docs = fx.judged_docs(spark, d)
    path = scratch_path(spark, "judged")
    on_record = docs.filter(F.col("position") % 4 == 0).select("sample_id", "llm_prediction", F.lit(True).alias("reused"))
    js.append_judged(on_record, path)
    done = spark.read.parquet(path)
    fresh = ju.judge_rows(jo.pending_rows(docs, done), ju.rule_judge)
    js.append_judged(fresh.select("sample_id", "llm_prediction", F.lit(False).alias("reused")), path)
    return spark.read.parquet(path)


def flaky_judge(text: str) -> dict:
    """The rule judge, failing on texts that a hash draws (one in sixteen)."""
    if hashlib.md5(text.encode()).hexdigest()[0] == "0":
        raise TimeoutError("rate limit")
    return ju.rule_judge(text)


@query(
    "judge_retry",
    "sample_id:s llm_prediction:i run:i",
    f"""WITH {q.DOCS} SELECT sample_id, CAST(contains(substr(prompt, 1, 2400), '?') AS INTEGER) AS llm_prediction,
  CASE WHEN starts_with(md5(substr(prompt, 1, 2400)), '0') THEN 2 ELSE 1 END AS run FROM judged_docs""",
)
def judge_retry(spark, d):
    """A first run fails on some rows and records the errors; the second judges just those."""
    docs = fx.judged_docs(spark, d)
    path = scratch_path(spark, "retried")
    for run, judge in ((1, flaky_judge), (2, ju.rule_judge)):
        todo = docs if run == 1 else jo.pending_rows(docs, spark.read.parquet(path))
        answers = ju.judge_rows(todo, judge, retries=0)
        js.append_judged(answers.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).filter("error IS NULL")


@query(
    "judge_batch",
    "sample_id:s llm_prediction:i reason:s error:s",
    f"""WITH {q.DOCS} SELECT sample_id, CAST(contains(substr(prompt, 1, 2400), '?') AS INTEGER) AS llm_prediction,
  CASE WHEN contains(substr(prompt, 1, 2400), '?') THEN 'asks a question' ELSE 'no question' END AS reason, NULL AS error
FROM judged_docs""",
)
def judge_batch(spark, d):
    return ju.judge_rows(fx.judged_docs(spark, d), ju.rule_judge)


CHANGED = "CASE WHEN position % 8 = 0 THEN 'Is this changed? ' || prompt ELSE prompt END"


def changed(docs):
    """Every eighth text has changed since it was first seen."""
    return docs.withColumn("prompt", F.when(F.col("position") % 8 == 0, F.concat(F.lit("Is this changed? "), "prompt")).otherwise(F.col("prompt")))


@query(
    "judge_ledger",
    "sample_id:s position:i label:i router_score:f llm_prediction:i reason:s total_tokens:i reused:b",
    f"""WITH {q.DOCS}, now AS (SELECT *, substr({CHANGED}, 1, 2400) AS t FROM judged_docs)
SELECT sample_id, position, label, router_score, CAST(contains(t, '?') AS INTEGER) AS llm_prediction,
  CASE WHEN contains(t, '?') THEN 'asks a question' ELSE 'no question' END AS reason,
  len(regexp_extract_all(t, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+')) + 1 AS total_tokens, position % 4 = 0 AND position % 8 <> 0 AS reused FROM now""",
)
def judge_ledger(spark, d):
    """A quarter is judged first; of these every second text changes, so its answer no longer serves."""
    docs = fx.judged_docs(spark, d).select("sample_id", "position", "label", "router_score", "prompt")
    path = scratch_path(spark, "ledger")
    le.judged_records(docs.filter("position % 4 = 0"), ju.rule_judge, path)
    return le.judged_records(changed(docs), ju.rule_judge, path).withColumn("total_tokens", F.col("usage.total_tokens"))


@query(
    "embed_resume",
    "sample_id:s chars:f dim:i reused:b",
    f"""WITH {q.DOCS}, now AS (SELECT *, substr({CHANGED}, 1, 4000) AS t FROM judged_docs)
SELECT sample_id, length(t) AS chars, 4 AS dim, position % 4 = 0 AND position % 8 <> 0 AS reused FROM now""",
)
def embed_resume(spark, d):
    docs = fx.judged_docs(spark, d).select("sample_id", "position", "prompt")
    path = scratch_path(spark, "vectors")
    le.embedded_rows(docs.filter("position % 4 = 0"), ju.length_embedder, path)
    rows = le.embedded_rows(changed(docs), ju.length_embedder, path)
    return rows.select("sample_id", F.col("embedding")[0].alias("chars"), F.size("embedding").alias("dim"), "reused")


@query(
    "cascade_run",
    "sample_id:s route:s prediction:i",
    f"""WITH {q.DOCS}, r AS (
  SELECT *, CASE WHEN router_score > 0.4 THEN 'judge' WHEN {q.bucket("sample_id || ':audit:0'")} < 0.05 THEN 'audit' ELSE 'bypass' END AS route
  FROM judged_docs)
SELECT sample_id, route, CASE WHEN route = 'bypass' THEN 0 ELSE CAST(contains(substr(prompt, 1, 2400), '?') AS INTEGER) END AS prediction FROM r""",
)
def cascade_run(spark, d):
    return ju.run_cascade(fx.judged_docs(spark, d), ju.rule_judge, 0.4, 0.05, ledger=scratch_path(spark, "ledger"))


@query(
    "embed_batch",
    "sample_id:s chars:f spaces:f dim:i",
    f"""WITH {q.DOCS} SELECT sample_id, length(substr(prompt, 1, 4000)) AS chars,
  length(substr(prompt, 1, 4000)) - length(replace(substr(prompt, 1, 4000), ' ', '')) AS spaces, 4 AS dim FROM judged_docs""",
)
def embed_batch(spark, d):
    v = ju.embed_rows(fx.judged_docs(spark, d), ju.length_embedder)
    return v.select("sample_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("spaces"), F.size("embedding").alias("dim"))


@query(
    "embedding_join",
    "sample_id:s label:i dim:i first_value:f",
    f"WITH {q.VECTORS} SELECT sample_id, label, len(embedding) AS dim, embedding[1] AS first_value FROM vectors",
)
def embedding_join(spark, d):
    v = fx.vectors(spark, d)
    joined = ve.with_embeddings(v.select("sample_id", "label"), v)
    return joined.select("sample_id", "label", F.size("embedding").alias("dim"), F.col("embedding")[0].alias("first_value"))


@query(
    "embedding_coverage",
    "n_rows:i n_vectors:i rows_without_vector:i vectors_without_row:i min_dim:i max_dim:i",
    f"""WITH {q.VECTORS}, r AS (SELECT sample_id FROM vectors WHERE vec_id % 10 <> 0), v AS (SELECT * FROM vectors WHERE vec_id % 7 <> 0)
SELECT count(r.sample_id) AS n_rows, count(v.sample_id) AS n_vectors,
  count(*) FILTER (WHERE v.sample_id IS NULL) AS rows_without_vector, count(*) FILTER (WHERE r.sample_id IS NULL) AS vectors_without_row,
  min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM r FULL JOIN v ON r.sample_id = v.sample_id""",
)
def embedding_coverage(spark, d):
    v = fx.vectors(spark, d)
    return jo.embedding_coverage(v.filter(F.col("vec_id") % 10 != 0), v.filter(F.col("vec_id") % 7 != 0))


@query(
    "positional_slice",
    "part:s position:i sample_id:s",
    f"""WITH {q.EVENTS} SELECT CASE WHEN position < (SELECT count(*) // 3 FROM events) THEN 'reference' ELSE 'holdout' END AS part,
  position, sample_id FROM judged_events ORDER BY position""",
)
def positional_slice(spark, d):
    rows = fx.judged_events(spark, d)
    third = rows.agg(F.floor(F.count(F.lit(1)) / 3)).scalar()
    part = F.when(F.col("position") < third, "reference").otherwise("holdout")
    return rows.withColumn("part", part).orderBy("position")


DETECTORS = {"router": ("router_score", 0.5, 0.2), "sharp": ("router_score * router_score", 0.4, 0.1)}


@query(
    "same_subset",
    "subset:s detector:s threshold_name:s n:i tn:i fp:i fn:i tp:i accuracy:f balanced_accuracy:f precision:f recall:f specificity:f f1:f",
    f"""WITH {q.EVENTS}, a AS ("""
    + " UNION ALL ".join(
        f"SELECT stream AS subset, '{name}' AS detector, '{t}' AS threshold_name, label, CASE WHEN {s} >= {v} THEN 1 ELSE 0 END AS p FROM judged_events"
        for name, (s, b, r) in DETECTORS.items()
        for t, v in (("best_f1", b), ("recall_ge_0_99", r))
    )
    + f""" UNION ALL SELECT stream, 'judge', '--', label, llm_prediction FROM judged_events),
c AS (SELECT subset, detector, threshold_name, count(*) AS n, {q.confusion('p')} FROM a GROUP BY ALL) SELECT *, {q.RATES} FROM c""",
)
def same_subset(spark, d):
    rows = fx.judged_events(spark, d)
    judged = rows.select(F.col("stream").alias("subset"), "sample_id", "label", "llm_prediction")
    per_detector = F.array(
        *[F.struct(F.lit(n).alias("detector"), F.expr(s).alias("score")) for n, (s, _, _) in DETECTORS.items()]
    )
    scores = rows.select("sample_id", F.explode(per_detector).alias("x")).select("sample_id", "x.detector", "x.score")
    values = [(n, t, v) for n, (_, b, r) in DETECTORS.items() for t, v in (("best_f1", b), ("recall_ge_0_99", r))]
    thresholds = spark.createDataFrame(values, "detector string, threshold_name string, threshold double")
    return jo.same_subset(judged, scores, thresholds)


@query(
    "metric_sink",
    "stream:s n:i f1:f cost_reduction:f",
    POLICY_SQL.format(tau=TAU),
)
def metric_sink(spark, d):
    path = scratch_path(spark, "metrics")
    figures = po.evaluate_policy(fx.judged_events(spark, d), TAU, ["stream"])
    js.write_metrics(figures, path, "json")
    return spark.read.schema(figures.schema).json(path)


def fixed(column: str) -> str:
    return f"printf('%.3f', {column}) AS {column}"


def shown(column: str) -> str:
    return f"printf('%.1f%%', {column} * 100.0)"


DASHES = ", ".join(["'--'"] * 6)
QUALITY = ", ".join(fixed(c) for c in ("accuracy", '"precision"', "recall", "specificity", "f1"))
CELLS = "concat_ws('/', tn, fp, fn, tp) AS confusion"
FB = f"CASE WHEN false_bypass_rate IS NULL THEN '--' ELSE false_bypass_count || ' (' || {shown('false_bypass_rate')} || ')' END AS false_bypass"


#: Further sections, each from the finished table of a query: name, call reduction, note.
SECTIONS = {
    "same_subset": ("same_subset", [("subset", "i"), " ", ("detector", "i"), " ", ("threshold_name", "i")], None, ["F1 ", ("f1", "n"), ", recall ", ("recall", "n"), " of ", ("n", "i")]),
    "detectors": ("suite_figures", [("stream", "i"), " ", ("policy", "i")], "cost_reduction", ["F1 ", ("f1", "n"), ", ", ("false_bypass_count", "i"), "/", ("positives", "i"), " passed"]),
    "mixed": ("mixed_shift_probe", [("stream", "i"), " ", ("policy", "i")], "cost_reduction", [("triggers", "i"), ", PSI ", ("psi", "n"), ", KS p ", ("ks_pvalue", "n"), ", keywords ", ("keyword_diff", "n")]),
    "audit": ("audit_policy", [("stream", "i")], "cost_reduction", [("adaptive_audited_count", "i"), "/", ("adaptive_count", "i"), " audited, ", ("adaptive_caught_when_audited", "i"), " caught"]),
    "seeds": ("audit_seed_sensitivity", [("seeds", "i"), " seeds"], None, [("mean_adaptive_e2e_fn_rate", "p"), " missed, ", ("mean_adaptive_audited_count", "n"), " audited"]),
    "calibration": ("np_threshold_by_stream", [("stream", "i")], None, ["tau ", ("tau_safe", "n"), ", ", ("false_bypass_count", "i"), " of ", ("max_allowed", "i"), " allowed, feasible ", ("feasible", "i")]),
    "confirmation": ("hash_split_confirm", [("selection", "i")], "call_reduction", ["upper ", ("cp_upper", "n"), ", passes ", ("passes", "i")]),
    "by_rate": ("outcome_by_rate", [("mixture_rate", "p")], None, [("observed_e2e_fn_rate", "p"), " missed, ", ("judge_would_catch", "i"), " catchable of ", ("router_bypass_count", "i")]),
    "statistics": ("shift_failsafe", [("stream", "i"), " ", ("policy", "i")], "cost_reduction", ["PSI ", ("psi", "n"), ", KS p ", ("ks_pvalue", "n"), ", keywords ", ("keyword_diff", "n")]),
    "usage": ("usage_totals", [("stream", "i")], None, [("total_tokens", "i"), " tokens, ", ("reused_records", "i"), "/", ("n", "i"), " reused"]),
}
FORMS = {"i": "coalesce(CAST({0} AS VARCHAR), '--')", "n": "coalesce(printf('%.3f', {0}), '--')", "p": "coalesce(printf('%.1f%%', {0} * 100.0), '--')"}


def text_sql(parts) -> str:
    return " || ".join(f"'{p}'" if isinstance(p, str) else FORMS[p[1]].format(p[0]) for p in parts)


def section_sql(section: str) -> str:
    source, name, reduction, note = SECTIONS[section]
    shown_reduction = FORMS["p"].format(reduction) if reduction else "'--'"
    return f"SELECT '{section}', {text_sql(name)}, {DASHES}, {shown_reduction}, '--', '--', '--', {text_sql(note)} FROM ({ENTRIES[source].oracle()})"


def section_rows(spark, d, section: str):
    source, name, reduction, note = SECTIONS[section]
    figures = stored(ENTRIES[source].run(spark, d), section)
    return rp.note_rows(figures, section, rp.note_text(name), F.col(reduction) if reduction else None, rp.note_text(note))


@query(
    "report_table",
    "section:s name:s accuracy:s precision:s recall:s specificity:s f1:s confusion:s call_reduction:s call_rate:s triggers:s false_bypass:s note:s",
    f"""SELECT 'judge' AS section, stream AS name, {QUALITY}, {CELLS}, '--' AS call_reduction, '--' AS call_rate, '--' AS triggers, '--' AS false_bypass, '--' AS note
FROM ({POLICY_SQL.format(tau=-1)})
UNION ALL
SELECT 'cascade', stream || ' at ' || {TAU}, {QUALITY}, {CELLS}, {shown('cost_reduction')}, {shown('call_rate')}, 'off', {FB}, '--'
FROM ({POLICY_SQL.format(tau=TAU)})
UNION ALL
SELECT 'monitor', stream || ' ' || policy, {QUALITY}, {CELLS}, {shown('cost_reduction')}, {shown('call_rate')}, triggers, {FB}, '--'
FROM ({failsafe_sql('judged_events', q.EVENTS, TAU)})
UNION ALL
SELECT 'gates', gate, {DASHES}, {shown('cost_reduction')}, '--', '--', '--',
  adaptive_caught || '/' || adaptive_total || ', ' || {shown('adaptive_e2e_fn_rate')} || ' missed, ' || {shown('extra_escalation_rate')} || ' extra'
FROM (WITH {q.PLANTED}, rows_g AS ({GATE_ROWS}), {gate_sql('rows_g')})
UNION ALL
SELECT 'sessions', policy, {DASHES}, '--', '--', '--', '--',
  {shown('mean_fn_rate')} || ' missed, ' || {shown('quarantine_rate')} || ' quarantined'
FROM (WITH {OUTCOME} {summary_side('audit_only')} UNION ALL {summary_side('quarantine')})
UNION ALL
SELECT 'missed', lang, {DASHES}, '--', '--', '--', '--', string_agg(category || ': ' || n, '; ' ORDER BY n DESC, category)
FROM (WITH {q.PLANTED} SELECT lang, category, count(*) AS n FROM (
  SELECT lang, {CATEGORY} AS category FROM planted_docs WHERE label = 1 AND llm_prediction = 0) GROUP BY lang, category
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, category) <= 3) GROUP BY lang
UNION ALL
{" UNION ALL ".join(map(section_sql, SECTIONS))}
UNION ALL SELECT 'embedding', 'missing', {DASHES}, '--', '--', '--', '--', 'no input'""",
)
def report_table(spark, d):
    # The report reads finished metric tables, as it does in operation.
    rows = fx.judged_events(spark, d)
    judge_only = qu.confusion(rows, F.col("llm_prediction"), ["stream"])
    cascade = po.evaluate_policy(rows, TAU, ["stream"])
    watched = stored(mo.shift_failsafe(rows, TAU), "watched")
    gates = stored(gate_eval(spark, d), "gates")
    gate_note = F.concat(
        rp.caught_text(F.col("adaptive_caught"), F.col("adaptive_total"), F.col("adaptive_e2e_fn_rate")),
        F.lit(", "), rp.percent(F.col("extra_escalation_rate")), F.lit(" extra"),
    )
    sessions = stored(session_summary(spark, d), "sessions")
    session_note = F.concat(
        rp.percent(F.col("mean_fn_rate")), F.lit(" missed, "), rp.percent(F.col("quarantine_rate")), F.lit(" quarantined")
    )
    counts = stored(error_categories(spark, d), "categories")
    top = sa.top_per_group(counts, 3, ["lang"], [F.col("n").desc(), F.col("category")])
    line = F.struct("place", F.concat(F.col("category"), F.lit(": "), F.col("n").cast("string")).alias("t"))
    missed = top.groupBy("lang").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    missed_note = F.array_join(F.transform("lines", lambda x: x["t"]), "; ")
    return rp.report_table(
        {
            "judge": rp.metric_rows(judge_only, "judge", F.col("stream")),
            "cascade": rp.policy_rows(cascade, "cascade", F.concat(F.col("stream"), F.lit(f" at {TAU}"))),
            "monitor": rp.policy_rows(watched, "monitor", F.concat_ws(" ", "stream", "policy"), F.col("triggers")),
            "gates": rp.note_rows(gates, "gates", F.col("gate"), F.col("cost_reduction"), gate_note),
            "sessions": rp.note_rows(sessions, "sessions", F.col("policy"), None, session_note),
            "missed": rp.note_rows(missed, "missed", F.col("lang"), None, missed_note),
            **{section: section_rows(spark, d, section) for section in SECTIONS},
            "embedding": None,
        }
    )
