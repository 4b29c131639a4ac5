"""Queries: text features, error categories, dataset audit, release hygiene."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import hashing as hs
from sluice.functions import lexicons as lx
from sluice.functions import text as tx
from sluice.operators import hygiene as hy
from sluice.operators import quality as qu
from sluice.operators import sampling as sa
from sluice.plans import fixtures as fx
from sluice.plans import sql as q
from sluice.plans.registry import query
from sluice.session import scratch_path
from sluice.sources import prompts as pr


@query(
    "keyword_flags",
    "sample_id:s audit_hit:b monitor_hit:b doc_hit:b",
    f"""WITH {q.PLANTED} SELECT sample_id,
  regexp_matches(lower(prompt), '{"|".join(lx.AUDIT_WORDS)}') AS audit_hit,
  regexp_matches(lower(prompt), '{"|".join(lx.MONITOR_WORDS)}') AS monitor_hit,
  regexp_matches(lower(prompt), '{"|".join(fx.DOC_WORDS)}') AS doc_hit FROM planted_docs""",
)
def keyword_flags(spark, d):
    return fx.planted_docs(spark, d).select(
        "sample_id",
        tx.keyword_hit("prompt", lx.AUDIT_WORDS).alias("audit_hit"),
        tx.keyword_hit("prompt", lx.MONITOR_WORDS).alias("monitor_hit"),
        tx.keyword_hit("prompt", fx.DOC_WORDS).alias("doc_hit"),
    )


@query(
    "text_truncate",
    "sample_id:s chars:i judge_chars:i embed_chars:i judge_digest:s excerpt:s",
    f"""WITH {q.DOCS} SELECT sample_id, length(prompt) AS chars, length(substr(prompt, 1, 2400)) AS judge_chars,
  length(substr(prompt, 1, 4000)) AS embed_chars, sha256(substr(prompt, 1, 2400)) AS judge_digest,
  replace(substr(prompt, 1, 240), chr(10), ' ') AS excerpt FROM judged_docs""",
)
def text_truncate(spark, d):
    return fx.judged_docs(spark, d).select(
        "sample_id",
        F.length("prompt").alias("chars"),
        F.length(tx.truncate("prompt", 2400)).alias("judge_chars"),
        F.length(tx.truncate("prompt", 4000)).alias("embed_chars"),
        F.sha2(tx.truncate("prompt", 2400), 256).alias("judge_digest"),
        tx.excerpt("prompt").alias("excerpt"),
    )


GAP = "chr(10) || chr(10)"
PREFIX = f"(CASE WHEN instr(prompt, {GAP}) > 0 THEN substr(prompt, 1, instr(prompt, {GAP}) - 1) ELSE prompt END)"
TAIL = f"(CASE WHEN instr(prompt, {GAP}) > 0 THEN substr(prompt, instr(prompt, {GAP}) + 2) ELSE prompt END)"


@query(
    "prefix_tail",
    "sample_id:s prefix_chars:i tail_chars:i prefix_digest:s tail_digest:s",
    f"""WITH {q.PLANTED} SELECT sample_id, length({PREFIX}) AS prefix_chars, length({TAIL}) AS tail_chars,
  sha256({PREFIX}) AS prefix_digest, sha256({TAIL}) AS tail_digest FROM planted_docs""",
)
def prefix_tail(spark, d):
    p, t = tx.prefix("prompt"), tx.tail("prompt")
    return fx.planted_docs(spark, d).select(
        "sample_id",
        F.length(p).alias("prefix_chars"),
        F.length(t).alias("tail_chars"),
        F.sha2(p, 256).alias("prefix_digest"),
        F.sha2(t, 256).alias("tail_digest"),
    )


NON_ASCII = (
    "(CASE WHEN length(prompt) = 0 THEN 0 ELSE "
    "length(regexp_replace(prompt, '[\\x00-\\x7F]', '', 'g')) / CAST(length(prompt) AS DOUBLE) END)"
)


@query(
    "non_ascii_rate",
    "sample_id:s lang:s rate:f",
    f"WITH {q.DOCS} SELECT sample_id, lang, {NON_ASCII} AS rate FROM judged_docs",
)
def non_ascii_rate(spark, d):
    return fx.judged_docs(spark, d).select("sample_id", "lang", tx.non_ascii_rate("prompt").alias("rate"))


def matches(key: str) -> str:
    return f"regexp_matches(lower(prompt), '{lx.CATEGORY_PATTERNS[key]}')"


CATEGORY = (
    "CASE WHEN lang = 'es' AND contains(lower(prompt), 'instruction') THEN '{probe}' ".format(**lx.CATEGORY_NAMES)
    + " ".join(
        f"WHEN {matches(k)} THEN '{lx.CATEGORY_NAMES[k]}'"
        for k in ("extraction", "override", "probe", "format", "wrapper")
    )
    + f" WHEN {NON_ASCII} > 0.05 OR {matches('foreign')} THEN '{lx.CATEGORY_NAMES['foreign']}'"
    + f" WHEN {matches('pressure')} THEN '{lx.CATEGORY_NAMES['pressure']}'"
    + f" ELSE '{lx.CATEGORY_NAMES['default']}' END"
)


def missed(spark, d):
    rows = fx.planted_docs(spark, d).filter((F.col("label") == 1) & (F.col("llm_prediction") == 0))
    return rows.withColumn("category", tx.error_category("prompt", F.col("lang") == "es"))


@query(
    "error_category_rows",
    "sample_id:s category:s",
    f"WITH {q.PLANTED} SELECT sample_id, {CATEGORY} AS category FROM planted_docs",
)
def error_category_rows(spark, d):
    rows = fx.planted_docs(spark, d)
    return rows.select("sample_id", tx.error_category("prompt", F.col("lang") == "es").alias("category"))


@query(
    "error_categories",
    "lang:s category:s n:i",
    f"""WITH {q.PLANTED} SELECT lang, category, count(*) AS n FROM (
  SELECT lang, {CATEGORY} AS category FROM planted_docs WHERE label = 1 AND llm_prediction = 0) GROUP BY ALL""",
)
def error_categories(spark, d):
    counts = missed(spark, d).groupBy("lang", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("lang", F.col("n").desc(), "category")


@query(
    "topn_examples",
    "category:s place:i sample_id:s router_score:f excerpt:s",
    f"""WITH {q.PLANTED}, m AS (
  SELECT sample_id, router_score, replace(substr(prompt, 1, 240), chr(10), ' ') AS excerpt, {CATEGORY} AS category
  FROM planted_docs WHERE label = 1 AND llm_prediction = 0)
SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('7:' || sample_id), sample_id) AS place
FROM m QUALIFY place <= 3""",
)
def topn_examples(spark, d):
    order = [hs.sample_order(F.col("sample_id"), 7), F.col("sample_id")]
    top = sa.top_per_group(missed(spark, d), 3, ["category"], order)
    return top.withColumn("excerpt", tx.excerpt("prompt"))


@query(
    "dataset_audit",
    "dataset:s level:s member:s n:i keyword_hit_rate:f mean_chars:f duplicate_prompt_rate:f median_chars:f p95_chars:f",
    f"""WITH {q.PROMPTS}, r AS (
  SELECT *, length(prompt) AS chars,
    CASE WHEN regexp_matches(lower(prompt), '{"|".join(fx.DOC_WORDS)}') THEN 1 ELSE 0 END AS hit FROM prompts),
x AS (
  SELECT dataset, CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(split) = 0 THEN 'split' ELSE 'dataset' END AS level,
    CASE WHEN grouping(label) = 0 THEN CAST(label AS VARCHAR) WHEN grouping(split) = 0 THEN split ELSE dataset END AS member,
    count(*) AS n, avg(hit) AS keyword_hit_rate, avg(chars) AS mean_chars,
    1 - count(DISTINCT prompt) / CAST(count(*) AS DOUBLE) AS dup, quantile_cont(chars, 0.5) AS med, quantile_cont(chars, 0.95) AS p95
  FROM r GROUP BY GROUPING SETS ((dataset), (dataset, label), (dataset, split)))
SELECT *, CASE WHEN level = 'dataset' THEN dup END AS duplicate_prompt_rate,
  CASE WHEN level <> 'split' THEN med END AS median_chars, CASE WHEN level <> 'split' THEN p95 END AS p95_chars FROM x""",
)
def dataset_audit(spark, d):
    return qu.dataset_audit(fx.prompts(spark, d), fx.DOC_WORDS)


@query(
    "score_summary",
    "stream:s n:i min:f p01:f p05:f p50:f p95:f p99:f max:f bypass_rate_0:f bypass_rate_1:f bypass_rate_2:f",
    f"""WITH {q.EVENTS} SELECT stream, count(*) AS n, min(router_score) AS min, quantile_cont(router_score, 0.01) AS p01,
  quantile_cont(router_score, 0.05) AS p05, quantile_cont(router_score, 0.5) AS p50, quantile_cont(router_score, 0.95) AS p95,
  quantile_cont(router_score, 0.99) AS p99, max(router_score) AS max,
  count(*) FILTER (WHERE router_score <= 0.01) / CAST(count(*) AS DOUBLE) AS bypass_rate_0,
  count(*) FILTER (WHERE router_score <= {lx.DEPLOYED_TAU}) / CAST(count(*) AS DOUBLE) AS bypass_rate_1,
  count(*) FILTER (WHERE router_score <= 0.03) / CAST(count(*) AS DOUBLE) AS bypass_rate_2
FROM judged_events GROUP BY stream""",
)
def score_summary(spark, d):
    return qu.score_summary(fx.judged_events(spark, d), groups=["stream"])


@query(
    "union_dedupe",
    "sample_id:s dataset:s split:s label:i",
    f"WITH {q.PROMPTS} SELECT DISTINCT sample_id, dataset, split, label FROM prompts",
)
def union_dedupe(spark, d):
    p = fx.prompts(spark, d).select("sample_id", "dataset", "split", "label")
    parts = [p.filter(F.col("split") == s) for s in ("train", "validation", "test")]
    return pr.concat_splits([*parts, p.filter(F.col("split") == "train")])


@query(
    "distinct_texts",
    "sample_id:s",
    f"WITH {q.PROMPTS} SELECT min(sample_id) AS sample_id FROM prompts GROUP BY prompt",
)
def distinct_texts(spark, d):
    return pr.distinct_texts(fx.prompts(spark, d).select("sample_id", "prompt"))


@query(
    "partitioned_write",
    "dataset:s split:s n:i positives:i",
    f"WITH {q.PROMPTS} SELECT dataset, split, count(*) AS n, sum(label) AS positives FROM prompts GROUP BY ALL",
)
def partitioned_write(spark, d):
    path = scratch_path(spark, "prompts")
    pr.write_prompts(fx.prompts(spark, d), path)
    back = spark.read.parquet(path)
    return back.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


REDACT_TERMS = ["the "]


def redact_sql(column: str) -> str:
    out = column
    for p in lx.PATH_PATTERNS:
        out = f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '<local-path>', 'g')"
    return f"replace({out}, '{REDACT_TERMS[0]}', '<anonymous>')"


@query(
    "redact",
    "sample_id:s prompt:s",
    f"WITH {q.PLANTED} SELECT sample_id, {redact_sql('prompt')} AS prompt FROM planted_docs",
)
def redact(spark, d):
    return hy.redact(fx.planted_docs(spark, d).select("sample_id", "prompt"), REDACT_TERMS)


EXTRA_RULES = {
    "e_mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "long_hex": r"[0-9a-f]{32,}",
    "token": r"token\s*=",
}
RULES = {**lx.LEAK_PATTERNS, **EXTRA_RULES}
SCAN = " UNION ALL ".join(
    f"SELECT sample_id, '{name}' AS rule FROM planted_docs WHERE regexp_matches(prompt, '{p.replace(chr(39), chr(39) * 2)}')"
    for name, p in RULES.items()
)


@query("leak_scan", "sample_id:s rule:s", f"WITH {q.PLANTED} {SCAN}")
def leak_scan(spark, d):
    return hy.leak_scan(fx.planted_docs(spark, d), "prompt", ["sample_id"], rules=RULES)


@query(
    "leak_counts", "rule:s n:i", f"WITH {q.PLANTED} SELECT rule, count(*) AS n FROM ({SCAN}) GROUP BY rule"
)
def leak_counts(spark, d):
    return hy.leak_counts(hy.leak_scan(fx.planted_docs(spark, d), "prompt", ["sample_id"], rules=RULES))


def released(spark, d):
    """Nested result rows as an experiment would write them, one per document."""
    p = fx.planted_docs(spark, d)
    record = F.struct("sample_id", "prompt", "router_score", "llm_prediction")
    return p.select(
        "sample_id",
        "lang",
        F.struct(F.col("label").alias("label"), F.array(record).alias("records"), F.array(record).alias("rows")).alias("detail"),
        F.create_map(F.lit("prompt"), F.col("prompt"), F.lit("stream"), F.col("stream")).alias("notes"),
    )


@query(
    "drop_private",
    "sample_id:s lang:s label:i router_score:f llm_prediction:i fields:s note_keys:s",
    f"""WITH {q.PLANTED} SELECT sample_id, lang, label, router_score, llm_prediction,
  'sample_id,router_score,llm_prediction' AS fields, 'stream' AS note_keys FROM planted_docs""",
)
def drop_private(spark, d):
    clean = hy.drop_private(released(spark, d))
    row = clean.schema["detail"].dataType["rows"].dataType.elementType
    return clean.select(
        "sample_id",
        "lang",
        "detail.label",
        F.col("detail.rows")[0]["router_score"].alias("router_score"),
        F.col("detail.rows")[0]["llm_prediction"].alias("llm_prediction"),
        F.lit(",".join(f.name for f in row.fields)).alias("fields"),
        F.array_join(F.map_keys("notes"), ",").alias("note_keys"),
    )


@query(
    "forbidden_fields",
    "key:s n:i",
    f"WITH {q.PLANTED} SELECT key, count(*) AS n FROM planted_docs, (SELECT unnest(['records', 'prompt']) AS key) GROUP BY key",
)
def forbidden_fields(spark, d):
    rows = released(spark, d)
    if "detail.records" not in hy.forbidden_paths(rows.schema):
        raise ValueError("schema walk missed a forbidden field")
    if hy.forbidden_paths(hy.drop_private(rows).schema):
        raise ValueError("a forbidden field survived")
    assert isinstance(rows.schema, T.StructType)
    payload = F.to_json(F.struct("*"))
    escaped = F.replace(payload, F.lit('"prompt":'), F.lit('"pr\\u006fmpt":'))  # the same key for every reader of JSON
    third = F.pmod(F.crc32(F.col("sample_id").cast("binary")), F.lit(3)) == 0
    return hy.forbidden_json_keys(rows.select(F.when(third, escaped).otherwise(payload).alias("payload")), "payload")


@query(
    "leak_paths",
    "sample_id:s path:s rule:s",
    f"""WITH {q.PLANTED}, hits AS ({SCAN})
SELECT sample_id, path, rule FROM hits, (SELECT unnest(['detail.records[0].prompt', 'detail.rows[0].prompt', 'notes.prompt', 'payload.more[1].text']) AS path)""",
)
def leak_paths(spark, d):
    """The whole nested frame, a JSON text among its columns."""
    rows = released(spark, d)
    more = F.to_json(F.struct(F.array(F.struct(F.lit("clean").alias("text")), F.struct(F.col("notes")["prompt"].alias("text"))).alias("more")))
    return hy.leak_paths(rows.withColumn("payload", more), ["sample_id"], rules=RULES, json_columns=["payload"])
