"""The fixture views and recurring formulas in SQL, for the oracles."""

from __future__ import annotations

from sluice.functions import lexicons as lx
from sluice.plans import fixtures as fx


def bucket(x: str) -> str:
    return f"(CAST(CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967295 AS DOUBLE))"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def literal(text: str) -> str:
    """A string literal, with line breaks spelled out."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


EVENTS = f"""base_events AS (
  SELECT 'ev_' || event_id AS sample_id, event_id AS position, ts, user_id AS session_id,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value, event_type
  FROM events),
judged_events AS (
  SELECT sample_id, position, ts, session_id, label,
    value * (1 + label) / (value * (1 + label) + CAST(50 AS DOUBLE)) AS router_score,
    CASE WHEN {bucket("sample_id || ':judge:0'")} < 0.1 THEN 1 - label ELSE label END AS llm_prediction,
    {bucket("sample_id || ':audit:0'")} < 0.05 AS audited,
    CASE WHEN ts < TIMESTAMP '{fx.REFERENCE_END}' THEN 'reference'
         WHEN value > 60 THEN 'shifted' ELSE 'holdout' END AS stream,
    CAST(floor(value * 10) AS INTEGER) AS prompt_length,
    regexp_matches(lower(event_type), '{"|".join(fx.EVENT_WORDS)}') AS keyword_hit
  FROM base_events)"""

ATTEMPTS = EVENTS + """,
attempts AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, position) AS attempt_no
  FROM judged_events)"""

DOCS = f"""joined_docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.toxic, l.quality, 'doc_' || d.doc_id AS sample_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
judged_docs AS (
  SELECT sample_id, doc_id AS position, text AS prompt, lang, toxic AS label,
    n_chars * (1 + coalesce(toxic, 0)) / (n_chars * (1 + coalesce(toxic, 0)) + CAST(2000 AS DOUBLE)) AS router_score,
    CASE WHEN {bucket("sample_id || ':judge:0'")} < 0.1 THEN 1 - coalesce(toxic, 0) ELSE coalesce(toxic, 0) END AS llm_prediction,
    regexp_matches(lower(text), '{"|".join(fx.DOC_WORDS)}') AS keyword_hit,
    length(text) AS prompt_length,
    CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'reference' ELSE lang END AS stream
  FROM joined_docs)"""

PLANTED = DOCS + f""",
planted_labels AS (
  SELECT *, doc_id % 10 <= 1 AS is_adaptive,
    CASE WHEN doc_id % 10 <= 1 THEN 1 ELSE coalesce(toxic, 0) END AS label FROM joined_docs),
planted_docs AS (
  SELECT sample_id, doc_id AS position, lang, is_adaptive, label,
    CASE doc_id % 10
      WHEN 0 THEN '{fx.FIXED_PREFIX}' || chr(10) || chr(10) || text
      WHEN 1 THEN '{" ".join(fx.PLANTED_WORDS)}' || chr(10) || chr(10) || text
      WHEN 2 THEN text || 'AKIA' || upper(substr(sha256(sample_id), 1, 16))
      WHEN 3 THEN text || ' /home/user1/file.txt'
      ELSE text END AS prompt,
    n_chars / (n_chars + CASE WHEN is_adaptive THEN CAST(200000 AS DOUBLE) ELSE CAST(2000 AS DOUBLE) END) AS router_score,
    CASE WHEN {bucket("sample_id || ':judge:0'")} < 0.1 THEN 1 - label ELSE label END AS llm_prediction,
    CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'reference' ELSE lang END AS stream
  FROM planted_labels)"""

PROMPTS = DOCS + """,
prompts AS (
  SELECT lang || '_' || split || '_' || doc_id AS sample_id, text AS prompt, coalesce(toxic, 0) AS label,
    lang AS dataset, split, doc_id AS source_doc_id, lang AS source_lang, source AS source_source,
    quality AS source_quality
  FROM (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split
        FROM joined_docs))"""

VECTORS = """vectors AS (
  SELECT 'vec_' || vec_id AS sample_id, vec_id, embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label
  FROM embeddings)"""


def ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif({den}, 0), 0)"


RATES = f"""{ratio('tn + tp', 'tn + fp + fn + tp')} AS accuracy,
  CASE WHEN fn + tp = 0 THEN {ratio('tn', 'tn + fp')} WHEN tn + fp = 0 THEN {ratio('tp', 'fn + tp')}
    ELSE ({ratio('tp', 'fn + tp')} + {ratio('tn', 'tn + fp')}) / 2 END AS balanced_accuracy,
  {ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'fn + tp')} AS recall,
  {ratio('tn', 'tn + fp')} AS specificity, {ratio('fp', 'tn + fp')} AS fpr, {ratio('fn', 'fn + tp')} AS fnr,
  {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {ratio('tp + fp', 'tn + fp + fn + tp')} AS positive_rate"""


def confusion(pred: str, label: str = "label") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = {y} AND {pred} = {p}) AS {name}"
        for y, p, name in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    )


def cascade(tau: str, score: str = "router_score", judge: str = "llm_prediction") -> str:
    return f"(CASE WHEN {score} <= {tau} THEN 0 ELSE {judge} END)"


def wilson(k: str, n: str) -> tuple[str, str]:
    z = f"CAST({lx.NORMAL_95} AS DOUBLE)"
    p = f"(CAST({k} AS DOUBLE) / nullif({n}, 0))"
    centre = f"({p} + {z} * {z} / (2.0 * {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})))"
    scale = f"(1 + {z} * {z} / {n})"
    return (
        f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(0, ({centre} - {half}) / {scale}) END",
        f"CASE WHEN {n} = 0 THEN 0 ELSE least(1, ({centre} + {half}) / {scale}) END",
    )


def binomial_cdf(k: str, n: str, p: str) -> str:
    """P(X <= k), summed term by term."""
    return (
        f"list_sum(list_transform(range(0, CAST({k} + 1 AS BIGINT)), lambda j: exp(lgamma(CAST({n} + 1 AS DOUBLE)) "
        f"- lgamma(CAST(j + 1 AS DOUBLE)) - lgamma(CAST({n} - j + 1 AS DOUBLE)) + j * ln({p}) + ({n} - j) * ln(1 - {p}))))"
    )


def cp_upper(source: str, key: str, k: str = "false_bypass_count", n: str = "positives", alpha: float = 0.05) -> str:
    """CTEs that bisect the upper bound of every row of ``source``; result table cp(key, cp_upper)."""
    cdf = binomial_cdf("k", "n", "mid")
    return f"""cp_steps(id, k, n, lo, hi, step) AS (
  SELECT {key}, CAST({k} AS BIGINT), CAST({n} AS BIGINT), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), 0 FROM {source}
  UNION ALL
  SELECT id, k, n, CASE WHEN cdf > {alpha} THEN mid ELSE lo END, CASE WHEN cdf > {alpha} THEN hi ELSE mid END, step + 1
  FROM (SELECT *, CASE WHEN n <= 0 OR k >= n THEN 1 ELSE {cdf} END AS cdf
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM cp_steps WHERE step < 50))),
cp AS (SELECT id, CASE WHEN n <= 0 OR k >= n THEN 1 ELSE (lo + hi) / 2 END AS cp_upper FROM cp_steps WHERE step = 50)"""


def psi(source: str, value: str = "router_score") -> str:
    """CTE psi_result(stream, n, psi) over ``source``."""
    probs = ", ".join(repr(i * 0.1) for i in range(1, 10))
    return f"""psi_edges AS (
  SELECT DISTINCT unnest(quantile_cont({value}, [{probs}])) AS edge FROM {source} WHERE stream = 'reference'),
psi_rows AS (
  SELECT stream, (SELECT count(*) FROM psi_edges WHERE edge <= s.{value}) AS b FROM {source} s),
psi_n AS (SELECT stream, count(*) AS n FROM psi_rows GROUP BY stream),
psi_cells AS (
  SELECT t.stream, t.n, g.b, count(r.b) / CAST(t.n AS DOUBLE) AS share
  FROM psi_n t CROSS JOIN (SELECT unnest(range(10)) AS b) g LEFT JOIN psi_rows r ON r.stream = t.stream AND r.b = g.b
  GROUP BY t.stream, t.n, g.b),
psi_result AS (
  SELECT c.stream, c.n,
    sum((greatest(c.share, 1e-6) - greatest(f.share, 1e-6)) * ln(greatest(c.share, 1e-6) / greatest(f.share, 1e-6))) AS psi
  FROM psi_cells c JOIN psi_cells f ON f.stream = 'reference' AND f.b = c.b GROUP BY c.stream, c.n)"""


def ks_pvalue(stat: str, n1: str, n2: str) -> str:
    x = f"(sqrt(CAST({n1} AS DOUBLE) * {n2} / ({n1} + {n2})) * {stat})"
    safe = f"greatest({x}, 0.05)"
    small = f"1 - sqrt(2 * pi()) / {safe} * list_sum([exp(-(2 * j - 1) * (2 * j - 1) * pi() * pi() / (8 * {safe} * {safe})) FOR j IN range(1, 13)])"
    large = f"2 * list_sum([(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * {safe} * {safe}) FOR j IN range(1, 13)])"
    return f"least(1, greatest(0, CASE WHEN {x} < 0.05 THEN 1 WHEN {x} < 1.18 THEN {small} ELSE {large} END))"


def ks(source: str, value: str = "prompt_length") -> str:
    """CTE ks_result(stream, n, n_reference, ks_statistic, ks_pvalue) over ``source``."""
    return f"""ks_counts AS (SELECT stream, {value} AS v, count(*) AS c FROM {source} GROUP BY ALL),
ks_points AS (
  SELECT stream, v, sum(cur) AS cur, sum(ref) AS ref FROM (
    SELECT stream, v, c AS cur, 0 AS ref FROM ks_counts WHERE stream <> 'reference'
    UNION ALL
    SELECT s.stream, r.v, 0, r.c FROM ks_counts r
      CROSS JOIN (SELECT DISTINCT stream FROM ks_counts WHERE stream <> 'reference') s WHERE r.stream = 'reference')
  GROUP BY stream, v),
ks_sums AS (
  SELECT stream, sum(cur) OVER w AS cc, sum(ref) OVER w AS cr,
    sum(cur) OVER (PARTITION BY stream) AS n, sum(ref) OVER (PARTITION BY stream) AS n_reference
  FROM ks_points WINDOW w AS (PARTITION BY stream ORDER BY v)),
ks_stat AS (
  SELECT stream, max(n) AS n, max(n_reference) AS n_reference,
    max(abs(CAST(cc AS DOUBLE) / n - CAST(cr AS DOUBLE) / n_reference)) AS ks_statistic
  FROM ks_sums GROUP BY stream),
ks_result AS (SELECT *, {ks_pvalue('ks_statistic', 'n', 'n_reference')} AS ks_pvalue FROM ks_stat)"""


def keyword_drift(source: str) -> str:
    return f"""kw_rates AS (
  SELECT stream, count(*) AS n, avg(CASE WHEN keyword_hit THEN 1.0 ELSE 0.0 END) AS keyword_rate FROM {source} GROUP BY stream),
kw_result AS (
  SELECT k.*, r.keyword_rate AS reference_keyword_rate, k.keyword_rate - r.keyword_rate AS keyword_diff
  FROM kw_rates k, (SELECT keyword_rate FROM kw_rates WHERE stream = 'reference') r)"""


def decision(psi_limit: str = str(lx.PSI_LIMIT)) -> str:
    p, k, w = f"psi >= {psi_limit}", f"ks_pvalue < {lx.KS_P_LIMIT}", f"abs(keyword_diff) >= {lx.KEYWORD_DRIFT_LIMIT}"
    codes = f"concat_ws(',', CASE WHEN {p} THEN 'PSI' END, CASE WHEN {k} THEN 'KS' END, CASE WHEN {w} THEN 'KW' END)"
    return (
        f"{p} AS psi_trigger, {k} AS ks_trigger, {w} AS keyword_trigger, ({p} OR {k} OR {w}) AS shift_detected, "
        f"CASE WHEN {codes} = '' THEN '--' ELSE {codes} END AS triggers"
    )


def statistics(source: str, value: str = "router_score", length: str = "prompt_length") -> str:
    """CTE stats(stream, n, psi, ks_statistic, ks_pvalue, keyword_diff) for all but the reference."""
    return f"""{psi(source, value)},
{ks(source, length)},
{keyword_drift(source)},
stats AS (
  SELECT p.stream, p.n, p.psi, k.ks_statistic, k.ks_pvalue, w.keyword_diff
  FROM psi_result p JOIN ks_result k ON p.stream = k.stream JOIN kw_result w ON p.stream = w.stream)"""
