"""Queries: ranking quality, calibration error, threshold sweeps and their choice."""

from pyspark.sql import functions as F

from sluice.functions import lexicons as lx
from sluice.operators import quality as qu
from sluice.operators import thresholds as th
from sluice.plans import fixtures as fx
from sluice.plans import sql as q
from sluice.plans.registry import query

EDGE_CASE = " + ".join(f"CASE WHEN router_score >= {i} * CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END" for i in range(1, 10))


@query(
    "brier_ece",
    "stream:s n:i brier:f ece:f",
    f"""WITH {q.EVENTS}, b AS (SELECT *, {EDGE_CASE} AS bin FROM judged_events),
g AS (SELECT stream, bin, count(*) AS c, abs(avg(router_score) - avg(label)) AS gap FROM b GROUP BY stream, bin),
t AS (SELECT stream, count(*) AS n, avg((router_score - label) * (router_score - label)) AS brier FROM b GROUP BY stream)
SELECT t.*, (SELECT sum(c * gap) FROM g WHERE g.stream = t.stream) / n AS ece FROM t""",
)
def brier_ece(spark, d):
    return qu.calibration_error(fx.judged_events(spark, d), ["stream"])


@query(
    "roc_auc",
    "stream:s n:i positives:i roc_auc:f",
    f"""WITH {q.EVENTS}, r AS (
  SELECT stream, label, rank() OVER w + (count(*) OVER (PARTITION BY stream, router_score) - 1) / 2.0 AS mid
  FROM judged_events WINDOW w AS (PARTITION BY stream ORDER BY router_score)),
g AS (SELECT stream, count(*) AS n, sum(label) AS positives, sum(CASE WHEN label = 1 THEN mid ELSE 0 END) AS s FROM r GROUP BY stream)
SELECT *, (s - positives * (positives + 1) / 2.0) / (CAST(positives AS DOUBLE) * (n - positives)) AS roc_auc FROM g""",
)
def roc_auc(spark, d):
    return qu.ranking_quality(fx.judged_events(spark, d), ["stream"])


@query(
    "avg_precision",
    "stream:s n:i positives:i average_precision:f",
    f"""WITH {q.EVENTS}, s AS (SELECT stream, router_score AS t, count(*) AS n, sum(label) AS p FROM judged_events GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS flagged, sum(p) OVER w AS found, sum(n) OVER (PARTITION BY stream) AS total,
    sum(p) OVER (PARTITION BY stream) AS positives
  FROM s WINDOW w AS (PARTITION BY stream ORDER BY t DESC))
SELECT stream, max(total) AS n, max(positives) AS positives,
  sum(p * (CAST(found AS DOUBLE) / flagged)) / max(positives) AS average_precision FROM c GROUP BY stream""",
)
def avg_precision(spark, d):
    return qu.ranking_quality(fx.judged_events(spark, d), ["stream"])


def curve_ctes(group: str | None) -> str:
    """CTE curve(g, threshold, ...) by joining every candidate with every distinct score."""
    g = group or "'all'"
    return f"""{q.EVENTS},
src AS (SELECT {g} AS g, router_score AS s, count(*) AS c, sum(label) AS p FROM judged_events GROUP BY ALL),
tot AS (SELECT g, sum(c) AS n, sum(p) AS positives FROM src GROUP BY g),
cand AS (
  SELECT g, s AS threshold FROM src
  UNION SELECT g, CAST(i AS DOUBLE) * CAST(0.001 AS DOUBLE) FROM tot, range(1001) r(i)),
sums AS (
  SELECT k.g, k.threshold,
    sum(CASE WHEN s >= threshold THEN c ELSE 0 END) AS flagged, sum(CASE WHEN s >= threshold THEN p ELSE 0 END) AS tp,
    sum(CASE WHEN s <= threshold THEN c ELSE 0 END) AS bypass_count,
    sum(CASE WHEN s <= threshold THEN p ELSE 0 END) AS false_bypass_count
  FROM cand k JOIN src r ON k.g = r.g GROUP BY k.g, k.threshold),
cells AS (
  SELECT x.*, t.n, t.positives, flagged - tp AS fp, t.positives - tp AS fn, t.n - t.positives - (flagged - tp) AS tn
  FROM sums x JOIN tot t ON x.g = t.g),
curve AS (
  SELECT *, {q.RATES}, CAST(bypass_count AS DOUBLE) / n AS bypass_rate,
    {q.ratio('false_bypass_count', 'positives')} AS false_bypass_rate FROM cells)"""


POINT = (
    "threshold:f n:i positives:i tn:i fp:i fn:i tp:i bypass_count:i false_bypass_count:i accuracy:f "
    "precision:f recall:f specificity:f f1:f bypass_rate:f false_bypass_rate:f"
)


def curve(spark, d, groups=("stream",)):
    return th.metric_curve(fx.judged_events(spark, d), list(groups))


@query("metric_curve", POINT, f"WITH {curve_ctes(None)} SELECT * FROM curve")
def metric_curve(spark, d):
    return curve(spark, d, ())


def first_row(order: str, where: str = "TRUE") -> str:
    return (
        f"WITH {curve_ctes('stream')} SELECT *, g AS stream FROM curve WHERE {where} "
        f"QUALIFY row_number() OVER (PARTITION BY g ORDER BY {order}) = 1"
    )


@query("best_f1", f"stream:s {POINT}", first_row('f1 DESC, recall DESC, "precision" DESC, threshold'))
def best_f1(spark, d):
    return th.best_f1(curve(spark, d), ["stream"])


@query("recall_target", f"stream:s {POINT}", first_row("threshold DESC", "recall >= 0.99"))
def recall_target(spark, d):
    return th.recall_target(curve(spark, d), 0.99, ["stream"])


@query("half_threshold", f"stream:s {POINT}", first_row("threshold", "abs(threshold - 0.5) <= 5e-10"))
def half_threshold(spark, d):
    return th.fixed_threshold(curve(spark, d))


@query(
    "safe_bypass",
    f"stream:s {POINT}",
    first_row("bypass_count DESC, false_bypass_count, threshold", "false_bypass_rate <= 0.01"),
)
def safe_bypass(spark, d):
    return th.safe_bypass(curve(spark, d), 0.01, ["stream"])


def set_ctes() -> str:
    """CTE chosen(family, policy, tau): the seven operating points of the reference stream."""
    ref = curve_ctes("stream")
    pick = "(SELECT threshold FROM curve WHERE g = 'reference' AND {where} ORDER BY {order} LIMIT 1)"

    def row(family, policy, order, where="TRUE"):
        return f"SELECT '{family}' AS family, '{policy}' AS policy, {pick.format(where=where, order=order)} AS tau"

    rows = [
        row("classification", "threshold_0_5", "threshold", "abs(threshold - 0.5) <= 5e-10"),
        row("classification", "best_f1", 'f1 DESC, recall DESC, "precision" DESC, threshold'),
    ]
    for t in lx.RECALL_TARGETS:
        name = f"recall_ge_{t:g}".replace(".", "_")
        rows.append(row("classification", name, "threshold DESC", f"recall >= {t}"))
    for t in lx.FALSE_BYPASS_LIMITS:
        name = f"max_fb_rate_{t:g}".replace(".", "_")
        order = "bypass_count DESC, false_bypass_count, threshold"
        fits = f"EXISTS (SELECT 1 FROM curve WHERE g = 'reference' AND false_bypass_rate <= {t})"
        best = pick.format(where=f"false_bypass_rate <= {t}", order=order)
        least = pick.format(where="TRUE", order="false_bypass_rate, threshold")
        rows.append(f"SELECT 'triage', '{name}', CASE WHEN {fits} THEN {best} ELSE {least} END")
    return f"{ref},\nchosen AS ({' UNION ALL '.join(rows)})"


def chosen(spark, d):
    ref = fx.judged_events(spark, d).filter(F.col("stream") == "reference")
    return th.threshold_set(th.metric_curve(ref))


@query("threshold_set", "family:s policy:s tau:f", f"WITH {set_ctes()} SELECT * FROM chosen")
def threshold_set(spark, d):
    return chosen(spark, d)


APPLIED = (
    "stream:s family:s policy:s tau:f n:i positives:i bypass_count:i false_bypass_count:i tn:i fp:i fn:i tp:i "
    "accuracy:f precision:f recall:f specificity:f f1:f call_rate:f cost_reduction:f false_bypass_rate:f"
)


def applied_sql(prediction: str, policies: str, ctes: str) -> str:
    return f"""WITH {ctes}, a AS (
  SELECT e.stream, c.family, c.policy, c.tau, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,
    count(*) FILTER (WHERE router_score <= tau) AS bypass_count,
    count(*) FILTER (WHERE router_score <= tau AND label = 1) AS false_bypass_count, {q.confusion(prediction)}
  FROM judged_events e CROSS JOIN {policies} c GROUP BY ALL)
SELECT *, {q.RATES}, 1 - bypass_count / CAST(n AS DOUBLE) AS call_rate, bypass_count / CAST(n AS DOUBLE) AS cost_reduction,
  false_bypass_count / CAST(nullif(positives, 0) AS DOUBLE) AS false_bypass_rate FROM a"""


@query(
    "apply_thresholds",
    APPLIED,
    applied_sql("(CASE WHEN router_score >= tau THEN 1 ELSE 0 END)", "chosen", set_ctes()),
)
def apply_thresholds(spark, d):
    return th.apply_threshold_set(fx.judged_events(spark, d), chosen(spark, d), ["stream"])


SWEEP_ROWS = " UNION ALL ".join(f"SELECT 'triage', 'fixed_tau_{t:g}', CAST({t} AS DOUBLE)" for t in lx.SWEEP_TAUS)
SWEEP_CTES = set_ctes() + f""",
sweep AS (SELECT * FROM chosen WHERE family = 'triage' UNION ALL {SWEEP_ROWS})"""
SWEEP_SPEC = APPLIED.replace(" family:s", "")


def sweep(spark, d):
    triage = chosen(spark, d).filter(F.col("family") == "triage")
    return th.cascade_sweep(fx.judged_events(spark, d), triage, ["stream"])


@query("cascade_sweep", SWEEP_SPEC, applied_sql(q.cascade("tau"), "sweep", SWEEP_CTES))
def cascade_sweep(spark, d):
    return sweep(spark, d)


@query(
    "frontier",
    "stream:s policy:s tau:f cost_reduction:f false_bypass_rate:f on_frontier:b",
    f"""WITH pts AS ({applied_sql(q.cascade("tau"), "sweep", SWEEP_CTES)})
SELECT *, cost_reduction > coalesce(max(cost_reduction) OVER (PARTITION BY stream
  ORDER BY false_bypass_rate NULLS FIRST, cost_reduction DESC, tau, policy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS on_frontier FROM pts""",
)
def frontier(spark, d):
    return th.frontier(sweep(spark, d), ["stream"])


@query(
    "policy_pick",
    SWEEP_SPEC,
    f"SELECT * FROM ({applied_sql(q.cascade('tau'), 'sweep', SWEEP_CTES)}) WHERE policy = 'max_fb_rate_0_005'",
)
def policy_pick(spark, d):
    return th.pick_policy(sweep(spark, d), "max_fb_rate_0_005")


CI = "stream:s metric:s mean:f ci95_low:f ci95_high:f"
CELLS = ["tn", "fp", "fn", "tp"]


def uniform(cell: str, seed: int) -> str:
    return q.bucket(f"stream || '|boot:{seed}|' || b || '|{cell}'")


def drawn(source: str, name: str, cell: str, seed: int, mean: str, variance: str, most: str, log_weight: str, keep: str) -> str:
    """CTEs that draw one count per row of ``source`` by inversion; table ``name`` has d_<cell> next to the columns kept."""
    return f"""{name}_w AS (
  SELECT stream, b, {uniform(cell, seed)} AS u, {mean} AS mean, {variance} AS variance, {most} AS most, {keep} FROM {source}),
{name}_k AS (
  SELECT *, unnest(range(CAST(greatest(0, floor(mean - 12 * sqrt(variance) - 30)) AS BIGINT),
    CAST(least(most, ceil(mean + 12 * sqrt(variance) + 30)) AS BIGINT) + 1)) AS k FROM {name}_w),
{name}_s AS (SELECT stream, b, u, k, sum(exp({log_weight})) OVER w AS s, sum(exp({log_weight})) OVER (PARTITION BY stream, b) AS t
  FROM {name}_k WINDOW w AS (PARTITION BY stream, b ORDER BY k)),
{name}_d AS (SELECT stream, b, min(k) FILTER (WHERE s >= u * t) AS d FROM {name}_s GROUP BY stream, b),
{name} AS (SELECT w.*, coalesce(d, 0) AS d_{cell} FROM {name}_w w LEFT JOIN {name}_d USING (stream, b))"""


BOOT_COUNTS = f"""WITH {q.EVENTS}, counted AS (
  SELECT stream, {q.confusion("(CASE WHEN router_score >= 0.5 THEN 1 ELSE 0 END)")} FROM judged_events GROUP BY stream),
base AS (SELECT *, 0 AS none, tn + fp + fn + tp AS n FROM counted CROSS JOIN range(500) r(b))"""
BOOT_METRICS = f"""m AS (SELECT stream, {q.RATES} FROM c),
l AS (UNPIVOT m ON accuracy, "precision", recall, f1, fpr INTO NAME metric VALUE v)
SELECT stream, metric, avg(v) AS mean, quantile_cont(v, 0.025) AS ci95_low, quantile_cont(v, 0.975) AS ci95_high
FROM l GROUP BY stream, metric"""


def multinomial_sql(seed: int, counts: str = BOOT_COUNTS) -> str:
    steps, source, kept = [counts], "base", "tn, fp, fn, tp, n"
    rows, left = "n", "n"
    for i, cell in enumerate(CELLS[:-1]):
        p = f"(CAST({cell} AS DOUBLE) / ({rows}))"
        weight = "CASE WHEN p <= 0 THEN (CASE WHEN k = 0 THEN 0 ELSE -1e9 END) WHEN p >= 1 THEN (CASE WHEN k = most THEN 0 ELSE -1e9 END) " \
            "ELSE lgamma(most + 1.0) - lgamma(k + 1.0) - lgamma(most - k + 1.0) + k * ln(p) + (most - k) * ln(1 - p) END"
        steps.append(drawn(source, f"draw{i}", cell, seed, f"({left}) * {p}", f"greatest(0, ({left}) * {p} * (1 - {p}))", f"({left})", weight, f"{p} AS p, {kept}"))
        source, kept = f"draw{i}", f"{kept}, d_{cell}"
        rows, left = f"{rows} - {cell}", f"{left} - d_{cell}"
    done = f"c AS (SELECT stream, d_tn AS tn, d_fp AS fp, d_fn AS fn, {left} AS tp FROM {source})"
    return ",\n".join([*steps, done, BOOT_METRICS])


def poisson_sql(seed: int) -> str:
    steps, source, kept = [BOOT_COUNTS], "base", "tn, fp, fn, tp, n"
    for i, cell in enumerate(CELLS):
        weight = "CASE WHEN mean <= 0 THEN (CASE WHEN k = 0 THEN 0 ELSE -1e9 END) ELSE k * ln(mean) - mean - lgamma(k + 1.0) END"
        steps.append(drawn(source, f"draw{i}", cell, seed, cell, cell, "CAST(9000000000000000 AS BIGINT)", weight, kept))
        source, kept = f"draw{i}", f"{kept}, d_{cell}"
    done = f"c AS (SELECT stream, d_tn AS tn, d_fp AS fp, d_fn AS fn, d_tp AS tp FROM {source})"
    return ",\n".join([*steps, done, BOOT_METRICS])


def flagged():
    return (F.col("router_score") >= 0.5).cast("int")


@query("bootstrap_ci_hashed", CI, poisson_sql(11))
def bootstrap_ci_hashed(spark, d):
    return qu.bootstrap_ci_poisson(fx.judged_events(spark, d), flagged(), ["stream"], seed=11)


@query("bootstrap_ci", CI, multinomial_sql(20260604))
def bootstrap_ci(spark, d):
    return qu.bootstrap_ci(fx.judged_events(spark, d), flagged(), ["stream"], seed=20260604)
