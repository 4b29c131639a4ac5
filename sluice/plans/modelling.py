"""Queries: text features, linear scores, trained detectors."""

import numpy as np
from pyspark.sql import functions as F

from sluice.functions import lexicons as lx
from sluice.functions.hashing import unit_bucket
from sluice.operators import features as fe
from sluice.operators import models as md
from sluice.operators import thresholds as th
from sluice.operators.linear import LinearModel
from sluice.plans import curves as cu
from sluice.plans import fixtures as fx
from sluice.plans import sql as q
from sluice.plans.registry import query
from sluice.session import scratch_path, stored
from sluice.sources import vectors as ve

WORDS_SQL = f"""words AS (SELECT sample_id, regexp_extract_all(lower(prompt), '{fe.WORD}') AS w FROM judged_docs),
word_terms AS (
  SELECT sample_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT sample_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words)"""
SPACE_SQL = fe.SPACE.replace("\\x85", "\\x{85}")
CHARS_SQL = f"""pieces AS (SELECT sample_id, ' ' || w || ' ' AS w FROM (
  SELECT sample_id, unnest(regexp_split_to_array(lower(prompt), '{SPACE_SQL}')) AS w FROM judged_docs) WHERE w <> ''),
char_terms AS (
  SELECT sample_id, substr(w, s.i, s.n) AS term
  FROM (SELECT sample_id, w, n.n, unnest(range(1, length(w) - n.n + 2)) AS i FROM pieces, range(3, 6) n(n) WHERE n.n <= length(w)) s)"""


def tfidf_sql(terms: str, name: str, max_features: int = 300_000) -> str:
    return f"""{name}_post AS (SELECT sample_id, term, count(*) AS tf FROM {terms} GROUP BY ALL),
{name}_vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM {name}_post GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {max_features}),
{name}_raw AS (
  SELECT p.sample_id, p.term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + v.df)) + 1) AS w
  FROM {name}_post p JOIN {name}_vocab v ON p.term = v.term),
{name} AS (SELECT sample_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS weight FROM {name}_raw)"""


WEIGHT = "sample_id:s term:s weight:f"
WORD_TFIDF = f"{q.DOCS}, {WORDS_SQL}, {tfidf_sql('word_terms', 'wt')}"
CHAR_TFIDF = f"{q.DOCS}, {CHARS_SQL}, {tfidf_sql('char_terms', 'ct')}"


@query("tfidf_word", WEIGHT, f"WITH {WORD_TFIDF} SELECT * FROM wt")
def tfidf_word(spark, d):
    return fe.fit_tfidf(fx.judged_docs(spark, d))


@query("tfidf_charwb", WEIGHT, f"WITH {CHAR_TFIDF} SELECT * FROM ct")
def tfidf_charwb(spark, d):
    return fe.fit_tfidf(fx.judged_docs(spark, d), "char")


@query(
    "feature_concat",
    "sample_id:s space:s terms:i norm:f",
    f"""WITH {WORD_TFIDF}, {CHARS_SQL}, {tfidf_sql('char_terms', 'ct')},
b AS (SELECT 'word' AS space, * FROM wt UNION ALL SELECT 'char', * FROM ct)
SELECT sample_id, space, count(*) AS terms, sqrt(sum(weight * weight)) AS norm FROM b GROUP BY ALL""",
)
def feature_concat(spark, d):
    docs = fx.judged_docs(spark, d)
    both = fe.fit_vectoriser(docs).transform(docs, columns=["space", "weight"])
    return both.groupBy("sample_id", "space").agg(
        F.count(F.lit(1)).alias("terms"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )


# A coefficient table without a training run: a hash-drawn weight per vocabulary term.
COEFFICIENTS = f"""coef AS (SELECT term, ({q.bucket("term || ':coef'")} - 0.5) * 4 AS coefficient FROM wt_vocab)"""


def coefficients(terms):
    weight = (unit_bucket(F.concat(F.col("term"), F.lit(":coef"))) - 0.5) * 4.0
    return terms.withColumn("coefficient", weight)


@query(
    "linear_score",
    "sample_id:s router_score:f",
    f"""WITH {WORD_TFIDF}, {COEFFICIENTS}
SELECT d.sample_id, 1 / (1 + exp(-(coalesce(sum(weight * coefficient), 0) - 0.25))) AS router_score
FROM judged_docs d LEFT JOIN wt ON wt.sample_id = d.sample_id LEFT JOIN coef ON coef.term = wt.term GROUP BY d.sample_id""",
)
def linear_score(spark, d):
    docs = fe.coded_texts(fx.judged_docs(spark, d).select("sample_id", "prompt"))
    vectoriser = fe.fit_vectoriser(docs, ["word"])
    by_idx = coefficients(vectoriser.terms).orderBy("idx").select("coefficient").toPandas()
    return fe.linear_score(vectoriser.arrays(docs), by_idx["coefficient"].to_numpy(), -0.25)


BLOCKED = " AND ".join(f"NOT contains(term, '{b}')" for b in lx.BLOCKED_TERMS)


@query(
    "lexicon_top",
    "term:s coefficient:f",
    f"""WITH {WORD_TFIDF}, {COEFFICIENTS} SELECT term, coefficient FROM coef
WHERE length(term) >= 3 AND NOT regexp_matches(term, '[^\\p{{L}}\\p{{N}}\\s]') AND {BLOCKED} ORDER BY coefficient, term LIMIT 120""",
)
def lexicon_top(spark, d):
    terms = fe.fit_vectoriser(fx.judged_docs(spark, d), ["word"]).terms
    return fe.benign_lexicon(coefficients(terms.select("term")))


FIT = "detector:s selected_c:f family:s policy:s tau:f n:i positives:i f1:f recall:f bypass_count:i false_bypass_count:i"


def three_ways(df, key):
    """Train, validation and test parts by key."""
    tenth = F.pmod(F.xxhash64(key), F.lit(10))
    return df.filter(tenth < 6), df.filter((tenth >= 6) & (tenth < 8)), df.filter(tenth >= 8)


def described(detector):
    c = F.lit(detector.selected_c).cast("double")
    return detector.thresholds.withColumns({"detector": F.lit(detector.name), "selected_c": c})


def labelled_texts(spark, d):
    """Training, validation and test texts."""
    docs = fx.judged_docs(spark, d).filter("label IS NOT NULL").select("sample_id", "position", "prompt", "label", "lang")
    return three_ways(docs, "sample_id")


@query("logreg_grid", FIT)
def logreg_grid(spark, d):
    train, validation, _ = labelled_texts(spark, d)
    return described(md.fit_text_detector(train, validation).detector)


@query("text_zero_shot", "sample_id:s label:i router_score:f")
def text_zero_shot(spark, d):
    """A saved text detector, loaded and applied to texts that neither its vocabulary nor its idf has seen."""
    train, validation, test = labelled_texts(spark, d)
    path = scratch_path(spark, "text-detector")
    md.fit_text_detector(train, validation).save(path)
    return md.TextDetector.load(spark, path, "text_logreg").score(test)


SEEN = f"""seen AS (SELECT sample_id, {q.bucket("sample_id")} < 0.6 AS train FROM judged_docs),
post AS (SELECT sample_id, term, train, count(*) AS tf FROM word_terms JOIN seen USING (sample_id) GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df FROM post WHERE train GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 300000),
raw AS (
  SELECT sample_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM seen WHERE train)) / (1.0 + df)) + 1) AS w
  FROM post JOIN vocab USING (term) WHERE NOT train)"""


@query(
    "tfidf_transform",
    "sample_id:s term:s weight:f",
    f"WITH {q.DOCS}, {WORDS_SQL}, {SEEN} SELECT sample_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS weight FROM raw",
)
def tfidf_transform(spark, d):
    """Weights of unseen texts under the vocabulary and idf of the training texts."""
    docs = fx.judged_docs(spark, d)
    seen = unit_bucket(F.col("sample_id")) < 0.6
    return fe.fit_vectoriser(docs.filter(seen), ["word"]).transform(docs.filter(~seen)).select("sample_id", "term", "weight")


@query("trained_lexicon", "term:s coefficient:f")
def trained_lexicon(spark, d):
    """Most negative word weights of a trained model: input of the density gate."""
    train, validation, _ = labelled_texts(spark, d)
    fitted = md.fit_text_detector(train, validation)
    table, _ = md.coefficient_table(fitted.detector, fitted.vectoriser.terms)
    return fe.benign_lexicon(table.filter("space = 'word'").select("term", "coefficient"))


def vector_rows(spark, d):
    return ve.as_vector(fx.vectors(spark, d)).drop("embedding")


@query("embedding_logreg", FIT)
def embedding_logreg(spark, d):
    train, validation, _ = three_ways(vector_rows(spark, d), "sample_id")
    return described(md.fit_logreg_grid(train, validation, "embedding_logreg", md.VECTOR_C, 100, scale=True))


def forest_on(spark, d):
    train, validation, test = three_ways(vector_rows(spark, d), "sample_id")
    return md.fit_forest(train, validation), test


@query("forest", FIT)
def forest(spark, d):
    return described(forest_on(spark, d)[0])


EVALUATED = "dataset:s family:s policy:s tau:f n:i tn:i fp:i fn:i tp:i f1:f recall:f bypass_count:i false_bypass_count:i"


@query("zero_shot", EVALUATED)
def zero_shot(spark, d):
    """A saved detector, loaded and applied to other rows without refitting."""
    detector, test = forest_on(spark, d)
    path = scratch_path(spark, "detector")
    detector.save(path)
    again = md.Detector.load(spark, path, detector.name, forest=True)
    parts = test.withColumn("dataset", F.concat(F.lit("part_"), (F.col("vec_id") % 2).cast("string")))
    return md.evaluate_suite(again, parts)["figures"]


@query("detector_suite", "dataset:s metric:s mean:f ci95_low:f ci95_high:f p05:f p50:f p95:f")
def detector_suite(spark, d):
    """Intervals and score spread per dataset at the validation best-F1 threshold."""
    train, validation, test = three_ways(vector_rows(spark, d), "sample_id")
    detector = md.fit_logreg_grid(train, validation, "embedding_logreg", md.VECTOR_C, 100, scale=True)
    half = F.concat(F.lit("external_"), (F.col("vec_id") % 2).cast("string"))
    parts = validation.withColumn("dataset", F.lit("validation")).unionByName(test.withColumn("dataset", half))
    suite = md.evaluate_suite(detector, parts)
    return suite["intervals"].filter("policy = 'best_f1'").join(suite["summary"], "dataset")


@query("positive_score", "sample_id:s router_score:f")
def positive_score(spark, d):
    detector, test = forest_on(spark, d)
    return md.positive_score(detector.model, test).select("sample_id", "router_score")


# A linear detector that isn't trained: hash-drawn coefficients, so that SQL can score the same rows.
DIMENSIONS, GIVEN_INTERCEPT = 64, -0.1


def given_coefficients(spark):
    drawn = (unit_bucket(F.concat(F.lit("dim"), F.col("id").cast("string"), F.lit(":coef"))) - 0.5) * 4.0
    rows = spark.range(DIMENSIONS).select("id", drawn.alias("c")).orderBy("id").collect()
    return np.array([r.c for r in rows])


def given_rows(spark, d):
    """Vectors by part: the validation rows choose the thresholds, the others are seen for the first time."""
    v = fx.vectors(spark, d)
    part = F.element_at(F.array(*(F.lit(p) for p in ("reference", "test", "external_a", "external_b"))), (F.col("vec_id") % 4 + 1).cast("int"))
    entries = F.transform("embedding", lambda c: c.cast("double"))
    return v.select("sample_id", "label", part.alias("stream"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("idx"), entries.alias("weight"))


def given_detector(spark, rows):
    """The detector with thresholds from the validation rows, saved and loaded again."""
    model = LinearModel(given_coefficients(spark), GIVEN_INTERCEPT)
    scored = model.score(rows.filter("stream = 'reference'")).select("label", "router_score")
    path = scratch_path(spark, "given")
    md.Detector("given", model, th.threshold_set(th.metric_curve(stored(scored, "scored")))).save(path)
    return md.Detector.load(spark, path, "given", linear=True)


GIVEN = f"""{q.VECTORS},
dims AS (SELECT list(({q.bucket("'dim' || i || ':coef'")} - 0.5) * 4.0 ORDER BY i) AS c FROM range({DIMENSIONS}) r(i)),
judged_events AS (
  SELECT sample_id, label, CASE vec_id % 4 WHEN 0 THEN 'reference' WHEN 1 THEN 'test' WHEN 2 THEN 'external_a' ELSE 'external_b' END AS stream,
    1 / (1 + exp(-(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * c[i])) + ({GIVEN_INTERCEPT})))) AS router_score
  FROM vectors, dims)"""


def on_given(ctes: str) -> str:
    return ctes.replace(q.EVENTS, GIVEN)


@query("given_scores", "sample_id:s label:i router_score:f", f"WITH {GIVEN} SELECT sample_id, label, router_score FROM judged_events WHERE stream <> 'reference'")
def given_scores(spark, d):
    """Class-1 scores of rows that a saved and loaded detector has not seen."""
    rows = given_rows(spark, d)
    return md.positive_score(given_detector(spark, rows).model, rows.filter("stream <> 'reference'"))


@query("suite_figures", cu.APPLIED, cu.applied_sql("(CASE WHEN router_score >= tau THEN 1 ELSE 0 END)", "chosen", on_given(cu.set_ctes())))
def suite_figures(spark, d):
    """Classification and triage rows of validation, test and external parts at the validation thresholds."""
    rows = given_rows(spark, d)
    return md.evaluate_suite(given_detector(spark, rows), rows, dataset="stream")["figures"]


SUITE_COUNTS = f"""WITH {on_given(cu.set_ctes())}, counted AS (
  SELECT e.stream || '|' || c.policy AS stream, {q.confusion("(CASE WHEN router_score >= tau THEN 1 ELSE 0 END)")}
  FROM judged_events e, chosen c WHERE c.policy IN ('threshold_0_5', 'best_f1') GROUP BY ALL),
base AS (SELECT *, 0 AS none, tn + fp + fn + tp AS n FROM counted CROSS JOIN range(500) r(b))"""


@query(
    "suite_intervals",
    "stream:s policy:s metric:s mean:f ci95_low:f ci95_high:f",
    f"""SELECT split_part(stream, '|', 1) AS stream, split_part(stream, '|', 2) AS policy, metric, mean, ci95_low, ci95_high
FROM ({cu.multinomial_sql(20260604, SUITE_COUNTS)})""",
)
def suite_intervals(spark, d):
    """Bootstrap intervals of every part at the 0.5 and the best-F1 threshold."""
    rows = given_rows(spark, d)
    return md.evaluate_suite(given_detector(spark, rows), rows, dataset="stream")["intervals"]


@query(
    "suite_labels",
    "stream:s label:i n:i",
    f"WITH {GIVEN} SELECT stream, label, count(*) AS n FROM judged_events GROUP BY ALL",
)
def suite_labels(spark, d):
    rows = given_rows(spark, d)
    return md.evaluate_suite(given_detector(spark, rows), rows, dataset="stream")["labels"]
