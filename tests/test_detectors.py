"""Trained detectors: vectors, scores, persistence."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sluice.operators import features as fe
from sluice.operators import models as md
from sluice.operators import thresholds as th
from sluice.operators.linear import fit_grid, losses_and_gradients, stored_blocks
from sluice.plans import fixtures as fx
from sluice.session import scratch_path
from sluice.sources.vectors import as_vector, with_embeddings


@pytest.fixture(scope="module")
def text_model(spark):
    words = {1: ["override", "reveal", "leak"], 0: ["garden", "recipe", "travel"]}
    rows = []
    for i in range(120):
        label = i % 2
        noise = words[1 - label][i % 3] if i % 7 == 0 else ""
        rows.append((f"d{i}", f"{words[label][i % 3]} {words[label][(i // 3) % 3]} common {noise}", label))
    df = spark.createDataFrame(rows, "sample_id string, prompt string, label int")
    train, validation = df.filter("sample_id < 'd5'"), df.filter("sample_id >= 'd5'")
    fitted = md.fit_text_detector(train, validation, c_values=[0.5, 2.0], max_iter=50)
    return fitted, fitted.vectors(df), df


def test_model_separates_and_keeps_the_best_candidate(text_model):
    detector = text_model[0].detector
    assert len(detector.candidates) == 2 and detector.selected_c in (0.5, 2.0)
    assert detector.thresholds.count() == 7
    best = detector.thresholds.filter("policy = 'best_f1'").first()
    assert best["f1"] == max(c["best_f1"] for c in detector.candidates) > 0.9


def test_linear_score_equals_the_model(text_model):
    fitted, vectors, df = text_model
    table, intercept = md.coefficient_table(fitted.detector, fitted.vectoriser.terms)
    weights = fitted.vectoriser.transform(df)
    margin = weights.join(table, ["space", "term"]).groupBy("sample_id").agg(F.sum(F.col("weight") * F.col("coefficient")).alias("m"))
    plain = margin.select("sample_id", (1 / (1 + F.exp(-(F.col("m") + intercept)))).alias("p"))
    model = md.positive_score(fitted.detector.model, vectors).select("sample_id", "router_score")
    gap = model.join(plain, "sample_id").agg(F.max(F.abs(F.col("router_score") - F.col("p"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == vectors.count()


def test_grid_fit_is_that_of_the_library(spark):
    """Every C of the shared pass against Spark's own fit of the same objective."""
    rng = np.random.default_rng(8)
    dense = rng.normal(size=(400, 6)) * [1, 2, 0.5, 1, 3, 0]
    label = (rng.random(400) < 1 / (1 + np.exp(-dense @ [1, -0.5, 2, 0, 0.2, 0] - 0.3))).astype(int)
    rows = [([j for j in range(6) if v[j]], [float(x) for x in v if x], int(y), float(1 + y)) for v, y in zip(dense, label, strict=True)]
    df = spark.createDataFrame(rows + [([], [], 1, 0.5)], "idx array<int>, weight array<double>, label int, row_weight double").repartition(3)
    total = float(df.agg(F.sum("row_weight")).first()[0])
    vectors = spark.createDataFrame([(Vectors.sparse(6, i, w), float(y), x) for i, w, y, x in df.collect()], ["features", "label", "weight"])
    fitted = fit_grid(df, 6, [0.01, 0.5, 4.0], tolerance=1e-9)
    for c, model in fitted.items():
        own = LogisticRegression(weightCol="weight", regParam=1 / (c * total), standardization=False, maxIter=300, tol=1e-12).fit(vectors)
        assert np.allclose(model.coefficients, own.coefficients.toArray(), atol=1e-4) and model.intercept == pytest.approx(own.intercept, abs=1e-4)


def test_grid_reads_blocks_with_as_many_tasks_as_cores(spark):
    """Rows are packed once; blocks give the same loss and gradient, and no more tasks hand on a gradient than there are cores."""
    rng = np.random.default_rng(9)
    rows = [(sorted(rng.choice(50, n, False).tolist()), rng.random(n).tolist(), int(rng.integers(2)), float(rng.random())) for n in rng.integers(0, 9, 200)]
    df = spark.createDataFrame(rows, "idx array<int>, weight array<double>, label int, row_weight double").repartition(40)
    points = rng.normal(size=(51, 3))
    packed = stored_blocks(fe.blocks(df))
    started = []
    frame, taken = type(packed), type(packed).mapInArrow

    def seen(self, *a, **b):
        started.append(self.rdd.getNumPartitions())
        return taken(self, *a, **b)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(frame, "mapInArrow", seen)
        losses, gradients = losses_and_gradients(packed, points)
    assert packed.rdd.getNumPartitions() >= started[0] and max(started) <= spark.sparkContext.defaultParallelism
    dense = np.zeros((200, 50))
    for i, (idx, weight, _, _) in enumerate(rows):
        dense[i, idx] = weight
    y, w = (np.array([r[c] for r in rows]) for c in (2, 3))
    m = dense @ points[:-1] + points[-1]
    off = w[:, None] * (1 / (1 + np.exp(-m)) - y[:, None])
    assert np.allclose(losses, (w[:, None] * (np.logaddexp(0, m) - y[:, None] * m)).sum(axis=0))
    assert np.allclose(gradients, np.vstack([dense.T @ off, off.sum(axis=0)]))


def test_blocks_of_texts_are_their_weights(spark, text_model):
    """Counts, idf and lengths in blocks give the losses and gradients of the weights, with empty and null texts."""
    fitted, _, df = text_model
    more = spark.createDataFrame([("e", None, 1), ("f", "", 0), ("g", "unknownword", 1), ("h", "leak leak leak", 1)], df.schema)
    rows = df.unionByName(more).select("prompt", "label", (F.length("sample_id") / 2).alias("row_weight"))
    points = np.random.default_rng(3).normal(size=(fitted.vectoriser.size + 1, 2))
    packed = fitted.vectoriser.blocks(rows)
    assert {len(r._value) * 4 for r in packed.collect()} == {len(r._place) for r in packed.collect()}
    got, want = losses_and_gradients(packed, points), losses_and_gradients(fe.blocks(fitted.vectoriser.arrays(rows)), points)
    assert all(np.allclose(a, b, rtol=1e-12, atol=1e-12) for a, b in zip(got, want, strict=True))


def test_saved_detector_scores_the_same(spark, text_model):
    fitted, vectors, df = text_model
    path = scratch_path(spark, "detector")
    fitted.save(path)
    again = md.TextDetector.load(spark, path, "text_logreg")
    a = fitted.score(df).orderBy("sample_id").select("router_score").collect()
    b = again.score(df).orderBy("sample_id").select("router_score").collect()
    assert a == b
    suite = md.evaluate_suite(again.detector, vectors.withColumn("dataset", F.lit("all")), replicates=50)
    assert suite["figures"].count() == 7 and suite["intervals"].count() == 10
    assert th.pick_policy(suite["figures"], "best_f1").first()["n"] == 120


def test_unseen_terms_have_no_weight(spark):
    texts = [("a", "garden recipe"), ("b", "garden recipe"), ("c", "garden novel novel"), ("d", None), ("e", "novel")]
    df = spark.createDataFrame(texts, "sample_id string, prompt string")
    fitted = fe.fit_vectoriser(df.filter("sample_id < 'c'"), ["word"])
    rows = fitted.transform(df.filter("sample_id >= 'c'")).collect()
    assert [(r["sample_id"], r["term"], r["weight"]) for r in rows] == [("c", "garden", 1.0)]
    vectors = fitted.arrays(df.filter("sample_id >= 'c'"))
    assert {r["sample_id"]: len(r["idx"]) for r in vectors.collect()} == {"c": 1, "d": 0, "e": 0}


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(0,)] * 30, "label int")
    sums = {r[0]: r[1] for r in md.with_class_weights(df).groupBy("label").agg(F.sum("weight")).collect()}
    assert sums[0] == pytest.approx(20.0) and sums[1] == pytest.approx(20.0)


def test_forest_on_vectors(spark, sf_dir):
    rows = as_vector(fx.vectors(spark, sf_dir)).drop("embedding")
    detector = md.fit_forest(rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0"), trees=5, max_depth=4)
    scored = md.positive_score(detector.model, rows)
    assert scored.filter("router_score < 0 OR router_score > 1 OR router_score IS NULL").count() == 0


def observed(spark):
    """A session that has observed a table."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    return seen.get["n"]


def drawn_vectors(spark, n, at=0):
    rng = np.random.default_rng(n + at)
    points = rng.normal(size=(n, 4))
    return spark.createDataFrame(
        [(f"v{at + i}", Vectors.dense(p), int(p[0] + p[1] > 0)) for i, p in enumerate(points)], ["sample_id", "features", "label"]
    )


def test_trained_models_travel_after_an_observation(spark):
    assert observed(spark) == 3
    train, validation = drawn_vectors(spark, 80), drawn_vectors(spark, 40, 80)
    forest = md.fit_forest(train, validation, trees=3, max_depth=3)
    linear = md.fit_logreg_grid(train, validation, c_values=[1.0], max_iter=5, scale=True)
    for detector in (forest, linear):
        assert md.positive_score(detector.model, validation).filter("router_score between 0 and 1").count() == 40


def test_suites_of_trained_models_after_an_observation(spark, tmp_path):
    """What forest, zero_shot and detector_suite do: fitted, saved, loaded and evaluated in a session that has observed a table."""
    assert observed(spark) == 3
    rows = as_vector(drawn_vectors(spark, 120).select("sample_id", vector_to_array("features").alias("embedding"), "label"))
    train, validation = rows.filter("sample_id < 'v5'"), rows.filter("sample_id >= 'v5'")
    forest = md.fit_forest(train, validation, trees=3, max_depth=3)
    linear = md.fit_logreg_grid(train, validation, c_values=[1.0], max_iter=5, scale=True)
    forest.save(str(tmp_path / "forest"))
    again = md.Detector.load(spark, str(tmp_path / "forest"), "vector_forest", forest=True)
    parts = validation.withColumn("dataset", F.lit("external"))
    for detector in (again, linear):
        suite = md.evaluate_suite(detector, parts, replicates=20)
        assert {r.n for r in suite["figures"].collect()} == {validation.count()}
        assert suite["intervals"].filter("policy = 'best_f1'").join(suite["summary"], "dataset").count() == 5


def test_forest_in_parts(spark):
    """Trees beyond the bound are fitted and written in parts; all of them vote, saved and loaded too."""
    train, validation = drawn_vectors(spark, 80), drawn_vectors(spark, 40, 80)
    fitted = md.fit_forest(train, validation, trees=7, max_depth=4, tree_rows=240)
    assert [n for _, n in fitted.model.parts] == [3, 3, 1]
    path = scratch_path(spark, "forest")
    fitted.save(path)
    again = md.Detector.load(spark, path, "vector_forest", forest=True)
    alone = [md.positive_score(md.ForestModel([part]), validation, f"p{i}").select("sample_id", f"p{i}") for i, part in enumerate(fitted.model.parts)]
    together = md.positive_score(again.model, validation).join(alone[0], "sample_id").join(alone[1], "sample_id").join(alone[2], "sample_id")
    gap = together.select(F.abs(F.col("router_score") - (3 * F.col("p0") + 3 * F.col("p1") + F.col("p2")) / 7).alias("g")).agg(F.max("g"), F.count("*")).first()
    assert gap[0] < 1e-12 and gap[1] == 40


def test_forest_keeps_the_node_of_every_row(spark):
    """Levels of a forest don't walk its trees from the root again; the trees are the same."""
    train, validation = drawn_vectors(spark, 80), drawn_vectors(spark, 40, 80)
    fitted = md.fit_forest(train, validation, trees=3, max_depth=4)
    model = RandomForestClassificationModel.load(fitted.model.parts[0][0])
    assert model.getOrDefault("cacheNodeIds")
    plain = RandomForestClassifier(numTrees=3, maxDepth=4, featureSubsetStrategy="sqrt", weightCol="weight", seed=42).fit(md.with_class_weights(train))
    assert [t.toDebugString.split("\n")[1:] for t in model.trees] == [t.toDebugString.split("\n")[1:] for t in plain.trees]


def test_missing_embedding_fails(spark):
    table = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    vectors = spark.createDataFrame([("a", [1.0])], "sample_id string, embedding array<float>")
    with pytest.raises(Exception, match="no embedding for b"):
        with_embeddings(table, vectors).collect()
