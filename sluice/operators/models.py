"""Trained detectors on distributed ML: linear models on text, linear and forest on vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import thresholds as th
from sluice.operators.features import Vectoriser, fit_vectoriser
from sluice.operators.linear import LinearModel, fit_grid, stored_blocks
from sluice.operators.quality import bootstrap_ci, label_counts, score_summary
from sluice.session import scratch_path, stored

TEXT_C = [0.5, 1.0, 2.0, 4.0]
VECTOR_C = [0.1, 0.5, 1.0, 2.0, 4.0]
TREE_ROWS = 3_000_000


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (2 * rows of the class)."""
    total = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("p")
    ).select(F.struct("n", "p")).scalar()
    t = df.withColumn("_t", total)
    of_class = F.when(F.col(label) == 1, F.col("_t.p")).otherwise(F.col("_t.n") - F.col("_t.p"))
    return t.withColumn("weight", F.col("_t.n") / (2.0 * of_class)).drop("_t")


def reloaded(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model without its training summary, which holds the session: one that has observed a table can't be sent to tasks."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    return PipelineModel.load(path)


@dataclass
class ForestModel:
    """A forest in parts on files, (path, trees) each; the driver holds one part at a time, never all trees."""

    parts: list[tuple[str, int]]

    def score(self, df: DataFrame, out: str = "router_score") -> DataFrame:
        """Mean share of class 1 over all trees.  One part is a plain transform; of several, each writes its votes by row."""
        if len(self.parts) == 1:
            return _probability(RandomForestClassificationModel.load(self.parts[0][0]), df, out)
        # Nested in a struct, the columns of df can't meet those that are added.
        rows = stored(df.select(F.monotonically_increasing_id().alias("_id"), F.struct(*df.columns).alias("_row")), "rows")
        votes = None
        for i, (path, trees) in enumerate(self.parts):
            part = RandomForestClassificationModel.load(path).transform(rows.select("_id", F.col("_row.features").alias("features")))
            vote = F.struct(F.lit(i).alias("part"), (vector_to_array("probability")[1] * float(trees)).alias("v"))
            kept = stored(part.select("_id", vote.alias("vote")), "votes")
            votes = kept if votes is None else votes.unionByName(kept)
        total = float(sum(trees for _, trees in self.parts))
        in_order = F.transform(F.array_sort(F.collect_list("vote")), lambda x: x["v"])
        mean = votes.groupBy("_id").agg((F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x) / total).alias("_mean"))
        return rows.join(mean, "_id").select("_row.*", F.col("_mean").alias(out))

    def save(self, spark: SparkSession, path: str) -> None:
        for i, (part, _) in enumerate(self.parts):
            RandomForestClassificationModel.load(part).write().overwrite().save(f"{path}/{i}")
        rows = [(i, trees) for i, (_, trees) in enumerate(self.parts)]
        spark.createDataFrame(rows, "part int, trees int").write.mode("overwrite").parquet(f"{path}/parts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestModel":
        rows = spark.read.parquet(f"{path}/parts").orderBy("part").collect()
        return ForestModel([(f"{path}/{r.part}", r.trees) for r in rows])


def _probability(model: Transformer, df: DataFrame, out: str) -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*df.columns, out)


def positive_score(model: Transformer | LinearModel | ForestModel, df: DataFrame, out: str = "router_score") -> DataFrame:
    """Probability of class 1; the model is applied as it is, never refitted."""
    if isinstance(model, LinearModel | ForestModel):
        return model.score(df, out)
    return _probability(model, df, out)


@dataclass
class Detector:
    """A fitted model with the thresholds chosen on validation rows."""

    name: str
    model: PipelineModel | LinearModel | ForestModel
    thresholds: DataFrame
    selected_c: float | None = None
    candidates: list[dict] = field(default_factory=list)

    def save(self, path: str) -> None:
        if isinstance(self.model, LinearModel):
            self.model.save(self.thresholds.sparkSession, f"{path}/linear")
        elif isinstance(self.model, ForestModel):
            self.model.save(self.thresholds.sparkSession, f"{path}/forest")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        self.thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")

    @staticmethod
    def load(spark: SparkSession, path: str, name: str, linear: bool = False, forest: bool = False) -> "Detector":
        if forest:
            model = ForestModel.load(spark, f"{path}/forest")
        else:
            model = LinearModel.load(spark, f"{path}/linear") if linear else PipelineModel.load(f"{path}/model")
        return Detector(name, model, spark.read.parquet(f"{path}/thresholds"))


@dataclass
class TextDetector:
    """A detector with the vectoriser of its training texts; both are applied as they are, never refitted."""

    vectoriser: Vectoriser
    detector: Detector

    def vectors(self, rows: DataFrame, text: str = "prompt") -> DataFrame:
        return self.vectoriser.arrays(rows, text)

    def score(self, rows: DataFrame, text: str = "prompt") -> DataFrame:
        return positive_score(self.detector.model, self.vectors(rows, text)).drop("idx", "weight")

    def save(self, path: str) -> None:
        self.vectoriser.save(f"{path}/terms")
        self.detector.save(path)

    @staticmethod
    def load(spark: SparkSession, path: str, name: str) -> "TextDetector":
        return TextDetector(Vectoriser.load(spark, f"{path}/terms"), Detector.load(spark, path, name, linear=True))


def fit_text_detector(
    train: DataFrame, validation: DataFrame, text: str = "prompt", name: str = "text_logreg", c_values: Sequence[float] = tuple(TEXT_C), max_iter: int = 100
) -> TextDetector:
    """Vocabulary, idf and classifier from the training rows; C and thresholds from the validation rows.

    Texts are read for the vocabulary and once more for their weights, which are written: fitting reads
    these once per iteration, for all values of C together.
    """
    vectoriser = fit_vectoriser(train, text=text)
    rows = with_class_weights(train.select(text, F.col("label").cast("int").alias("label"))).withColumnRenamed("weight", "row_weight")
    models = fit_grid(stored_blocks(vectoriser.blocks(rows, text)), vectoriser.size, c_values, max_iter)
    held = stored(vectoriser.arrays(validation.select("sample_id", "label", text), text), "weights")
    return TextDetector(vectoriser, chosen(name, models, validated(models, held)))


def validated(models: dict[float, PipelineModel] | dict[float, LinearModel] | dict[float, ForestModel], validation: DataFrame) -> DataFrame:
    """Operating points of every candidate on validation rows, materialised.

    All candidates are scored into one long table, so their curves are one job; the result
    is a handful of rows per candidate.
    """
    scored = None
    for c, model in models.items():
        part = positive_score(model, validation).select(F.lit(float(c)).alias("candidate"), "label", "router_score")
        scored = part if scored is None else scored.unionByName(part)
    curve = th.metric_curve(stored(scored, "scored"), ["candidate"])
    return stored(th.threshold_set(curve, ["candidate"]), "thresholds")


def _logreg(c: float, weight_sum: float, max_iter: int, features: str = "features") -> LogisticRegression:
    # The penalty is stated against the summed loss; Spark states it against the mean.
    return LogisticRegression(
        featuresCol=features,
        weightCol="weight",
        regParam=1.0 / (c * weight_sum),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
    )


def fit_logreg_grid(
    train: DataFrame,
    validation: DataFrame,
    name: str = "text_logreg",
    c_values: Sequence[float] = tuple(TEXT_C),
    max_iter: int = 100,
    scale: bool = False,
) -> Detector:
    """One fit per C; the best validation F1 (then recall) wins.

    The loop is over the few C values; every fit and every evaluation is distributed.
    """
    weighted = with_class_weights(train)
    stages: list[Transformer] = []
    column = "features"
    if scale:
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        stages = [scaler.fit(weighted)]
        weighted, column = stages[0].transform(weighted), "scaled"
    weight_sum = float(weighted.agg(F.sum("weight")).first()[0])
    spark = train.sparkSession
    models = {
        float(c): reloaded(PipelineModel([*stages, _logreg(c, weight_sum, max_iter, column).fit(weighted)]), spark) for c in c_values
    }
    return chosen(name, models, validated(models, validation.select("sample_id", "label", "features")))


def chosen(name: str, models: dict, points: DataFrame) -> Detector:
    """The candidate of best validation F1, then recall, with its operating points."""
    tops = points.filter("policy = 'best_f1'").select("candidate", "f1", "recall").collect()
    ranks = {row["candidate"]: (row["f1"], row["recall"]) for row in tops}
    best = max(models, key=lambda c: ranks[c])
    candidates = [{"C": c, "best_f1": ranks[c][0], "recall": ranks[c][1]} for c in models]
    return Detector(name, models[best], points.filter(F.col("candidate") == best).drop("candidate"), best, candidates)


def fit_forest(
    train: DataFrame,
    validation: DataFrame,
    name: str = "vector_forest",
    trees: int = 300,
    max_depth: int = 30,
    seed: int = 42,
    tree_rows: int = TREE_ROWS,
) -> Detector:
    """A forest of full trees.  Nodes grow with rows times trees, so trees are fitted and written in parts of
    ``tree_rows`` rows times trees, one at least; a forest within that is one part."""
    weighted = with_class_weights(train)
    size = max(1, min(trees, tree_rows // max(1, train.count())))
    if size < trees:
        weighted = stored(weighted, "weighted")
    parts = []
    for i, first in enumerate(range(0, trees, size)):
        n = min(size, trees - first)
        # Tasks keep the node of every row and tree, so no level sends them the trees or walks these from the root again.
        forest = RandomForestClassifier(
            numTrees=n, maxDepth=max_depth, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed + i, cacheNodeIds=True
        )
        path = scratch_path(train.sparkSession, "trees")
        forest.fit(weighted).write().save(path)
        parts.append((path, n))
    model = ForestModel(parts)
    return Detector(name, model, validated({0.0: model}, validation).drop("candidate"))


def coefficient_table(detector: Detector, indexed: DataFrame) -> tuple[DataFrame, float]:
    """(space, term, coefficient) of a linear text model, and its intercept."""
    table = detector.model.table(indexed.sparkSession)
    return indexed.select("space", "term", "idx").join(table, "idx").drop("idx"), detector.model.intercept


INTERVALS_AT = ("threshold_0_5", "best_f1")


def evaluate_suite(
    detector: Detector, datasets: DataFrame, seed: int = 20260604, replicates: int = 500, dataset: str = "dataset",
    intervals_at: Sequence[str] = INTERVALS_AT,
) -> dict[str, DataFrame]:
    """What a detector does on validation, test and external parts (``dataset`` names them), refitted on none.

    ``figures``: classification and triage rows of every part at the thresholds chosen on validation rows;
    ``labels``: rows per label; ``summary``: score spread; ``intervals``: of every metric, at the 0.5 and the
    best-F1 threshold.  Rows are scored once and written.
    """
    rows = positive_score(detector.model, datasets).select(dataset, "label", "router_score")
    scored = stored(rows, "scored")
    taus = detector.thresholds.filter(F.col("policy").isin(*intervals_at)).select("policy", "tau")
    at: Column = taus.agg(F.collect_list(F.struct("policy", "tau")).alias("t")).scalar()
    flagged = scored.withColumn("_at", at).select(dataset, "label", "router_score", F.inline("_at"))
    return {
        "figures": th.apply_threshold_set(scored, detector.thresholds, [dataset]),
        "labels": label_counts(scored, [dataset]),
        "summary": score_summary(scored, groups=[dataset]),
        "intervals": bootstrap_ci(
            flagged, (F.col("router_score") >= F.col("tau")).cast("int"), [dataset, "policy"], seed, replicates
        ),
    }
