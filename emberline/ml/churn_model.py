"""Churn models: preprocessing, grid search, prediction, storage."""

from __future__ import annotations

import itertools
import json
import logging
import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.ml.evaluation import point_metrics, roc_auc
from emberline.ml.splits import stratified_folds, stratified_split
from emberline.operators.features import RAW_FEATURES, engineer_features

logger = logging.getLogger(__name__)

SCORE_FEATURES = (
    "session_frequency_score",
    "engagement_score",
    "monetary_score",
    "social_score",
    "recency_score",
)
FEATURE_COLUMNS = (*RAW_FEATURES, *SCORE_FEATURES)
SEED = 42
MIN_ROWS = 10
ROWS_PER_PARTITION = 50_000

# The hyper-parameter grids. An unlimited depth is MLlib's maximum of 30.
GRIDS = {
    "random_forest": {"numTrees": [100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2]},
    "gradient_boosting": {"maxIter": [100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.1, 0.2]},
}
#: Small values in every dimension of the same search.
SMALL_GRIDS = {
    "random_forest": {"numTrees": [5, 10], "maxDepth": [2, 4], "minInstancesPerNode": [1, 2]},
    "gradient_boosting": {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.1, 0.2]},
}
#: One point of each, for what only needs some fitted model.
POINT_GRIDS = {name: {p: values[:1] for p, values in grid.items()} for name, grid in SMALL_GRIDS.items()}


def training_data(churn_features: DataFrame, labels: DataFrame) -> DataFrame:
    """Engineered features with a 0/1 ``label``; every player needs exactly one label.

    ``labels`` has player_id and a boolean ``churned``.
    """
    rows = engineer_features(churn_features).join(
        labels.select("player_id", F.col("churned").cast("int").cast("double").alias("label")), "player_id"
    )
    sides = churn_features.select(F.lit(1).alias("f"), F.lit(0).alias("l")).unionByName(
        labels.select(F.lit(0).alias("f"), F.lit(1).alias("l"))
    )
    counts = sides.agg(F.sum("f").alias("features"), F.sum("l").alias("labels")).first()
    if not counts["features"]:
        raise ValueError("there is nothing to train on")
    if counts["features"] != counts["labels"]:
        raise ValueError("every player with features needs exactly one label")
    return rows


def feature_matrix(engineered: DataFrame, output: str = "features") -> DataFrame:
    """The 11 model columns, in order, as one vector column."""
    return VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol=output).transform(engineered)


def fit_preprocessing(train: DataFrame) -> PipelineModel:
    """Assembler and standardisation with the population deviation, fitted on ``train``.

    MLlib's scaler divides by the sample deviation; the constant factor
    sqrt(n / (n - 1)) turns that into the population one.
    """
    assembler = VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="assembled")
    assembled = assembler.transform(train)
    scaler = StandardScaler(inputCol="assembled", outputCol="standardised", withMean=True, withStd=True).fit(assembled)
    n = train.count()
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    adjust = ElementwiseProduct(
        inputCol="standardised", outputCol="features", scalingVec=Vectors.dense([factor] * len(FEATURE_COLUMNS))
    )
    return PipelineModel([assembler, scaler, adjust])


def _packed(rows: DataFrame, columns: list[str], players: int) -> DataFrame:
    """``columns`` of ``rows`` in few partitions, in an order of their own: a fit is a series of short jobs.

    A shuffle, as ``coalesce`` would run all sorts and windows before it in those few tasks, each of
    which holds the memory of every partition that it goes through.
    """
    parts = players // ROWS_PER_PARTITION + 1
    return rows.select("player_id", *columns).repartition(parts, "player_id").sortWithinPartitions("player_id").drop("player_id")


def _classifier(name: str):
    if name == "random_forest":
        return RandomForestClassifier(labelCol="label", featuresCol="features", seed=SEED)
    return GBTClassifier(labelCol="label", featuresCol="features", seed=SEED)


def _auc() -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0)


@dataclass
class ChurnModel:
    """A fitted preprocessing and classifier with the metrics of the whole comparison."""

    pipeline: PipelineModel
    name: str
    metrics: dict[str, dict] = field(default_factory=dict)
    params: dict[str, float] = field(default_factory=dict)
    feature_columns: tuple[str, ...] = FEATURE_COLUMNS

    def predict(self, churn_features: DataFrame) -> DataFrame:
        """player_id, churn_probability and the boolean will_churn; empty in, empty out."""
        scored = self.pipeline.transform(engineer_features(churn_features))
        return scored.select(
            "player_id",
            vector_to_array("probability")[1].alias("churn_probability"),
            (F.col("prediction") == 1.0).alias("will_churn"),
        )

    def predict_proba(self, churn_features: DataFrame) -> DataFrame:
        return self.predict(churn_features).select("player_id", "churn_probability")

    def predict_label(self, churn_features: DataFrame) -> DataFrame:
        return self.predict(churn_features).select("player_id", "will_churn")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        note = {"name": self.name, "feature_columns": list(self.feature_columns), "params": self.params}
        row = SparkSession.active().createDataFrame([(json.dumps(note),)], "value string")
        row.write.mode("overwrite").text(f"{path}/note")

    @staticmethod
    def load(path: str) -> ChurnModel:
        note = json.loads(SparkSession.active().read.text(f"{path}/note").first()["value"])
        if tuple(note["feature_columns"]) != FEATURE_COLUMNS:
            logger.warning("the stored model was fitted on other columns")
        return ChurnModel(
            PipelineModel.load(f"{path}/pipeline"), note["name"], {}, note["params"], tuple(note["feature_columns"])
        )


#: The parameter of each model that counts its trees: the first k trees of a fit are a fit of k trees.
TREES = {"random_forest": "numTrees", "gradient_boosting": "maxIter"}


def _points(name: str, grid: dict[str, list]) -> tuple[list[dict], list[int]]:
    """The points of a grid without the number of trees, and the numbers of trees, the largest last."""
    counts = sorted(grid.get(TREES[name], []))
    rest = [(p, values) for p, values in grid.items() if p != TREES[name]]
    points = [dict(zip((p for p, _ in rest), values, strict=True)) for values in itertools.product(*(v for _, v in rest))]
    return points, counts


def first_trees(model, k: int):
    """A model of the first ``k`` trees of a fitted one, which is what fitting stops at there."""
    java = model._java_obj
    trees = java.trees()
    if k >= len(trees):
        return model
    context = SparkSession.active().sparkContext
    kinds = context._jvm.org.apache.spark.ml

    def first(array, kind):
        some = context._gateway.new_array(kind, k)
        for i in range(k):
            some[i] = array[i]
        return some

    if isinstance(model, GBTClassificationModel):
        some = first(trees, kinds.regression.DecisionTreeRegressionModel)
        weights = first(java.treeWeights(), context._jvm.double)
        cut = GBTClassificationModel(kinds.classification.GBTClassificationModel(java.uid(), some, weights, java.numFeatures(), 2))
    else:
        some = first(trees, kinds.classification.DecisionTreeClassificationModel)
        cut = RandomForestClassificationModel(kinds.classification.RandomForestClassificationModel(java.uid(), some, java.numFeatures(), 2))
    return model._copyValues(cut)


def _search(name: str, grid: dict[str, list], folded: DataFrame, cv_folds: int, parallelism: int) -> tuple[dict, float]:
    """The point with the best mean AUC over the folds, and that mean. Each fit answers for all numbers of trees."""
    points, counts = _points(name, grid)

    def fold_scores(job) -> list[float]:
        point, fold = job
        classifier = _classifier(name)
        classifier.setParams(**point, **({TREES[name]: counts[-1]} if counts else {}))
        model = classifier.fit(folded.where(F.col("fold") != fold))
        held = folded.where(F.col("fold") == fold)
        return [_auc().evaluate(first_trees(model, k).transform(held)) for k in counts] if counts else [_auc().evaluate(model.transform(held))]

    jobs = [(p, f) for p in points for f in range(cv_folds)]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        scores = pool.map(inheritable_thread_target(SparkSession.active())(fold_scores), jobs)
    best = None
    for i, point in enumerate(points):
        of_point = scores[i * cv_folds : (i + 1) * cv_folds]
        for j, k in enumerate(counts or [None]):
            mean = sum(s[j] for s in of_point) / cv_folds
            if best is None or mean > best[1]:
                best = (point | ({TREES[name]: k} if k is not None else {}), mean)
    return best


def _scores(predictions: DataFrame) -> dict[str, float]:
    row = point_metrics(predictions).first()
    return {
        "accuracy": row["accuracy"],
        "precision": row["precision"],
        "recall": row["recall"],
        "f1": row["f1_score"],
        "roc_auc": roc_auc(predictions, "rawPrediction"),
    }


def train_models(
    data: DataFrame,
    test_size: float = 0.2,
    cv_folds: int = 5,
    grids: dict[str, dict[str, list]] | None = None,
    parallelism: int = 8,
) -> ChurnModel:
    """Search each model's grid by cross-validated AUC; keep the model with the best test AUC."""
    grids = GRIDS if grids is None else grids
    split = stratified_split(data, test_size).persist()
    try:
        rows = split.count()
        if rows < MIN_ROWS:
            raise ValueError(f"training needs {MIN_ROWS} players or more")
        train = split.where(~F.col("is_test"))
        preprocessing = fit_preprocessing(train)
        wanted = ["label", "features"]
        folded = _packed(preprocessing.transform(stratified_folds(train, cv_folds)), [*wanted, "fold"], rows).persist()
        test = _packed(preprocessing.transform(split.where("is_test")), wanted, rows).persist()
        results, best = {}, None
        for name, points in grids.items():
            chosen, cv_score = _search(name, points, folded, cv_folds, parallelism)
            classifier = _classifier(name)
            classifier.setParams(**chosen)
            model = classifier.fit(folded)
            metrics = _scores(model.transform(test))
            results[name] = metrics | {"cv_score": cv_score, "best_params": chosen}
            if best is None or metrics["roc_auc"] > best[0]:
                best = (metrics["roc_auc"], name, model, chosen)
        folded.unpersist()
        test.unpersist()
    finally:
        split.unpersist()
    _, name, model, chosen = best
    return ChurnModel(PipelineModel([*preprocessing.stages, model]), name, results, chosen)


def cross_validate(model: ChurnModel, data: DataFrame, cv_folds: int = 5) -> dict[str, float]:
    """Mean and deviation of five metrics over stratified folds, refitting the chosen model."""
    preprocessing = PipelineModel(model.pipeline.stages[:-1])
    folded = _packed(preprocessing.transform(stratified_folds(data, cv_folds)), ["label", "features", "fold"], data.count()).persist()
    scores: dict[str, list[float]] = {}
    try:
        for fold in range(cv_folds):
            classifier = _classifier(model.name)
            classifier.setParams(**model.params)
            fitted = classifier.fit(folded.where(F.col("fold") != fold))
            for metric, value in _scores(fitted.transform(folded.where(F.col("fold") == fold))).items():
                scores.setdefault(metric, []).append(value)
    finally:
        folded.unpersist()
    summary = {}
    for metric, values in scores.items():
        mean = sum(values) / len(values)
        summary[f"{metric}_mean"] = mean
        summary[f"{metric}_std"] = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return summary

