"""Model features, splits, training and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.feature_sql import CF, churn_feature_table
from checks.fixture_sql import P
from checks.registry import Tables, add, r6, rounded
from checks.row_checks import SCORES
from emberline.functions.times import plus_days, ts_lit
from emberline.ml import churn_model as cm
from emberline.ml import evaluation, splits
from emberline.operators.features import engineer_features
from checks.fixtures import AS_OF
from emberline.sources.storage import work_folder


def labels(t: Tables):
    """Churned: not active in the seven days before ``AS_OF``."""
    return t.P.select("player_id", (F.col("last_active_date") < plus_days(ts_lit(AS_OF), -7)).alias("churned"))


def data(t: Tables):
    return cm.training_data(churn_feature_table(t), labels(t))


def searched(t: Tables):
    """A full search of five folds, on grids of two small values in each dimension."""
    return cm.train_models(data(t), grids=cm.SMALL_GRIDS)


def trained(t: Tables):
    """Some fitted model, scored over five folds."""
    return cm.train_models(data(t), grids={"random_forest": cm.POINT_GRIDS["random_forest"]})


RAW = ", ".join(f"round(1e-9 + {c}::DOUBLE, 6) AS {c}" for c in cm.RAW_FEATURES)
LABEL = "LEFT JOIN (SELECT player_id, last_active_date < TIMESTAMP '2024-01-23 00:00:00' AS churned FROM P) USING (player_id)"


def _spread(df, column, *keep):
    """Vector elements as plain columns."""
    elements = vector_to_array(column)
    return df.select(*keep, *[r6(elements[i]).alias(n) for i, n in enumerate(cm.FEATURE_COLUMNS)])


add(
    "ml_matrix",
    lambda t: _spread(cm.feature_matrix(data(t)), "features", "player_id", F.col("label").cast("int").alias("label")),
    CF,
    f"SELECT player_id, churned::INTEGER AS label, {RAW} {SCORES} FROM CF {LABEL}",
)
RANKED = f"""rk AS (SELECT player_id, churned, row_number() OVER (PARTITION BY churned ORDER BY md5('42:' || player_id)) - 1 AS r,
    count(*) OVER (PARTITION BY churned) AS n FROM CF {LABEL})"""
add(
    "stratified_split",
    lambda t: splits.stratified_split(data(t)).select("player_id", F.col("label").cast("int").alias("label"), "is_test"),
    CF,
    f", {RANKED} SELECT player_id, churned::INTEGER AS label, r < round(n * 0.2) AS is_test FROM rk",
)
add(
    "stratified_folds",
    lambda t: splits.stratified_folds(data(t), 5).select("player_id", "fold"),
    CF,
    f", {RANKED} SELECT player_id, CAST(r % 5 AS INTEGER) AS fold FROM rk",
)


def _scaled(t: Tables):
    split = splits.stratified_split(data(t))
    model = cm.fit_preprocessing(split.where(~F.col("is_test")))
    return _spread(model.transform(split), "features", "player_id")


_ENG = f"SELECT player_id, r < round(n * 0.2) AS is_test, {', '.join(cm.RAW_FEATURES)} {SCORES} FROM rk JOIN CF USING (player_id)"
_EXACT = _ENG
for _n in cm.SCORE_FEATURES:
    _EXACT = _EXACT.replace(f", 6) AS {_n}", f", 15) AS {_n}")
add(
    "scale",
    _scaled,
    CF,
    f""", {RANKED}, en AS ({_EXACT}), m AS (SELECT {', '.join(
        f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in cm.FEATURE_COLUMNS)} FROM en WHERE NOT is_test)
    SELECT player_id, {', '.join(f"round(1e-9 + ({c} - a_{c}) / s_{c}, 6) AS {c}" for c in cm.FEATURE_COLUMNS)} FROM en, m""",
)


def in_range(column):
    return F.coalesce(F.col(column).between(0.0, 1.0), F.lit(False))


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "cv_score")


def _training_report(t: Tables):
    """What must hold of each model: metrics in [0, 1], a useful AUC, and one best model among all."""
    model = searched(t)
    rows = [(name, name == model.name, *[float(m[k]) for k in METRICS]) for name, m in model.metrics.items()]
    report = t.spark.createDataFrame(rows, "model string, is_best boolean, " + ", ".join(f"{m} double" for m in METRICS))
    best = report.agg(F.count_if("is_best")).scalar()
    ranged = F.array(*[in_range(m) for m in METRICS])
    return report.select(
        "model", F.forall(ranged, lambda x: x).alias("metrics_in_range"), (F.col("roc_auc") >= 0.7).alias("useful"), best.alias("best_models")
    )


add(
    "train_models", _training_report, [P],
    """SELECT unnest(['random_forest', 'gradient_boosting']) AS model, true AS metrics_in_range, true AS useful, 1::BIGINT AS best_models""",
)
add(
    "cross_validate",
    lambda t: t.spark.createDataFrame(
        sorted(cm.cross_validate(trained(t), data(t)).items()), "metric string, value double"
    ).select("metric", in_range("value").alias("in_range")),
    [P],
    """SELECT m || s AS metric, true AS in_range FROM (SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) AS m),
      (SELECT unnest(['_mean', '_std']) AS s)""",
)
add(
    "predict_proba",
    lambda t: trained(t).predict_proba(churn_feature_table(t)).select("player_id", in_range("churn_probability").alias("in_range")),
    [P],
    "SELECT player_id, true AS in_range FROM P",
)
add(
    "predict_label",
    lambda t: trained(t).predict(churn_feature_table(t)).select(
        "player_id", (F.col("will_churn") == (F.col("churn_probability") > 0.5)).alias("follows_probability")
    ),
    [P],
    "SELECT player_id, true AS follows_probability FROM P",
)
add(
    "model_accuracy_gate",
    lambda t: evaluation.accuracy_gate(
        trained(t).predict(churn_feature_table(t)).join(labels(t), "player_id").select(
            F.col("churned").cast("double").alias("label"), F.col("will_churn").cast("double").alias("prediction"),
            F.col("churn_probability").alias("probability"),
        )
    ).select("meets_threshold"),
    [P],
    "SELECT true AS meets_threshold",
)


def _saved(t: Tables):
    """The inputs of the stored model in their order, and its kind of stages."""
    folder = work_folder(t.spark)
    trained(t).save(folder)
    stages = cm.ChurnModel.load(folder).pipeline.stages
    kinds = ",".join(type(s).__name__ for s in stages[:-1])
    return t.spark.createDataFrame([(i, c, kinds) for i, c in enumerate(stages[0].getInputCols())], "position int, feature string, stages string")


def _reloaded(t: Tables):
    """Scores of all players from the fitted model and from its stored copy."""
    folder = work_folder(t.spark)
    model = trained(t)
    model.save(folder)
    again = cm.ChurnModel.load(folder)
    features = churn_feature_table(t)
    pairs = model.predict_proba(features).join(
        again.predict_proba(features).withColumnRenamed("churn_probability", "reloaded"), "player_id"
    )
    return pairs.select("player_id", (F.col("churn_probability") == F.col("reloaded")).alias("equal"))


add(
    "save_model", _saved, [P],
    f"""SELECT unnest(range({len(cm.FEATURE_COLUMNS)}))::INTEGER AS position, unnest({list(cm.FEATURE_COLUMNS)}) AS feature,
      'VectorAssembler,StandardScalerModel,ElementwiseProduct' AS stages""",
)
add("load_model", _reloaded, [P], "SELECT player_id, true AS equal FROM P")


def scored(t: Tables):
    """Predictions made straight from the stored risk score, so that SQL can follow."""
    return labels(t).join(t.P.select("player_id", "churn_risk_score"), "player_id").select(
        F.col("churned").cast("int").cast("double").alias("label"),
        F.col("churn_risk_score").alias("probability"),
        (F.col("churn_risk_score") >= 0.5).cast("double").alias("prediction"),
    )


SCORED = """sc AS (SELECT (last_active_date < TIMESTAMP '2024-01-23 00:00:00')::INT AS l, churn_risk_score AS s,
    (churn_risk_score >= 0.5)::INT AS p FROM P),
  cf AS (SELECT count(*) FILTER (l = 0 AND p = 0) AS tn, count(*) FILTER (l = 0 AND p = 1) AS fp,
    count(*) FILTER (l = 1 AND p = 0) AS fn, count(*) FILTER (l = 1 AND p = 1) AS tp FROM sc)"""
add(
    "evaluate_predictions",
    lambda t: rounded(evaluation.evaluate_predictions(scored(t)), "roc_auc", "f1_score"),
    [P],
    f""", {SCORED} SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
      (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall,
      round(1e-9 + 2.0 * tp::DOUBLE / (2 * tp + fp + fn), 6) AS f1_score,
      (SELECT round(1e-9 + avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6) FROM sc a, sc b WHERE a.l = 1 AND b.l = 0) AS roc_auc
    FROM cf""",
)
add(
    "classification_report",
    lambda t: rounded(evaluation.classification_report(scored(t)), "precision", "recall", "f1_score"),
    [P],
    f""", {SCORED}, c AS (SELECT '0' AS class, tn::DOUBLE / (tn + fn) AS precision, tn::DOUBLE / (tn + fp) AS recall,
        2.0 * tn / (2 * tn + fn + fp) AS f1_score, tn + fp AS support FROM cf
      UNION ALL SELECT '1', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), 2.0 * tp / (2 * tp + fp + fn), tp + fn FROM cf),
    x AS (SELECT * FROM c UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM c
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1_score * support) / sum(support), sum(support) FROM c)
    SELECT class, round(1e-9 + precision, 6) AS precision, round(1e-9 + recall, 6) AS recall, round(1e-9 + f1_score, 6) AS f1_score,
      support::BIGINT AS support FROM x""",
)
add(
    "accuracy_gate",
    lambda t: evaluation.accuracy_gate(scored(t)),
    [P],
    f""", {SCORED} SELECT (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
      (tp + tn)::DOUBLE / (tp + tn + fp + fn) >= 0.8 AS meets_threshold FROM cf""",
)
add(
    "engineer_features",
    lambda t: rounded(engineer_features(churn_feature_table(t)).select("player_id", *cm.FEATURE_COLUMNS), *cm.FEATURE_COLUMNS),
    CF,
    f"SELECT player_id, {RAW.replace('::DOUBLE', '')} {SCORES} FROM CF",
)
