"""Quality of predictions, from one aggregation over (label, prediction)."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_ACCURACY = 0.8


def confusion(predictions: DataFrame) -> DataFrame:
    """One row: true/false negatives and positives."""

    def cell(label: int, prediction: int):
        return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))

    return predictions.agg(
        cell(0, 0).alias("true_negatives"),
        cell(0, 1).alias("false_positives"),
        cell(1, 0).alias("false_negatives"),
        cell(1, 1).alias("true_positives"),
    )


def _or_zero(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def point_metrics(predictions: DataFrame) -> DataFrame:
    """Confusion counts with accuracy, precision, recall and F1 of the positive class."""
    tn, fp = F.col("true_negatives"), F.col("false_positives")
    fn, tp = F.col("false_negatives"), F.col("true_positives")
    return (
        confusion(predictions)
        .withColumn("accuracy", _or_zero(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", _or_zero(tp, tp + fp))
        .withColumn("recall", _or_zero(tp, tp + fn))
        .withColumn("f1_score", _or_zero(tp * 2, tp * 2 + fp + fn))
    )


def roc_auc(predictions: DataFrame, score: str = "probability") -> float:
    """Exact area under the ROC curve (no score binning)."""
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol=score, numBins=0)
    return evaluator.evaluate(predictions)


def evaluate_predictions(predictions: DataFrame, score: str = "probability") -> DataFrame:
    return point_metrics(predictions).withColumn("roc_auc", F.lit(roc_auc(predictions, score)))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    tn, fp = F.col("true_negatives"), F.col("false_positives")
    fn, tp = F.col("false_negatives"), F.col("true_positives")

    def row(name, hits, predicted, actual):
        return F.struct(
            F.lit(name).alias("class"),
            _or_zero(hits, predicted).alias("precision"),
            _or_zero(hits, actual).alias("recall"),
            _or_zero(hits * 2, predicted + actual).alias("f1_score"),
            actual.alias("support"),
        )

    classes = (
        confusion(predictions)
        .select(F.inline(F.array(row("0", tn, tn + fn, tn + fp), row("1", tp, tp + fp, tp + fn))))
    )
    measures = ("precision", "recall", "f1_score")
    total = F.sum("support")
    macro = classes.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], total.alias("support"))
    weighted = classes.agg(
        F.lit("weighted avg").alias("class"),
        *[_or_zero(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in measures],
        total.alias("support"),
    )
    return classes.unionByName(macro).unionByName(weighted)


def accuracy_gate(predictions: DataFrame, threshold: float = MIN_ACCURACY) -> DataFrame:
    return point_metrics(predictions).select("accuracy", (F.col("accuracy") >= threshold).alias("meets_threshold"))
