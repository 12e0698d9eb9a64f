"""Exact stratified ranks, splits and folds without gathering a class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of the seeded hash that form the bucket: 16 ** 3 = 4096 buckets per class.
BUCKET_DIGITS = 3


def stratified_rank(
    df: DataFrame, label: str = "label", key: str = "player_id", seed: int = 42, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Add ``class_rank`` (0-based position in seeded hash order) and ``class_rows`` per label.

    Rows are ranked inside (label, hash prefix) buckets and shifted by the rows
    of the buckets before, so a class of any size is spread over all buckets.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn(
        "_b", F.substring("_h", 1, digits)
    )
    per_label = Window.partitionBy(label)  # at most 16 ** digits rows per label
    offsets = (
        hashed.groupBy(label, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col(label).alias("_l"),
            F.col("_b").alias("_ob"),
            (F.sum("_n").over(per_label.orderBy("_b")) - F.col("_n")).alias("_before"),
            F.sum("_n").over(per_label).alias("class_rows"),
        )
    )
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h"))
    return (
        hashed.withColumn("_i", inside)
        .join(offsets, (F.col(label) == F.col("_l")) & (F.col("_b") == F.col("_ob")))
        .withColumn("class_rank", F.col("_before") + F.col("_i") - 1)
        .drop("_h", "_b", "_i", "_l", "_ob", "_before")
    )


def stratified_split(
    df: DataFrame, test_fraction: float = 0.2, label: str = "label", key: str = "player_id", seed: int = 42
) -> DataFrame:
    """Add ``is_test``: exactly the rounded fraction of every class."""
    ranked = stratified_rank(df, label, key, seed)
    held_out = F.col("class_rank") < F.round(F.col("class_rows") * test_fraction)
    return ranked.withColumn("is_test", held_out).drop("class_rank", "class_rows")


def stratified_folds(
    df: DataFrame, folds: int = 5, label: str = "label", key: str = "player_id", seed: int = 42
) -> DataFrame:
    """Add an int column ``fold`` in [0, folds), balanced within every class."""
    ranked = stratified_rank(df, label, key, seed)
    return ranked.withColumn("fold", (F.col("class_rank") % folds).cast("int")).drop("class_rank", "class_rows")
