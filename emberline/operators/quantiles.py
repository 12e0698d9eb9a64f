"""Exact linear-interpolated quantiles of groups that may be arbitrarily large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, copies) for non-null values; equal values collapse on the map side."""
    return (
        df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("copies"))
    )


def exact_quantiles(
    counted: DataFrame,
    key: str,
    quantiles: dict[str, float],
    lower: float = 0.0,
    upper: float = 1.0,
    buckets: int = 4096,
) -> DataFrame:
    """One row per key with a column per named quantile.

    ``counted`` comes from :func:`value_counts`. Values are cut into ``buckets``
    ordered buckets over [lower, upper] (values outside fall into the end
    buckets, which keeps the order), so running ranks are computed per
    (key, bucket) and no task ever holds a whole group.
    """
    step = (F.col("value") - F.lit(lower)) * F.lit(buckets / (upper - lower))
    bucketed = counted.withColumn(
        "bucket", F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(step))).cast("int")
    )
    per_key = Window.partitionBy(key)  # at most `buckets` rows per key
    offsets = (
        bucketed.groupBy(key, "bucket")
        .agg(F.sum("copies").alias("bucket_rows"))
        .select(
            key,
            "bucket",
            (F.sum("bucket_rows").over(per_key.orderBy("bucket")) - F.col("bucket_rows")).alias("rows_before"),
            F.sum("bucket_rows").over(per_key).alias("rows_total"),
        )
    )
    inside = Window.partitionBy(key, "bucket").orderBy("value")
    ranked = bucketed.join(offsets, [key, "bucket"]).withColumn(
        "end_rank", F.col("rows_before") + F.sum("copies").over(inside)
    )
    start_rank = F.col("end_rank") - F.col("copies")

    def value_at(position: Column) -> Column:
        return F.max(F.when((start_rank <= position) & (position < F.col("end_rank")), F.col("value")))

    picks, results = [], []
    for name, q in quantiles.items():
        position = (F.col("rows_total") - 1) * F.lit(float(q))
        picks += [
            value_at(F.floor(position)).alias(f"{name}_low"),
            value_at(F.ceil(position)).alias(f"{name}_high"),
            F.max(position - F.floor(position)).alias(f"{name}_part"),
        ]
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        results.append((low + (high - low) * F.col(f"{name}_part")).alias(name))
    return ranked.groupBy(key).agg(*picks).select(key, *results)
