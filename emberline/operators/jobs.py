"""Analysis of failure logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import failure_class
from emberline.functions.times import When, ts_lit


def failed_jobs_stats(jobs: DataFrame, as_of: When) -> DataFrame:
    """Counts in total, by type and by reason, with retry state and time range."""
    exhausted = F.col("retry_count") >= F.col("max_retries")
    ready = ~exhausted & (F.col("next_retry_time") <= ts_lit(as_of))
    grouping = F.explode(
        F.array(
            F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
            F.struct(F.lit("job_type").alias("dimension"), F.col("job_type").alias("value")),
            F.struct(F.lit("failure_reason").alias("dimension"), F.col("failure_reason").alias("value")),
        )
    )
    return (
        jobs.groupBy("job_type", "failure_reason")  # a few dozen groups: the three views are rolled up from them
        .agg(
            F.count(F.lit(1)).alias("jobs"),
            F.count_if(exhausted).alias("exhausted"),
            F.count_if(ready).alias("ready"),
            F.min("failure_timestamp").alias("oldest"),
            F.max("failure_timestamp").alias("newest"),
        )
        .select("*", grouping.alias("g"))
        .groupBy("g.dimension", "g.value")
        .agg(
            F.sum("jobs").alias("jobs"),
            F.sum("exhausted").alias("exhausted_retries"),
            F.sum("ready").alias("ready_for_retry"),
            F.min("oldest").alias("oldest_job"),
            F.max("newest").alias("newest_job"),
        )
        .orderBy("dimension", "value")
    )


def failed_jobs_filter(
    jobs: DataFrame, job_type: str | None = None, failure_reason: str | None = None
) -> DataFrame:
    """Failed jobs of a type and reason, newest first."""
    if job_type:
        jobs = jobs.where(F.col("job_type") == job_type)
    if failure_reason:
        jobs = jobs.where(F.col("failure_reason") == failure_reason)
    return jobs.orderBy(F.desc("failure_timestamp"))


def classify_failures(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("inferred_reason", failure_class("error_message"))


def top_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent ``type:message`` signatures."""
    signature = F.concat_ws(":", "error_type", "error_message")
    return (
        errors.groupBy(signature.alias("error"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("occurrences"), "error")
        .limit(n)
    )
