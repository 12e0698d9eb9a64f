"""The analytics tables derived from a generic event log (see FIXTURES.md, part B).

Every column is an expression over the event row itself, so the views stay lazy.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.times import plus_days, ts_lit

AS_OF = dt.datetime(2024, 1, 30)
COHORT_START, COHORT_END = dt.date(2023, 12, 22), dt.date(2024, 1, 10)
DROPOFF_START, DROPOFF_END = dt.date(2024, 1, 5), dt.date(2024, 1, 25)
KPI_START, KPI_END = dt.date(2023, 12, 22), dt.date(2024, 1, 30)
#: Where the raw log ends. Each player's part of it is moved to end at the player's last activity.
LOG_END = dt.datetime(2024, 1, 31)

# How raw event types map onto player event types.
EVENT_TYPE_MAP = {
    "view": "session_start",
    "error": "session_end",
    "click": "level_complete",
    "signup": "tutorial_complete",
    "purchase": "purchase",
}


def _registered(u: Column) -> Column:
    return ts_lit("2023-12-22 00:00:00") + F.make_dt_interval(days=(u % 20).cast("int"), hours=(u % 24).cast("int"))


def _last_active(u: Column) -> Column:
    idle = (u * 11 % 45).cast("int")
    return F.greatest(_registered(u), plus_days(ts_lit(AS_OF), -idle))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def player_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    sessions = (u * 7 % 120).cast("int")
    return (
        raw_events(spark, sf_dir)
        .select("user_id")
        .distinct()
        .select(
            F.concat(F.lit("player_"), u.cast("string")).alias("player_id"),
            _registered(u).alias("registration_date"),
            _last_active(u).alias("last_active_date"),
            sessions.alias("total_sessions"),
            (sessions * (u % 5 * 20 + 20)).cast("int").alias("total_playtime_minutes"),
            (u * 3 % 40 + 1).cast("int").alias("highest_level_reached"),
            F.when(u % 4 == 0, F.lit(0.0)).otherwise((u * 13 % 90).cast("double") + 0.5).alias("total_purchases"),
            ((u * 37 % 101) / F.lit(100.0)).alias("churn_risk_score"),
            ts_lit(AS_OF).alias("churn_prediction_date"),
        )
    )


def _played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw events, moved so that none follows the player's last activity, with player id and ``k``."""
    u = F.col("user_id")
    return (
        raw_events(spark, sf_dir)
        .withColumn("ts", F.col("ts") - (ts_lit(LOG_END) - _last_active(u)))
        .withColumn("player_id", F.concat(F.lit("player_"), u.cast("string")))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    )


def _mapped(played: DataFrame, *extra: str) -> DataFrame:
    raw_type = F.col("event_type")
    kind = F.lit(None).cast("string")
    for source, target in EVENT_TYPE_MAP.items():
        kind = F.when(raw_type == source, target).otherwise(kind)
    return played.select(
        "player_id",
        F.col("ts").alias("timestamp"),
        kind.alias("event_type"),
        F.when(raw_type == "click", F.col("k") % 30 + 1).alias("level"),
        F.when(raw_type == "purchase", F.col("value")).alias("purchase_amount"),
        F.when(raw_type.isin("view", "error"), F.col("value")).alias("session_duration"),
        *extra,
    )


def player_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(_played(spark, sf_dir))


def historical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it is, not moved: the volume yardstick."""
    u = F.col("user_id")
    full = (
        raw_events(spark, sf_dir)
        .withColumn("player_id", F.concat(F.lit("player_"), u.cast("string")))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    )
    return _mapped(full)


def player_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.floor("value").cast("int")
    return (
        _played(spark, sf_dir)
        .where(F.col("event_type").isin("view", "click"))
        .select(
            F.col("event_id").cast("string").alias("session_id"),
            "player_id",
            F.col("ts").alias("start_time"),
            (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("end_time"),
            minutes.alias("duration_minutes"),
            (F.col("k") % 30 + 1).alias("level_reached"),
        )
    )


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_events with injected nulls, ghosts, future stamps, bad durations and copies."""
    base = _mapped(_played(spark, sf_dir), "event_id", "k")
    n = F.col("event_id")
    player = (
        F.when(n % 97 == 0, F.lit(None).cast("string"))
        .when(n % 53 == 0, F.concat(F.lit("ghost_"), F.col("k").cast("string")))
        .otherwise(F.col("player_id"))
    )
    broken = base.select(
        "event_id",
        player.alias("player_id"),
        F.when(n % 89 == 0, plus_days(F.col("timestamp"), 60)).otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(n % 101 != 0, F.col("event_type")).alias("event_type"),
        "level",
        "purchase_amount",
        F.when((n % 61 == 0) & F.col("session_duration").isNotNull(), F.lit(-1.0))
        .otherwise(F.col("session_duration"))
        .alias("session_duration"),
    )
    copies = F.when(n % 40 == 0, F.lit(2)).otherwise(F.lit(1))
    return broken.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("event_id", "copy")


def social_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return (
        raw_events(spark, sf_dir)
        .select("user_id")
        .distinct()
        .select(
            F.concat(F.lit("player_"), u.cast("string")).alias("player_id"),
            (u % 60).cast("int").alias("social_connections"),
        )
    )


def behavior_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the layout of the behaviour CSV."""
    u = F.col("user_id")
    level = F.when(u % 3 == 0, "High").when(u % 3 == 1, "Medium").otherwise("Low")
    return (
        raw_events(spark, sf_dir)
        .select("user_id")
        .distinct()
        .select(
            u.cast("int").alias("PlayerID"),
            level.alias("EngagementLevel"),
            (u % 20).cast("int").alias("SessionsPerWeek"),
            (u % 170 + 10).cast("int").alias("AvgSessionDurationMinutes"),
            (u % 2).cast("int").alias("InGamePurchases"),
            (u * 3 % 100).cast("int").alias("PlayerLevel"),
        )
    )


def retention_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per (event date, k < 4)."""
    k = F.get_json_object("props", "$.k").cast("int")
    severities = F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")])
    return (
        raw_events(spark, sf_dir)
        .select(F.to_date("ts").alias("day"), k.alias("k"))
        .where("k < 4")
        .distinct()
        .select(
            F.concat(F.lit("dau_"), F.col("day").cast("string"), F.lit("_"), F.col("k").cast("string")).alias(
                "alert_id"
            ),
            F.element_at(severities, F.col("k") + 1).alias("severity"),
            F.lit("dau").alias("metric_name"),
            (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("k"))).alias("timestamp"),
            (F.col("k") % 2 == 0).alias("resolved"),
        )
    )


# Failure reasons, in the order the fixture cycles through them.
FAILURE_REASONS = (
    "data_validation_error",
    "database_connection_error",
    "processing_error",
    "timeout_error",
    "memory_error",
    "unknown_error",
)
_JOB_TYPES = ("load_player_profiles", "load_player_events", "aggregate")
_MESSAGES = ("Validation failed", "Connection refused", "boom")


def failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failure log built from the raw error events."""
    k = F.get_json_object("props", "$.k").cast("int")

    def pick(values, index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)

    retry = F.col("k") % 5
    wait = F.make_dt_interval(mins=F.pow(F.lit(2), retry).cast("int"))
    return (
        raw_events(spark, sf_dir)
        .where("event_type = 'error'")
        .withColumn("k", k)
        .select(
            F.col("event_id").cast("string").alias("job_id"),
            pick(_JOB_TYPES, F.col("k") % 3).alias("job_type"),
            pick(FAILURE_REASONS, F.col("k") % 6).alias("failure_reason"),
            pick(_MESSAGES, F.col("k") % 3).alias("error_message"),
            F.col("props").alias("input_data"),
            F.col("ts").alias("failure_timestamp"),
            retry.alias("retry_count"),
            F.lit(3).alias("max_retries"),
            F.when(retry < 3, F.col("ts") + wait).alias("next_retry_time"),
        )
    )
