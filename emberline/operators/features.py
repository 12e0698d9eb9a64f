"""Churn model features per player."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import model_scores
from emberline.functions.times import When, date_lit, elapsed_days, plus_days, ts_lit

#: Raw features in model order; the engineered scores follow them.
RAW_FEATURES = (
    "days_since_last_session",
    "sessions_last_7_days",
    "avg_session_duration_minutes",
    "levels_completed_last_week",
    "purchases_last_30_days",
    "social_connections",
)


def derive_churn_features(
    profiles: DataFrame,
    sessions: DataFrame,
    events: DataFrame,
    as_of: When,
    social: DataFrame | None = None,
) -> DataFrame:
    """Recency, frequency, length, progress and spend of every player at ``as_of``.

    Sessions and the two relevant event types are stacked into one narrow table
    and reduced per player in a single aggregation before meeting the profiles.
    A player without sessions is as idle as the profile's last activity says.
    """
    now = ts_lit(as_of)
    week_ago, month_ago = plus_days(now, -7), plus_days(now, -30)
    blank = {"duration": "double", "spent": "double"}
    facts = (
        sessions.where(F.col("start_time") <= now)
        .select(
            "player_id",
            F.col("start_time").alias("at"),
            F.lit("session").alias("kind"),
            F.col("duration_minutes").cast("double").alias("duration"),
            F.lit(None).cast(blank["spent"]).alias("spent"),
        )
        .unionByName(
            events.where(
                F.col("event_type").isin("level_complete", "purchase")
                & (F.col("timestamp") > month_ago)
                & (F.col("timestamp") <= now)
            ).select(
                "player_id",
                F.col("timestamp").alias("at"),
                F.col("event_type").alias("kind"),
                F.lit(None).cast(blank["duration"]).alias("duration"),
                F.col("purchase_amount").cast("double").alias("spent"),
            )
        )
    )
    recent = F.col("at") > week_ago
    per_player = facts.groupBy("player_id").agg(
        F.max(F.when(F.col("kind") == "session", F.col("at"))).alias("last_session"),
        F.count_if((F.col("kind") == "session") & recent).alias("sessions_last_7_days"),
        F.avg("duration").alias("avg_session_duration_minutes"),
        F.count_if((F.col("kind") == "level_complete") & recent).alias("levels_completed_last_week"),
        F.sum(F.when(F.col("kind") == "purchase", F.col("spent"))).alias("purchases_last_30_days"),
    )
    players = profiles.select("player_id", "last_active_date")
    if social is None:
        joined = players.withColumn("social_connections", F.lit(0))
    else:
        joined = players.join(social, "player_id", "left")
    idle = elapsed_days(F.coalesce("last_session", "last_active_date"), now)
    zero = F.lit(0)
    return joined.join(per_player, "player_id", "left").select(
        "player_id",
        date_lit(as_of).alias("feature_date"),
        F.greatest(zero, idle).alias("days_since_last_session"),
        F.coalesce("sessions_last_7_days", zero).cast("int").alias("sessions_last_7_days"),
        F.coalesce("avg_session_duration_minutes", F.lit(0.0)).alias("avg_session_duration_minutes"),
        F.coalesce("levels_completed_last_week", zero).cast("int").alias("levels_completed_last_week"),
        F.coalesce("purchases_last_30_days", F.lit(0.0)).alias("purchases_last_30_days"),
        F.coalesce("social_connections", zero).cast("int").alias("social_connections"),
    )


def engineer_features(churn_features: DataFrame) -> DataFrame:
    """Raw features plus the five engineered scores."""
    return churn_features.withColumns(model_scores())
