"""Small building blocks most operators start from.

A single player, day or level may own a large share of all rows. Every operator
therefore shrinks the fact table to one row per (player, day) *before* it is
shuffled for a join: the partial aggregation runs on the map side, so a hot
player leaves each task as at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.times import month_start, week_start


def session_days(sessions: DataFrame) -> DataFrame:
    """One row per (player, calendar day) with the first and last session start.

    First and last start are enough to answer "was there a session in
    [a, a + 24 h]" exactly: the window touches two calendar days, the tail of
    the first (last start >= a) and the head of the second (first start <= a + 24 h).
    """
    return (
        sessions.where(F.col("player_id").isNotNull() & F.col("start_time").isNotNull())
        .groupBy("player_id", F.to_date("start_time").alias("activity_date"))
        .agg(
            F.min("start_time").alias("first_start"),
            F.max("start_time").alias("last_start"),
            F.count(F.lit(1)).alias("sessions"),
        )
    )


def active_days(events: DataFrame) -> DataFrame:
    """Distinct (player, calendar day) pairs with any event."""
    return (
        events.where(F.col("player_id").isNotNull() & F.col("timestamp").isNotNull())
        .select("player_id", F.to_date("timestamp").alias("activity_date"))
        .distinct()
    )


PERIOD_STARTS = {"day": lambda day: day, "week": week_start, "month": month_start}


def active_periods(events: DataFrame, period: str) -> DataFrame:
    """Distinct (player, start of day/week/month) pairs with any event."""
    start = PERIOD_STARTS[period](F.to_date("timestamp"))
    return (
        events.where(F.col("player_id").isNotNull() & F.col("timestamp").isNotNull())
        .select("player_id", start.alias("activity_date"))
        .distinct()
    )


def registrations(profiles: DataFrame, *extra) -> DataFrame:
    """(player, cohort date, extra columns) with null keys dropped."""
    return profiles.where(F.col("player_id").isNotNull() & F.col("registration_date").isNotNull()).select(
        "player_id", F.to_date("registration_date").alias("cohort_date"), *extra
    )
