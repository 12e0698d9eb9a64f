"""Activity counts, level drop-off, behaviour segments and daily summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions.columns import SESSION_TYPES, behavior_rank, behavior_segment, engagement_product
from emberline.functions.times import When, as_date, plus_days, ts_lit
from emberline.operators.retention import retained_players


def between_midnights(column: str, start: When, end: When):
    """Closed range between the midnights of two dates: the end day itself is cut."""
    return F.col(column).between(ts_lit(as_date(start)), ts_lit(as_date(end)))


def on_dates(column: str, start: When, end: When):
    """Whole days from start to end, written as a range the scan can push down."""
    instant = F.col(column)
    return (instant >= ts_lit(as_date(start))) & (instant < plus_days(ts_lit(as_date(end)), 1))


def level_dropoff(
    profiles: DataFrame, sessions: DataFrame, start: When, end: When, max_level: int = 50
) -> DataFrame:
    """Players who reached each level in the window, and how many ever got past it.

    Sessions collapse to (player, level) first, with every level above
    ``max_level`` folded into one, so the per-player window sees at most
    ``max_level + 1`` rows for a player however many sessions it has.
    """
    seen = (
        sessions.where(F.col("level_reached").isNotNull())
        .groupBy("player_id", F.least("level_reached", F.lit(max_level + 1)).alias("level"))
        .agg(F.max(between_midnights("start_time", start, end)).alias("in_window"))
    )
    highest = F.max("level").over(Window.partitionBy("player_id"))
    reached = (
        seen.withColumn("highest", highest)
        .where(F.col("in_window") & (F.col("level") <= max_level))
        .join(profiles.select("player_id"), "player_id", "left_semi")
    )
    players, completed = F.col("players_reached"), F.col("players_completed")
    return (
        reached.groupBy("level")
        .agg(
            F.count(F.lit(1)).alias("players_reached"),
            F.count_if(F.col("highest") > F.col("level")).alias("players_completed"),
        )
        .withColumn("drop_off_rate", (players - completed) / players)
        .withColumn("completion_rate", completed / players)
        .orderBy("level")
    )


def behavior_segments(profiles: DataFrame, sessions: DataFrame, start: When, end: When) -> DataFrame:
    """Size, averages and day-7 return share per behaviour segment, best first."""
    members = profiles.where(between_midnights("registration_date", start, end)).select(
        "player_id",
        "registration_date",
        "total_sessions",
        "total_playtime_minutes",
        behavior_segment().alias("segment"),
    )
    reachable = sessions.where(
        F.col("start_time").between(plus_days(ts_lit(as_date(start)), 7), plus_days(ts_lit(as_date(end)), 8))
    )
    keys = ["segment", "total_sessions", "total_playtime_minutes"]
    return (
        retained_players(members, reachable, keys, days=(7,), closed=False)
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("player_count"),
            F.avg("total_sessions").alias("avg_sessions"),
            F.avg("total_playtime_minutes").alias("avg_playtime"),
            F.avg("day_7").alias("avg_retention_day_7"),
        )
        .orderBy(behavior_rank(F.col("segment")))
    )


def dau(sessions: DataFrame, start: When, end: When) -> DataFrame:
    """Distinct players per day, end day included."""
    return (
        sessions.where(on_dates("start_time", start, end))
        .groupBy(F.to_date("start_time").alias("activity_date"))
        .agg(F.count_distinct("player_id").alias("dau_count"))
        .orderBy("activity_date")
    )


def wau(sessions: DataFrame, start: When, end: When, inclusive_end: bool = False) -> DataFrame:
    """Distinct players per Monday week; by default the range ends at the end date's midnight."""
    window = on_dates if inclusive_end else between_midnights
    return (
        sessions.where(window("start_time", start, end))
        .groupBy(F.trunc("start_time", "week").alias("week_start"))
        .agg(F.count_distinct("player_id").alias("wau_count"))
        .orderBy("week_start")
    )


def enrich_events(events: DataFrame) -> DataFrame:
    """Add date, hour and day_of_week (Monday = 0)."""
    instant = F.col("timestamp").cast("timestamp_ntz")
    return events.withColumns(
        {
            "timestamp": instant,
            "date": F.to_date(instant),
            "hour": F.hour(instant),
            "day_of_week": F.weekday(instant),
        }
    )


def session_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*SESSION_TYPES)).orderBy("player_id", "timestamp")


def purchase_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase")


def level_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "level_complete")


def engagement_timeline(events: DataFrame) -> DataFrame:
    """Daily actives and session intensity, with the rule-of-thumb WAU and MAU estimates."""
    starts = F.col("event_type") == "session_start"
    if "session_duration" in events.columns:
        duration = F.avg(F.when(starts, F.col("session_duration")))
    else:
        duration = F.lit(15.0)
    players = F.col("dau")
    return (
        events.where(F.col("timestamp").isNotNull())
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(
            F.count_distinct("player_id").alias("dau"),
            duration.alias("avg_session_duration"),
            F.count_if(starts).alias("starts"),
        )
        .select(
            "date",
            "dau",
            (players * 4.5).alias("wau_est"),
            (players * 15).alias("mau_est"),
            "avg_session_duration",
            F.when(players > 0, F.col("starts") / players).otherwise(F.lit(0.0)).alias("sessions_per_user"),
        )
        .orderBy("date")
    )


def engagement_products(timeline: DataFrame) -> DataFrame:
    """Engagement score of each day: session length times sessions per player."""
    return timeline.select("date", engagement_product().alias("engagement_score"))


def _player_dates(events: DataFrame) -> DataFrame:
    keyed = events.where(F.col("player_id").isNotNull() & F.col("timestamp").isNotNull())
    return keyed.withColumn("date", F.to_date("timestamp"))


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def daily_session_metrics(events: DataFrame) -> DataFrame:
    """Session count, mean and total duration per (player, date), from session starts."""
    starts = _player_dates(events).where(F.col("event_type") == "session_start")
    return starts.groupBy("player_id", "date").agg(
        F.count("timestamp").alias("session_count"),
        F.avg("session_duration").alias("avg_session_duration"),
        _total("session_duration").alias("total_session_duration"),
    )


def daily_purchase_metrics(events: DataFrame) -> DataFrame:
    return (
        purchase_events(_player_dates(events))
        .groupBy("player_id", "date")
        .agg(F.count("purchase_amount").alias("purchase_count"), _total("purchase_amount").alias("total_revenue"))
    )


def daily_progression_metrics(events: DataFrame) -> DataFrame:
    return (
        level_events(_player_dates(events))
        .groupBy("player_id", "date")
        .agg(F.count("level").alias("levels_completed"), F.max("level").alias("max_level"))
    )


def daily_player_summary(events: DataFrame) -> DataFrame:
    """All daily metrics of each (player, date) in one aggregation; absent values are 0.0."""

    def of(kind: str, column: str):
        return F.when(F.col("event_type") == kind, F.col(column))

    start, spent, level = "session_start", "purchase", "level_complete"
    metrics = {
        "session_count": F.count(of(start, "timestamp")),
        "avg_session_duration": F.avg(of(start, "session_duration")),
        "total_session_duration": F.sum(of(start, "session_duration")),
        "purchase_count": F.count(of(spent, "purchase_amount")),
        "total_revenue": F.sum(of(spent, "purchase_amount")),
        "levels_completed": F.count(of(level, "level")),
        "max_level": F.max(of(level, "level")),
    }
    return (
        _player_dates(events)
        .groupBy("player_id", "date")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            *[F.coalesce(m.cast("double"), F.lit(0.0)).alias(name) for name, m in metrics.items()],
        )
    )
