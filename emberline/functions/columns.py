"""Derived columns. Every function returns a native Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.times import When, elapsed_days, ts_lit

# Category names and their lower bounds.
HIGH_ENGAGEMENT = "High Engagement"
MEDIUM_ENGAGEMENT = "Medium Engagement"
LOW_ENGAGEMENT = "Low Engagement"
MINIMAL_ENGAGEMENT = "Minimal Engagement"
BEHAVIOR_SEGMENTS = (HIGH_ENGAGEMENT, MEDIUM_ENGAGEMENT, LOW_ENGAGEMENT, MINIMAL_ENGAGEMENT)

# Allowed player segments and the spellings mapped onto them.
PLAYER_SEGMENTS = ("new", "casual", "core", "premium", "churned", "returning")
SEGMENT_ALIASES = {
    "beginner": "new",
    "starter": "new",
    "regular": "casual",
    "active": "core",
    "engaged": "core",
    "vip": "premium",
    "whale": "premium",
    "inactive": "churned",
    "lapsed": "churned",
}

# Event types.
SESSION_TYPES = ("session_start", "session_end")
EVENT_TYPES = (
    "session_start",
    "session_end",
    "level_complete",
    "purchase",
    "achievement_unlock",
    "tutorial_complete",
)


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def unit_clip(value: Column) -> Column:
    """Clamp into [0, 1]; null stays null."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(value.isNotNull(), clipped)


def behavior_segment(sessions="total_sessions", playtime="total_playtime_minutes") -> Column:
    s, p = _c(sessions), _c(playtime)
    return (
        F.when((s >= 20) & (p >= 1200), HIGH_ENGAGEMENT)
        .when((s >= 10) & (p >= 600), MEDIUM_ENGAGEMENT)
        .when((s >= 3) & (p >= 180), LOW_ENGAGEMENT)
        .otherwise(MINIMAL_ENGAGEMENT)
    )


def behavior_rank(segment: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in BEHAVIOR_SEGMENTS]), segment)


def spend_segment(purchases="total_purchases", segment_field: str = "total_purchases") -> Column:
    """Spend tier; any other segmentation field puts everyone in ``all``."""
    if segment_field != "total_purchases":
        return F.lit("all")
    p = _c(purchases)
    return (
        F.when(p == 0, "non_paying")
        .when(p < 10, "low_spender")
        .when(p < 50, "medium_spender")
        .otherwise("high_spender")
    )


def engagement_level(sessions="total_sessions", purchases="total_purchases") -> Column:
    s, p = _c(sessions), _c(purchases)
    return (
        F.when((s >= 100) & (p > 50), "premium")
        .when(s >= 50, "core")
        .when(s >= 10, "casual")
        .otherwise("new")
    )


def risk_category(score="churn_risk_score") -> Column:
    r = _c(score)
    return F.when(r >= 0.7, "high").when(r >= 0.3, "medium").otherwise("low")


def player_ltv(purchases="total_purchases", score="churn_risk_score") -> Column:
    p = _c(purchases)
    return F.when(p <= 0, F.lit(0.0)).otherwise(p / F.greatest(F.lit(0.1), _c(score)))


def days_since_registration(as_of: When, registered="registration_date") -> Column:
    return elapsed_days(_c(registered), ts_lit(as_of))


def is_active(as_of: When, last_active="last_active_date", threshold: int = 7) -> Column:
    return elapsed_days(_c(last_active), ts_lit(as_of)) <= threshold


def high_churn_points(
    idle_days="days_since_last_session",
    sessions="sessions_last_7_days",
    duration="avg_session_duration_minutes",
    levels="levels_completed_last_week",
    purchases="purchases_last_30_days",
) -> Column:
    def points(condition: Column, weight: int) -> Column:
        return F.when(condition, weight).otherwise(0)

    return (
        points(_c(idle_days) > 3, 1)
        + points(_c(sessions) == 0, 2)
        + points(_c(duration) < 5, 1)
        + points(_c(levels) == 0, 1)
        + points(_c(purchases) == 0, 1)
    )


def high_churn_flag(**columns) -> Column:
    return high_churn_points(**columns) >= 3


def engagement_score(
    idle_days="days_since_last_session",
    sessions="sessions_last_7_days",
    duration="avg_session_duration_minutes",
    levels="levels_completed_last_week",
) -> Column:
    def capped(value: Column, top: float) -> Column:
        return F.least(value / F.lit(top), F.lit(1.0))

    base = (
        capped(_c(sessions), 7.0) * 0.4 + capped(_c(duration), 30.0) * 0.3 + capped(_c(levels), 10.0) * 0.3
    )
    freshness = F.when(_c(idle_days) > 0, F.lit(1.0) - capped(_c(idle_days), 7.0)).otherwise(F.lit(1.0))
    return unit_clip(base * freshness)


def churn_risk_score(
    days_inactive: str | Column,
    sessions_per_week: str | Column,
    purchases: str | Column,
    engagement: str | Column,
    level: str | Column,
) -> Column:
    """Weighted churn risk in [0, 1] from inactivity, frequency, spend, engagement and level."""

    def shortfall(value: Column, target: float) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - value / F.lit(target))

    inactivity = F.least(_c(days_inactive) / F.lit(30.0), F.lit(1.0))
    spend = F.when(_c(purchases) == 0, F.lit(1.0)).otherwise(shortfall(_c(purchases), 100.0))
    engaged = (
        F.when(_c(engagement) == "High", 0.1)
        .when(_c(engagement) == "Medium", 0.4)
        .when(_c(engagement) == "Low", 0.8)
        .otherwise(0.5)
    )
    total = (
        inactivity * 0.3
        + shortfall(_c(sessions_per_week), 15.0) * 0.2
        + spend * 0.2
        + engaged * 0.2
        + shortfall(_c(level), 100.0) * 0.1
    )
    return F.least(total, F.lit(1.0))


def normalize_segment(segment: str | Column) -> Column:
    """Canonical segment name; null for text that is neither a segment nor an alias."""
    cleaned = F.lower(F.trim(_c(segment)))
    pairs = [*((s, s) for s in PLAYER_SEGMENTS), *SEGMENT_ALIASES.items()]
    lookup = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
    return F.try_element_at(lookup, cleaned)


def level_group(level: str | Column) -> Column:
    v = _c(level)
    return (
        F.when(v <= 5, "Tutorial").when(v <= 10, "Beginner").when(v <= 15, "Intermediate").otherwise("Advanced")
    )


def retention_at_day(day: int | Column) -> Column:
    """The retention column of day 1, 7 or 30; null for any other day."""
    d = F.lit(day) if isinstance(day, int) else day
    return (
        F.when(d == 1, F.col("day_1_retention"))
        .when(d == 7, F.col("day_7_retention"))
        .when(d == 30, F.col("day_30_retention"))
    )


def engagement_product(duration="avg_session_duration", per_user="sessions_per_user") -> Column:
    return _c(duration) * _c(per_user)


def failure_class(message: str | Column) -> Column:
    """Failure reason guessed from an error message."""
    text = F.lower(_c(message))
    return (
        F.when(text.contains("validation"), "data_validation_error")
        .when(text.contains("connection") | text.contains("database"), "database_connection_error")
        .otherwise("processing_error")
    )


def model_scores() -> dict[str, Column]:
    """The five engineered model features, by name."""
    duration = unit_clip(F.col("avg_session_duration_minutes") / 120)
    levels = unit_clip(F.col("levels_completed_last_week") / 50)
    return {
        "session_frequency_score": unit_clip(F.col("sessions_last_7_days") / 21),
        "engagement_score": duration * 0.6 + levels * 0.4,
        "monetary_score": unit_clip(F.log1p(F.col("purchases_last_30_days")) / 10),
        "social_score": unit_clip(F.col("social_connections") / 100),
        "recency_score": F.exp(-F.col("days_since_last_session") / 7),
    }
