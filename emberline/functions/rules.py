"""Record rules: each bad record collects the codes of the rules it breaks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import EVENT_TYPES, SESSION_TYPES

ID_PATTERN = r"^[a-zA-Z0-9_-]+$"
MAX_ID_LENGTH = 100

# Inclusive ranges of the churn features.
FEATURE_RANGES = {
    "days_since_last_session": (0, 365),
    "sessions_last_7_days": (0, 1000),
    "avg_session_duration_minutes": (0, 1440),
    "levels_completed_last_week": (0, 1000),
    "purchases_last_30_days": (0, 10000),
    "social_connections": (0, 10000),
}


def _true(condition: Column) -> Column:
    """A rule that cannot be decided because of a null is not broken."""
    return F.coalesce(condition, F.lit(False))


def _blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


def with_reasons(df: DataFrame, rules: Mapping[str, Column], name: str = "reasons") -> DataFrame:
    """Add an array with the code of every broken rule (empty when clean)."""
    hits = F.array(*[F.when(_true(bad), F.lit(code)) for code, bad in rules.items()])
    return df.withColumn(name, F.array_compact(hits))


def split(checked: DataFrame, name: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(clean rows without the reason column, rows to quarantine with it)."""
    clean = F.size(name) == 0
    return checked.where(clean).drop(name), checked.where(~clean)


def event_rules() -> dict[str, Column]:
    kind, amount, level, length = (
        F.col("event_type"),
        F.col("purchase_amount"),
        F.col("level"),
        F.col("session_duration"),
    )
    return {
        "missing_player_id": F.col("player_id").isNull(),
        "blank_player_id": F.trim("player_id") == "",
        "missing_event_type": kind.isNull(),
        "unknown_event_type": ~kind.isin(*EVENT_TYPES),
        "missing_timestamp": F.col("timestamp").isNull(),
        "purchase_without_amount": (kind == "purchase") & amount.isNull(),
        "negative_amount": (kind == "purchase") & (amount < 0),
        "level_missing": (kind == "level_complete") & level.isNull(),
        "level_below_one": (kind == "level_complete") & (level < 1),
        "negative_duration": kind.isin(*SESSION_TYPES) & (length < 0),
    }


def profile_rules() -> dict[str, Column]:
    risk = F.col("churn_risk_score")
    return {
        "missing_field": F.col("player_id").isNull()
        | F.col("registration_date").isNull()
        | F.col("last_active_date").isNull()
        | F.col("total_sessions").isNull()
        | F.col("total_playtime_minutes").isNull()
        | F.col("highest_level_reached").isNull()
        | F.col("total_purchases").isNull()
        | F.col("churn_prediction_date").isNull()
        | risk.isNull(),
        "risk_out_of_range": (risk < 0) | (risk > 1),
        "negative_sessions": F.col("total_sessions") < 0,
        "negative_playtime": F.col("total_playtime_minutes") < 0,
        "registered_after_last_active": F.col("registration_date") > F.col("last_active_date"),
    }


def player_id_rules(column: str = "player_id") -> dict[str, Column]:
    pid = F.col(column)
    return {
        "missing_player_id": _blank(pid),
        "player_id_too_long": F.length(pid) > MAX_ID_LENGTH,
        "player_id_bad_characters": (F.trim(pid) != "") & ~pid.rlike(ID_PATTERN),
    }


def churn_feature_rules() -> dict[str, Column]:
    pid = F.col("player_id")
    rules = {"bad_player_id": pid.isNull() | ~pid.rlike(ID_PATTERN)}
    for name in FEATURE_RANGES:
        rules[f"negative_{name}"] = F.col(name).isNull() | (F.col(name) < 0)
    rules["sessions_after_last_session"] = (F.col("sessions_last_7_days") > 0) & (
        F.col("days_since_last_session") > 7
    )
    rules["missing_feature_date"] = F.col("feature_date").isNull()
    return rules


def feature_range_rules() -> dict[str, Column]:
    rules = {}
    for name, (low, high) in FEATURE_RANGES.items():
        rules[f"{name}_out_of_range"] = F.col(name).isNull() | ~F.col(name).between(low, high)
    return rules | player_id_rules()


def retention_rules() -> dict[str, Column]:
    d1, d7, d30 = (F.col(f"day_{n}_retention") for n in (1, 7, 30))
    segment = F.col("segment")
    rules = {"missing_cohort_date": F.col("cohort_date").isNull()}
    for n, rate in ((1, d1), (7, d7), (30, d30)):
        rules[f"day_{n}_out_of_range"] = rate.isNull() | ~rate.between(0, 1)
    return rules | {
        "day_7_above_day_1": d7 > d1,
        "day_30_above_day_7": d30 > d7,
        "cohort_size_not_positive": F.col("cohort_size").isNull() | (F.col("cohort_size") <= 0),
        "bad_segment": segment.isNull() | ~segment.rlike(ID_PATTERN),
    }


def cohort_record_rules() -> dict[str, Column]:
    rate = F.col("retention_rate")
    return {
        "missing_cohort_date": F.col("cohort_date").isNull(),
        "rate_out_of_range": rate.isNull() | ~rate.between(0, 1),
        "cohort_size_negative": F.col("cohort_size").isNull() | (F.col("cohort_size") < 0),
        "period_negative": F.col("period").isNull() | (F.col("period") < 0),
    }
