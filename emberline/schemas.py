"""Declared schemas of the tables the operators read and write.

Instants are zone-less (``timestamp_ntz``): the source systems store naive
timestamps, and a zone-aware type would shift days with the session zone.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TS, _DATE, _B = T.TimestampNTZType(), T.DateType(), T.BooleanType()

PROFILES = _struct(
    ("player_id", _S),
    ("registration_date", _TS),
    ("last_active_date", _TS),
    ("total_sessions", _I),
    ("total_playtime_minutes", _I),
    ("highest_level_reached", _I),
    ("total_purchases", _D),
    ("churn_risk_score", _D),
    ("churn_prediction_date", _TS),
)

#: Optional profile attributes found in richer profile files.
PROFILE_EXTRAS = _struct(
    ("age", _I),
    ("gender", _S),
    ("location", _S),
    ("device_type", _S),
    ("avg_session_duration", _D),
    ("sessions_last_7_days", _I),
    ("sessions_last_30_days", _I),
    ("days_since_last_session", _I),
    ("first_purchase_date", _TS),
    ("last_purchase_date", _TS),
    ("purchase_frequency", _D),
    ("avg_purchase_amount", _D),
)

EVENTS = _struct(
    ("player_id", _S),
    ("timestamp", _TS),
    ("event_type", _S),
    ("level", _I),
    ("purchase_amount", _D),
    ("session_duration", _D),
)

SESSIONS = _struct(
    ("session_id", _S),
    ("player_id", _S),
    ("start_time", _TS),
    ("end_time", _TS),
    ("duration_minutes", _I),
    ("level_reached", _I),
    ("events_count", _I),
    ("purchases_made", T.DecimalType(10, 2)),
)

CHURN_FEATURES = _struct(
    ("player_id", _S),
    ("feature_date", _DATE),
    ("days_since_last_session", _I),
    ("sessions_last_7_days", _I),
    ("avg_session_duration_minutes", _D),
    ("levels_completed_last_week", _I),
    ("purchases_last_30_days", _D),
    ("social_connections", _I),
)

RETENTION_METRICS = _struct(
    ("cohort_date", _DATE),
    ("day_1_retention", _D),
    ("day_7_retention", _D),
    ("day_30_retention", _D),
    ("cohort_size", _L),
    ("segment", _S),
)

METRIC_HISTORY = _struct(
    ("metric_date", _DATE),
    ("metric_name", _S),
    ("metric_value", T.DecimalType(10, 4)),
    ("created_at", _TS),
    ("updated_at", _TS),
)

ALERTS = _struct(
    ("alert_id", _S),
    ("severity", _S),
    ("metric_name", _S),
    ("current_value", T.DecimalType(10, 4)),
    ("expected_value", T.DecimalType(10, 4)),
    ("deviation_percentage", T.DecimalType(8, 2)),
    ("message", _S),
    ("timestamp", _TS),
    ("resolved", _B),
    ("resolved_at", _TS),
    ("resolved_by", _S),
    ("created_at", _TS),
    ("updated_at", _TS),
    ("metric_date", _DATE),
)

REPORTS = _struct(
    ("report_date", _DATE),
    ("report_data", _S),
    ("generated_at", _TS),
    ("created_at", _TS),
    ("updated_at", _TS),
)

FAILED_JOBS = _struct(
    ("job_id", _S),
    ("job_type", _S),
    ("failure_reason", _S),
    ("error_message", _S),
    ("input_data", _S),
    ("failure_timestamp", _TS),
    ("retry_count", _I),
    ("max_retries", _I),
    ("next_retry_time", _TS),
)

BEHAVIOR_CSV = _struct(
    ("PlayerID", _I),
    ("EngagementLevel", _S),
    ("SessionsPerWeek", _I),
    ("AvgSessionDurationMinutes", _I),
    ("InGamePurchases", _I),
    ("PlayerLevel", _I),
)

TABLES = {
    "player_profiles": PROFILES,
    "player_events": EVENTS,
    "player_sessions": SESSIONS,
    "churn_features": CHURN_FEATURES,
    "retention_metrics": RETENTION_METRICS,
    "daily_metrics_history": METRIC_HISTORY,
    "retention_alerts": ALERTS,
    "daily_reports": REPORTS,
    "failed_jobs": FAILED_JOBS,
}
