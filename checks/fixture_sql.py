"""The fixture views as DuckDB SQL; the same definitions as checks.fixtures."""

from __future__ import annotations

_REG = "(TIMESTAMP '2023-12-22 00:00:00' + to_days(CAST({u} % 20 AS INTEGER)) + to_hours(CAST({u} % 24 AS INTEGER)))"
_LAST = f"greatest({_REG}, TIMESTAMP '2024-01-30 00:00:00' - to_days(CAST({{u}} * 11 % 45 AS INTEGER)))"
REG = _REG.format(u="user_id")
LAST = _LAST.format(u="user_id")

_KIND = """CASE event_type WHEN 'view' THEN 'session_start' WHEN 'error' THEN 'session_end'
  WHEN 'click' THEN 'level_complete' WHEN 'signup' THEN 'tutorial_complete'
  WHEN 'purchase' THEN 'purchase' END"""
_MAPPED = f"""'player_' || user_id AS player_id, ts AS timestamp, {_KIND} AS event_type,
  CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 30 + 1 END AS level,
  CASE WHEN event_type = 'purchase' THEN value END AS purchase_amount,
  CASE WHEN event_type IN ('view', 'error') THEN value END AS session_duration"""

P = f"""P AS (
  SELECT 'player_' || user_id AS player_id, {REG} AS registration_date, {LAST} AS last_active_date,
    CAST(user_id * 7 % 120 AS INTEGER) AS total_sessions,
    CAST((user_id * 7 % 120) * (20 + user_id % 5 * 20) AS INTEGER) AS total_playtime_minutes,
    CAST(1 + user_id * 3 % 40 AS INTEGER) AS highest_level_reached,
    CASE WHEN user_id % 4 = 0 THEN 0.0::DOUBLE ELSE (user_id * 13 % 90)::DOUBLE + 0.5 END AS total_purchases,
    (user_id * 37 % 101)::DOUBLE / 100.0 AS churn_risk_score,
    TIMESTAMP '2024-01-30 00:00:00' AS churn_prediction_date
  FROM (SELECT DISTINCT user_id FROM events))"""

#: The log, each player's part moved to end at the last activity.
MOVED = f"(SELECT * REPLACE (ts - (TIMESTAMP '2024-01-31 00:00:00' - {LAST}) AS ts) FROM events)"
E = f"E AS (SELECT {_MAPPED} FROM {MOVED})"

HE = f"HE AS (SELECT {_MAPPED} FROM events)"

S = f"""S AS (
  SELECT CAST(event_id AS VARCHAR) AS session_id, 'player_' || user_id AS player_id, ts AS start_time,
    ts + to_minutes(CAST(floor(value) AS INTEGER)) AS end_time, CAST(floor(value) AS INTEGER) AS duration_minutes,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 30 + 1 AS level_reached
  FROM {MOVED} WHERE event_type IN ('view', 'click'))"""

DE = f"""DE AS (
  SELECT CASE WHEN n % 97 = 0 THEN NULL WHEN n % 53 = 0 THEN 'ghost_' || k ELSE player_id END AS player_id,
    CASE WHEN n % 89 = 0 THEN timestamp + to_days(60) ELSE timestamp END AS timestamp,
    CASE WHEN n % 101 <> 0 THEN event_type END AS event_type, level, purchase_amount,
    CASE WHEN n % 61 = 0 AND session_duration IS NOT NULL THEN -1.0 ELSE session_duration END AS session_duration
  FROM (SELECT {_MAPPED}, event_id AS n, json_extract_string(props, '$.k') AS k
        FROM {MOVED}) b,
       LATERAL (SELECT unnest(range(1, CASE WHEN n % 40 = 0 THEN 3 ELSE 2 END)) AS copy) c)"""

SOC = """SOC AS (SELECT 'player_' || user_id AS player_id, CAST(user_id % 60 AS INTEGER) AS social_connections
  FROM (SELECT DISTINCT user_id FROM events))"""

BR = """BR AS (
  SELECT CAST(user_id AS INTEGER) AS "PlayerID",
    CASE user_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS "EngagementLevel",
    CAST(user_id % 20 AS INTEGER) AS "SessionsPerWeek",
    CAST(user_id % 170 + 10 AS INTEGER) AS "AvgSessionDurationMinutes",
    CAST(user_id % 2 AS INTEGER) AS "InGamePurchases", CAST(user_id * 3 % 100 AS INTEGER) AS "PlayerLevel"
  FROM (SELECT DISTINCT user_id FROM events))"""

AL = """AL AS (
  SELECT 'dau_' || CAST(day AS VARCHAR) || '_' || k AS alert_id,
    ['low', 'medium', 'high', 'critical'][k + 1] AS severity, 'dau' AS metric_name,
    CAST(day AS TIMESTAMP) + to_hours(k) AS timestamp, k % 2 = 0 AS resolved
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  WHERE k < 4)"""

FJ = """FJ AS (
  SELECT CAST(event_id AS VARCHAR) AS job_id,
    ['load_player_profiles', 'load_player_events', 'aggregate'][k % 3 + 1] AS job_type,
    ['data_validation_error', 'database_connection_error', 'processing_error', 'timeout_error',
     'memory_error', 'unknown_error'][k % 6 + 1] AS failure_reason,
    ['Validation failed', 'Connection refused', 'boom'][k % 3 + 1] AS error_message,
    props AS input_data, ts AS failure_timestamp, k % 5 AS retry_count, 3 AS max_retries,
    CASE WHEN k % 5 < 3 THEN ts + to_minutes(CAST(power(2, k % 5) AS INTEGER)) END AS next_retry_time
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'))"""


def with_views(views: list[str], body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body.strip()
