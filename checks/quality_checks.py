"""Data-quality suites and failure logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixture_sql import DE, E, FJ, HE, P
from checks.registry import add, rounded
from emberline.operators import jobs, quality
from checks.fixtures import AS_OF

NOW = "TIMESTAMP '2024-01-30 00:00:00'"


def pct(x: str, digits: int = 2) -> str:
    return f"format('{{:.{digits}f}}', ({x} * 100)::DOUBLE) || '%'"


def rule_sql(ordinal, name, value, threshold, severity, message, source, passed=None, details="NULL") -> str:
    return f"""SELECT {ordinal} AS ordinal, '{name}' AS rule_name, {passed or f'{value} <= {threshold}'} AS passed,
      {value} AS value, {threshold}::DOUBLE AS threshold, '{severity}' AS severity, {message} AS message,
      CAST({details} AS VARCHAR) AS details FROM {source}"""


def counted(ordinal, name, count, what, threshold, severity, total="(SELECT count(*) FROM DE)") -> str:
    share = f"n::DOUBLE / {total}"
    return rule_sql(
        ordinal, name, share, threshold, severity, f"'Found ' || n || ' {what} (' || {pct(share)} || ')'",
        f"(SELECT {count} AS n)",
    )


def missing(ordinal, name, column, threshold, severity):
    return counted(ordinal, name, f"(SELECT count(*) FROM DE WHERE {column} IS NULL)", f"missing {column} values", threshold, severity)


Q1 = [
    missing(1, "missing_player_ids", "player_id", 0.01, "error"),
    missing(2, "missing_timestamps", "timestamp", 0.001, "critical"),
    missing(3, "missing_event_types", "event_type", 0.001, "critical"),
]
Q2 = counted(4, "duplicate_events", "(SELECT count(*) FROM DE) - (SELECT count(*) FROM (SELECT DISTINCT * FROM DE))",
             "duplicate events", 0.05, "warning")
Q3 = counted(5, "future_timestamps", f"(SELECT count(*) FROM DE WHERE timestamp > {NOW})", "events with future timestamps", 0.001, "error")
IN_SESSION = "event_type IN ('session_start', 'session_end')"
Q4 = counted(6, "invalid_session_durations",
             f"(SELECT count(*) FROM DE WHERE {IN_SESSION} AND (session_duration < 0 OR session_duration > 86400))",
             "sessions with invalid durations", 0.02, "warning", f"(SELECT count(*) FROM DE WHERE {IN_SESSION})")
Q6 = """SELECT 7 AS ordinal, 'duplicate_player_profiles' AS rule_name, n = 0 AS passed, n::DOUBLE / total AS value, 0.0::DOUBLE AS threshold,
  'error' AS severity, 'Found ' || n || ' duplicate player profiles (' || format('{{:.2f}}', n::DOUBLE / total * 100) || '%)' AS message,
  CAST(NULL AS VARCHAR) AS details
  FROM (SELECT count(*) AS total, count(*) - (SELECT count(*) FROM (SELECT DISTINCT player_id FROM {p})) AS n FROM {p})"""
ORPHANS = """(SELECT (SELECT count(*) FROM DE WHERE NOT EXISTS (SELECT 1 FROM P WHERE P.player_id = DE.player_id)) AS n,
   (SELECT count(*) FROM (SELECT DISTINCT player_id FROM DE) d WHERE NOT EXISTS (SELECT 1 FROM P WHERE P.player_id = d.player_id)) AS m)"""
SHARE = "n::DOUBLE / (SELECT count(*) FROM DE)"
Q7 = rule_sql(8, "orphaned_events", SHARE, 0.05, "warning", f"'Found ' || n || ' orphaned events (' || {pct(SHARE)} || ')'", ORPHANS,
              details="""'{"orphaned_player_count":' || m || '}'""")


def volume_sql(source: str) -> str:
    return rule_sql(
        9, "daily_event_volume_drop", "drop", 0.3, "error",
        f"'Daily volume drop of ' || {pct('drop', 1)} || ' on ' || date",
        f"""(SELECT *, (h - v) / h AS drop FROM (SELECT CAST(timestamp AS DATE) AS date, count(*) AS v,
            (SELECT avg(c) FROM (SELECT count(*) AS c FROM HE GROUP BY CAST(timestamp AS DATE))) AS h FROM {source} GROUP BY 1))
            WHERE drop > 0.3""",
        passed="false",
        details="""'{"date":"' || date || '","volume":' || v || ',"historical_avg":' || round(h, 4) || '}'""",
    )


def spike_sql(source: str) -> str:
    return rule_sql(
        10, "hourly_event_volume_spike", "r", 5.0, "warning",
        "'Hourly volume spike of ' || format('{:.1f}', r) || 'x average detected'",
        f"(SELECT max(c)::DOUBLE / avg(c) AS r FROM (SELECT count(*) AS c FROM {source} GROUP BY hour(timestamp)) HAVING count(*) > 1)",
    )


add("dq_missing", lambda t: quality.missing_values(t.DE, AS_OF), [DE], " UNION ALL ".join(Q1))
add("dq_duplicates", lambda t: quality.duplicates(t.DE, AS_OF), [DE], Q2)
add("dq_future", lambda t: quality.future_timestamps(t.DE, AS_OF), [DE], Q3)
add("dq_session_duration", lambda t: quality.session_durations(t.DE, AS_OF), [DE], Q4)
add(
    "dq_empty",
    lambda t: quality.empty_inputs(t.E.where("event_type = 'achievement_unlock'"), t.P),
    [E, P],
    """SELECT 0 AS ordinal, 'empty_dataset' AS rule_name, false AS passed, 0.0::DOUBLE AS value, 1.0::DOUBLE AS threshold,
      'critical' AS severity, 'Events dataset is empty' AS message, CAST(NULL AS VARCHAR) AS details
    WHERE NOT EXISTS (SELECT 1 FROM E WHERE event_type = 'achievement_unlock')
    UNION ALL SELECT 0, 'empty_profiles', false, 0.0, 1.0, 'error', 'Player profiles dataset is empty', NULL
    WHERE NOT EXISTS (SELECT 1 FROM P)""",
)
TWICE = "P2 AS (SELECT player_id FROM P UNION ALL SELECT player_id FROM P WHERE total_sessions < 20)"
add(
    "dq_duplicate_profiles",
    lambda t: quality.profile_checks(t.P.select("player_id").unionByName(t.P.where("total_sessions < 20").select("player_id"))),
    [P],
    f", {TWICE} {Q6.format(p='P2')}",
)
add("dq_orphans", lambda t: quality.consistency_checks(t.DE, t.P), [DE, P], Q7)
INACTIVE = """(SELECT count(*) AS n, count(DISTINCT player_id) AS m FROM DE JOIN P USING (player_id)
   WHERE floor(epoch(TIMESTAMP '2024-04-10 12:00:00' - last_active_date) / 86400) > 90)"""
add(
    "dq_inactive_player_events",
    lambda t: quality.inactive_player_events(t.DE, t.P, "2024-04-10 12:00:00"),
    [DE, P],
    rule_sql(11, "inactive_player_events", SHARE, 0.1, "info", f"'Found ' || n || ' events from inactive players (' || {pct(SHARE)} || ')'",
             INACTIVE, details="""'{"inactive_player_count":' || m || '}'"""),
)
add("dq_daily_volume_drop", lambda t: quality.daily_volume_drop(t.E, t.HE), [E, HE], volume_sql("E"))
add("dq_hourly_spike", lambda t: quality.hourly_spike(t.E), [E], spike_sql("E"))
SUITE = [*Q1, Q2, Q3, Q4]
add("dq_events_suite", lambda t: quality.event_checks(t.DE, AS_OF), [DE], " UNION ALL ".join(SUITE))
add("dq_volume_suite", lambda t: quality.volume_checks(t.E, t.HE), [E, HE],
    volume_sql("E") + " UNION ALL " + spike_sql("E"))
LOOSE = quality.DEFAULTS.with_threshold("missing_player_ids", 0.2).with_enabled("future_timestamps", False)
add(
    "dq_config",
    lambda t: quality.event_checks(t.DE, AS_OF, LOOSE).join(
        LOOSE.as_frame(t.spark).select("rule_name", "description", "enabled"), "rule_name"
    ),
    [DE],
    ", c AS (" + " UNION ALL ".join(
        [missing(1, "missing_player_ids", "player_id", 0.2, "error"), Q1[1], Q1[2], Q2, Q4]
    ) + """), r(rule_name, description) AS (VALUES ('missing_player_ids', 'Percentage of events with missing player IDs'),
      ('missing_timestamps', 'Percentage of events with missing timestamps'),
      ('missing_event_types', 'Percentage of events with missing event types'),
      ('duplicate_events', 'Percentage of duplicate events'),
      ('invalid_session_durations', 'Percentage of sessions with invalid durations'))
    SELECT c.*, r.description, true AS enabled FROM c JOIN r USING (rule_name)""",
)


def _report(t):
    report = quality.quality_report(quality.all_checks(t.DE, t.P, AS_OF, t.HE))
    texts = F.transform("issues", lambda i: F.concat_ws("|", i["rule_name"], i["severity"], i["message"]))
    return report.withColumn("issues", F.concat_ws("\n", texts)).withColumn(
        "recommendations", F.concat_ws("\n", "recommendations")
    )


SEV = ", ".join(f"count(*) FILTER (NOT passed AND severity = '{s}') AS {s}_failed" for s in quality.SEVERITIES)
ALL = " UNION ALL ".join([*SUITE, Q6.format(p="P"), Q7, volume_sql("DE"), spike_sql("DE")])
add(
    "dq_report",
    _report,
    [DE, P, HE],
    f""", c AS ({ALL})
    SELECT count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS failed_checks,
      {SEV}, string_agg(rule_name || '|' || severity || '|' || message, chr(10) ORDER BY ordinal, message) FILTER (NOT passed) AS issues,
      concat_ws(chr(10), CASE WHEN bool_or(NOT passed AND severity = 'critical') THEN 'CRITICAL: Address data completeness issues immediately' END,
        CASE WHEN bool_or(NOT passed AND severity = 'error') THEN 'ERROR: Review data ingestion pipeline for consistency issues' END,
        string_agg(CASE rule_name WHEN 'orphaned_events' THEN 'Ensure player profile creation precedes event ingestion'
          WHEN 'duplicate_events' THEN 'Implement event deduplication in ingestion pipeline'
          WHEN 'future_timestamps' THEN 'Validate timestamp formats and timezone handling' END, chr(10) ORDER BY ordinal)
          FILTER (NOT passed)) AS recommendations
    FROM c""",
)
add(
    "dq_profile_summary",
    lambda t: quality.profile_summary(t.DE, t.P, AS_OF).withColumn("issues", F.concat_ws("\n", "issues")),
    [DE, P],
    f""", s AS (SELECT count(*) AS total_events, min(timestamp) AS first_event, max(timestamp) AS last_event,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM DE)) AS duplicate_events,
        count(*) FILTER (timestamp > {NOW}) AS future_events, (SELECT count(*) FROM P) AS total_players,
        (SELECT count(*) FROM (SELECT player_id FROM DE EXCEPT SELECT player_id FROM P)) AS players_without_profile,
        (SELECT count(*) FROM (SELECT player_id FROM P EXCEPT SELECT player_id FROM DE)) AS players_without_events FROM DE)
    SELECT *, concat_ws(chr(10),
      CASE WHEN players_without_profile > 0 THEN 'Events found for ' || players_without_profile || ' players without profiles' END,
      CASE WHEN players_without_events > 0 THEN players_without_events || ' players have profiles but no events' END,
      CASE WHEN duplicate_events > 0 THEN duplicate_events || ' duplicate events found' END,
      CASE WHEN future_events > 0 THEN future_events || ' events have future timestamps' END) AS issues FROM s""",
)
add("event_type_counts", lambda t: quality.event_type_counts(t.DE), [DE],
    "SELECT event_type, count(*) AS events FROM DE WHERE event_type IS NOT NULL GROUP BY 1")

# --- failure log ----------------------------------------------------------------------------------

STATS = f"""count(*) AS jobs, count(*) FILTER (retry_count >= max_retries) AS exhausted_retries,
  count(*) FILTER (retry_count < max_retries AND next_retry_time <= TIMESTAMP '2024-01-15 00:00:00') AS ready_for_retry,
  min(failure_timestamp) AS oldest_job, max(failure_timestamp) AS newest_job FROM FJ"""
add(
    "failed_jobs_stats",
    lambda t: jobs.failed_jobs_stats(t.FJ, "2024-01-15 00:00:00"),
    [FJ],
    f"""SELECT 'total' AS dimension, 'all' AS value, {STATS} UNION ALL SELECT 'job_type', job_type, {STATS} GROUP BY job_type
    UNION ALL SELECT 'failure_reason', failure_reason, {STATS} GROUP BY failure_reason""",
)
add(
    "failed_jobs_filter",
    lambda t: jobs.failed_jobs_filter(t.FJ, "load_player_events", "timeout_error").unionByName(
        jobs.failed_jobs_filter(t.FJ, "load_player_events", "database_connection_error")
    ),
    [FJ],
    """SELECT * FROM FJ WHERE job_type = 'load_player_events'
      AND failure_reason IN ('timeout_error', 'database_connection_error') ORDER BY failure_timestamp DESC""",
)
add(
    "classify_failure",
    lambda t: jobs.classify_failures(t.FJ).select("job_id", "error_message", "inferred_reason"),
    [FJ],
    """SELECT job_id, error_message, CASE error_message WHEN 'Validation failed' THEN 'data_validation_error'
      WHEN 'Connection refused' THEN 'database_connection_error' ELSE 'processing_error' END AS inferred_reason FROM FJ""",
)
add(
    "top_errors",
    lambda t: jobs.top_errors(t.FJ.withColumnRenamed("failure_reason", "error_type")),
    [FJ],
    """SELECT failure_reason || ':' || error_message AS error, count(*) AS occurrences FROM FJ GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT 5""",
)
