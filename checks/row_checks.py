"""Derived columns and record rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixture_sql import BR, DE, E, P
from checks.feature_sql import CF, churn_feature_table
from checks.registry import add, r6, rounded
from checks.retention_checks import LEVEL_CASE, RISK_CASE, SEGMENT_CASE, SPEND_CASE
from emberline.functions import columns as col
from emberline.functions import rules
from emberline.operators import activity, cohorts, features, retention
from checks.fixtures import AS_OF

# --- event columns --------------------------------------------------------------------------------

add(
    "events_enriched",
    lambda t: activity.enrich_events(t.E),
    [E],
    """SELECT *, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour,
      CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week FROM E""",
)
add(
    "session_events",
    lambda t: activity.session_events(t.E),
    [E],
    "SELECT * FROM E WHERE event_type IN ('session_start', 'session_end') ORDER BY player_id, timestamp",
)
add("purchase_events", lambda t: activity.purchase_events(t.E), [E], "SELECT * FROM E WHERE event_type = 'purchase'")
add("level_events", lambda t: activity.level_events(t.E), [E], "SELECT * FROM E WHERE event_type = 'level_complete'")

# --- profile columns ------------------------------------------------------------------------------

add(
    "behavior_segment",
    lambda t: t.P.select("player_id", col.behavior_segment().alias("segment")),
    [P],
    f"SELECT player_id, {SEGMENT_CASE} AS segment FROM P",
)
add(
    "spend_segment",
    lambda t: t.P.select("player_id", col.spend_segment().alias("segment")),
    [P],
    f"SELECT player_id, {SPEND_CASE} AS segment FROM P",
)
add(
    "engagement_level",
    lambda t: t.P.select("player_id", col.engagement_level().alias("level")),
    [P],
    f"SELECT player_id, {LEVEL_CASE} AS level FROM P",
)
add(
    "risk_category",
    lambda t: t.P.select("player_id", col.risk_category().alias("category")),
    [P],
    f"SELECT player_id, {RISK_CASE} AS category FROM P",
)
add(
    "player_ltv",
    lambda t: t.P.select("player_id", r6(col.player_ltv()).alias("ltv")),
    [P],
    """SELECT player_id, round(1e-9 + CASE WHEN total_purchases <= 0 THEN 0.0
      ELSE total_purchases / greatest(0.1::DOUBLE, churn_risk_score) END, 6) AS ltv FROM P""",
)
ELAPSED = "floor(epoch(TIMESTAMP '2024-01-30 00:00:00' - {c}) / 86400.0)::INTEGER"
add(
    "days_since_registration",
    lambda t: t.P.select("player_id", col.days_since_registration(AS_OF).alias("days")),
    [P],
    f"SELECT player_id, {ELAPSED.format(c='registration_date')} AS days FROM P",
)
add(
    "is_active",
    lambda t: t.P.select("player_id", col.is_active(AS_OF).alias("active")),
    [P],
    f"SELECT player_id, {ELAPSED.format(c='last_active_date')} <= 7 AS active FROM P",
)
add(
    "normalize_segment",
    lambda t: t.P.select(
        "player_id",
        col.normalize_segment(
            F.element_at(
                F.array(*[F.lit(s) for s in (" VIP ", "Whale", "core", "lapsed", "Regular", "nobody")]),
                (F.col("highest_level_reached") % 6 + 1),
            )
        ).alias("segment"),
    ),
    [P],
    """SELECT player_id, ['premium', 'premium', 'core', 'churned', 'casual', NULL][highest_level_reached % 6 + 1] AS segment
    FROM P""",
)
add(
    "churn_risk_score",
    lambda t: t.BR.select(
        "PlayerID",
        r6(
            col.churn_risk_score(
                F.col("PlayerID") * 11 % 45,
                "SessionsPerWeek",
                F.when(F.col("InGamePurchases") == 1, F.col("PlayerID") * 13 % 150 + 0.5).otherwise(F.lit(0.0)),
                "EngagementLevel",
                "PlayerLevel",
            ),
        ).alias("risk"),
    ),
    [BR],
    """, b AS (SELECT *, CASE WHEN "InGamePurchases" = 1 THEN "PlayerID" * 13 % 150 + 0.5 ELSE 0.0 END::DOUBLE AS spent FROM BR)
    SELECT "PlayerID", round(1e-9 + least(1.0::DOUBLE,
        least(("PlayerID" * 11 % 45) / 30.0::DOUBLE, 1.0) * 0.3 + greatest(0.0, 1 - "SessionsPerWeek" / 15.0::DOUBLE) * 0.2
      + CASE WHEN spent = 0 THEN 1.0 ELSE greatest(0.0, 1 - spent / 100.0) END * 0.2
      + CASE "EngagementLevel" WHEN 'High' THEN 0.1 WHEN 'Medium' THEN 0.4 WHEN 'Low' THEN 0.8 ELSE 0.5 END * 0.2
      + greatest(0.0, 1 - "PlayerLevel" / 100.0::DOUBLE) * 0.1), 6) AS risk FROM b""",
)
add(
    "retention_at_day",
    lambda t: retention.daily_retention(t.E, t.P).select(
        "cohort_date",
        *[col.retention_at_day(n).alias(f"at_{n}") for n in (7, 30)],
        F.coalesce(col.retention_at_day(5), F.lit(-1.0)).alias("at_5"),
    ),
    [P, E],
    """, c AS (SELECT player_id, CAST(registration_date AS DATE) AS d0 FROM P),
    a AS (SELECT DISTINCT player_id, CAST(timestamp AS DATE) AS d FROM E)
    SELECT d0 AS cohort_date, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.player_id = c.player_id AND d = d0 + 7))::DOUBLE
      / count(*) AS at_7,
      count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.player_id = c.player_id AND d = d0 + 30))::DOUBLE / count(*) AS at_30,
      -1.0::DOUBLE AS at_5 FROM c GROUP BY d0""",
)

# --- churn feature columns ------------------------------------------------------------------------

add("derive_churn_features", lambda t: rounded(churn_feature_table(t), "avg_session_duration_minutes", "purchases_last_30_days"),
    CF, """SELECT * REPLACE (round(1e-9 + avg_session_duration_minutes, 6) AS avg_session_duration_minutes,
      round(1e-9 + purchases_last_30_days, 6) AS purchases_last_30_days) FROM CF""")
add(
    "high_churn_flag",
    lambda t: churn_feature_table(t).select("player_id", col.high_churn_flag().alias("flag")),
    CF,
    """SELECT player_id, (days_since_last_session > 3)::INT + 2 * (sessions_last_7_days = 0)::INT
      + (avg_session_duration_minutes < 5)::INT + (levels_completed_last_week = 0)::INT
      + (purchases_last_30_days = 0)::INT >= 3 AS flag FROM CF""",
)
add(
    "engagement_score",
    lambda t: churn_feature_table(t).select("player_id", r6(col.engagement_score()).alias("score")),
    CF,
    """, b AS (SELECT *, least(sessions_last_7_days / 7.0::DOUBLE, 1.0) * 0.4 + least(avg_session_duration_minutes / 30, 1.0) * 0.3
        + least(levels_completed_last_week / 10.0::DOUBLE, 1.0) * 0.3 AS s FROM CF)
    SELECT player_id, round(1e-9 + greatest(0.0, least(1.0, CASE WHEN days_since_last_session > 0
      THEN s * (1 - least(days_since_last_session / 7.0::DOUBLE, 1.0)) ELSE s END)), 6) AS score FROM b""",
)
SCORES = """, round(1e-9 + greatest(0.0, least(1.0, sessions_last_7_days / 21.0::DOUBLE)), 6) AS session_frequency_score,
  round(1e-9 + 0.6 * greatest(0.0, least(1.0, avg_session_duration_minutes / 120))
    + 0.4 * greatest(0.0, least(1.0, levels_completed_last_week / 50.0::DOUBLE)), 6) AS engagement_score,
  round(1e-9 + greatest(0.0, least(1.0, ln(1 + purchases_last_30_days) / 10)), 6) AS monetary_score,
  round(1e-9 + greatest(0.0, least(1.0, social_connections / 100.0::DOUBLE)), 6) AS social_score,
  round(1e-9 + exp(-days_since_last_session / 7.0::DOUBLE), 6) AS recency_score"""
add(
    "ml_scores",
    lambda t: rounded(features.engineer_features(churn_feature_table(t)).select("player_id", *col.model_scores()),
                      *col.model_scores()),
    CF,
    f"SELECT player_id {SCORES} FROM CF",
)

# --- record rules ---------------------------------------------------------------------------------


def flagged(df, rule_set, *keep):
    checked = rules.with_reasons(df, rule_set)
    return checked.select(*keep, F.concat_ws(",", "reasons").alias("reasons"))


def reasons_sql(conditions: dict[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in conditions.items())
    return f"concat_ws(',', {parts}) AS reasons"


EVENT_CONDITIONS = {
    "missing_player_id": "player_id IS NULL",
    "blank_player_id": "trim(player_id) = ''",
    "missing_event_type": "event_type IS NULL",
    "unknown_event_type": """event_type NOT IN ('session_start', 'session_end', 'level_complete', 'purchase',
      'achievement_unlock', 'tutorial_complete')""",
    "missing_timestamp": "timestamp IS NULL",
    "purchase_without_amount": "event_type = 'purchase' AND purchase_amount IS NULL",
    "negative_amount": "event_type = 'purchase' AND purchase_amount < 0",
    "level_missing": "event_type = 'level_complete' AND level IS NULL",
    "level_below_one": "event_type = 'level_complete' AND level < 1",
    "negative_duration": "event_type IN ('session_start', 'session_end') AND session_duration < 0",
}
add(
    "validate_events",
    lambda t: flagged(t.DE, rules.event_rules(), "player_id", "timestamp", "event_type"),
    [DE],
    f"SELECT player_id, timestamp, event_type, {reasons_sql(EVENT_CONDITIONS)} FROM DE",
)
SHIFTED = """SELECT player_id, registration_date, total_sessions - 3 AS total_sessions, total_playtime_minutes - 100
  AS total_playtime_minutes, churn_risk_score * 1.1 - 0.05 AS churn_risk_score,
  last_active_date - INTERVAL 10 DAY AS last_active_date, highest_level_reached, total_purchases FROM P"""


def _shifted_profiles(t):
    """Profiles pushed over every limit of the profile rules."""
    from emberline.functions.times import plus_days

    return t.P.select(
        "player_id",
        "registration_date",
        (F.col("total_sessions") - 3).alias("total_sessions"),
        (F.col("total_playtime_minutes") - 100).alias("total_playtime_minutes"),
        (F.col("churn_risk_score") * 1.1 - 0.05).alias("churn_risk_score"),
        plus_days(F.col("last_active_date"), -10).alias("last_active_date"),
        F.when(F.col("highest_level_reached") % 7 != 0, F.col("highest_level_reached")).alias("highest_level_reached"),
        F.when(F.col("total_purchases") < 80, F.col("total_purchases")).alias("total_purchases"),
        F.when(F.dayofmonth("registration_date") != 3, F.col("churn_prediction_date")).alias("churn_prediction_date"),
    )


add(
    "validate_profiles",
    lambda t: flagged(_shifted_profiles(t), rules.profile_rules(), "player_id"),
    [P],
    f""", q AS ({SHIFTED}) SELECT player_id, """
    + reasons_sql(
        {
            "missing_field": "highest_level_reached % 7 = 0 OR total_purchases >= 80 OR day(registration_date) = 3",
            "risk_out_of_range": "churn_risk_score < 0 OR churn_risk_score > 1",
            "negative_sessions": "total_sessions < 0",
            "negative_playtime": "total_playtime_minutes < 0",
            "registered_after_last_active": "registration_date > last_active_date",
        }
    )
    + " FROM q",
)


def _shifted_features(t):
    return churn_feature_table(t).withColumns(
        {
            "player_id": F.when(F.col("social_connections") % 7 == 0, F.concat("player_id", F.lit("!"))).otherwise(
                F.col("player_id")
            ),
            "days_since_last_session": F.col("days_since_last_session") - 2,
            "sessions_last_7_days": F.col("sessions_last_7_days") + F.col("social_connections") % 3 * 500 - 1,
            "avg_session_duration_minutes": F.col("avg_session_duration_minutes") * 40 - 500,
        }
    )


BENT = """bent AS (SELECT * REPLACE (CASE WHEN social_connections % 7 = 0 THEN player_id || '!' ELSE player_id END AS player_id,
    days_since_last_session - 2 AS days_since_last_session,
    sessions_last_7_days + social_connections % 3 * 500 - 1 AS sessions_last_7_days,
    avg_session_duration_minutes * 40 - 500 AS avg_session_duration_minutes) FROM CF)"""
NAMES = tuple(rules.FEATURE_RANGES)
add(
    "validate_churn_features",
    lambda t: flagged(_shifted_features(t), rules.churn_feature_rules(), "player_id"),
    CF,
    f", {BENT} SELECT player_id, "
    + reasons_sql(
        {"bad_player_id": "NOT regexp_matches(player_id, '^[a-zA-Z0-9_-]+$')"}
        | {f"negative_{n}": f"{n} < 0" for n in NAMES}
        | {"sessions_after_last_session": "sessions_last_7_days > 0 AND days_since_last_session > 7"}
    )
    + " FROM bent",
)
add(
    "validate_feature_ranges",
    lambda t: flagged(_shifted_features(t), rules.feature_range_rules(), "player_id"),
    CF,
    f", {BENT} SELECT player_id, "
    + reasons_sql(
        {f"{n}_out_of_range": f"{n} NOT BETWEEN {lo} AND {hi}" for n, (lo, hi) in rules.FEATURE_RANGES.items()}
        | {"player_id_bad_characters": "NOT regexp_matches(player_id, '^[a-zA-Z0-9_-]+$')"}
    )
    + " FROM bent",
)
add(
    "validate_player_ids",
    lambda t: flagged(
        t.DE.select(
            F.when(F.col("level") == 3, F.repeat("player_id", 12))
            .when(F.col("level") == 4, F.lit("  "))
            .when(F.col("level") == 5, F.concat("player_id", F.lit(" #")))
            .otherwise(F.col("player_id"))
            .alias("player_id")
        ),
        rules.player_id_rules(),
        "player_id",
    ),
    [DE],
    """, q AS (SELECT CASE level WHEN 3 THEN repeat(player_id, 12) WHEN 4 THEN '  ' WHEN 5 THEN player_id || ' #'
        ELSE player_id END AS player_id FROM DE)
    SELECT player_id, """
    + reasons_sql(
        {
            "missing_player_id": "player_id IS NULL OR trim(player_id) = ''",
            "player_id_too_long": "length(player_id) > 100",
            "player_id_bad_characters": "trim(player_id) <> '' AND NOT regexp_matches(player_id, '^[a-zA-Z0-9_-]+$')",
        }
    )
    + " FROM q",
)
add(
    "validate_retention_metrics",
    lambda t: flagged(retention.segment_retention(t.E, t.P), rules.retention_rules(), "cohort_date", "segment"),
    [P, E],
    f""", c AS (SELECT player_id, CAST(registration_date AS DATE) AS cohort_date, {SPEND_CASE} AS segment FROM P),
    a AS (SELECT DISTINCT player_id, CAST(timestamp AS DATE) AS d FROM E),
    r AS (SELECT cohort_date, segment, count(DISTINCT CASE WHEN d = cohort_date + 1 THEN player_id END) AS n1,
        count(DISTINCT CASE WHEN d = cohort_date + 7 THEN player_id END) AS n7,
        count(DISTINCT CASE WHEN d = cohort_date + 30 THEN player_id END) AS n30 FROM c LEFT JOIN a USING (player_id) GROUP BY ALL)
    SELECT cohort_date, segment, """
    + reasons_sql({"day_7_above_day_1": "n7 > n1", "day_30_above_day_7": "n30 > n7"})
    + " FROM r",
)
add(
    "validate_cohort_records",
    lambda t: flagged(cohorts.cohort_long(t.E, t.P), rules.cohort_record_rules(), "cohort_date", "period"),
    [P, E],
    """, reg AS (SELECT player_id, CAST(registration_date AS DATE) AS cohort_date FROM P),
    seen AS (SELECT DISTINCT cohort_date, date_diff('day', cohort_date, CAST(timestamp AS DATE))::INTEGER AS period
             FROM E JOIN reg USING (player_id))
    SELECT a.cohort_date, b.period, CASE WHEN b.period < 0 THEN 'period_negative' ELSE '' END AS reasons
    FROM (SELECT DISTINCT cohort_date FROM seen) a, (SELECT DISTINCT period FROM seen) b""",
)
