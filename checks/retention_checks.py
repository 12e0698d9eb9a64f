"""Retention, cohorts, activity, funnels and churn tables."""

from __future__ import annotations

from checks.fixture_sql import E, P, S
from checks.registry import add, add_same, r6, rounded
from emberline.functions.text import fixed
from emberline.operators import activity, bitmaps, churn, cohorts, funnels, retention
from checks.fixtures import AS_OF, COHORT_END, COHORT_START, DROPOFF_END, DROPOFF_START

# --- elapsed-time retention ------------------------------------------------------------------------

SEGMENT_CASE = """CASE WHEN total_sessions >= 20 AND total_playtime_minutes >= 1200 THEN 'High Engagement'
  WHEN total_sessions >= 10 AND total_playtime_minutes >= 600 THEN 'Medium Engagement'
  WHEN total_sessions >= 3 AND total_playtime_minutes >= 180 THEN 'Low Engagement'
  ELSE 'Minimal Engagement' END"""


def elapsed_retention(members: str, segment: str) -> str:
    """Each member once, with a flag per retention day that any session's age can raise."""
    day = 86_400_000_000
    flags = ", ".join(
        f"coalesce(bool_or(epoch_us(s.start_time) - epoch_us(m.since) BETWEEN {n * day} AND {(n + 1) * day}), false) AS kept_{n}"
        for n in (1, 7, 30)
    )
    rates = ", ".join(f"count(*) FILTER (kept_{n})::DOUBLE / count(*) AS day_{n}_retention" for n in (1, 7, 30))
    return f""", m AS (SELECT player_id, registration_date AS since FROM P WHERE {members}),
    kept AS (SELECT m.player_id, any_value(m.since) AS since, {flags} FROM m LEFT JOIN S s USING (player_id) GROUP BY m.player_id)
    SELECT since::DATE AS cohort_date, {rates}, count(*) AS cohort_size, CAST({segment} AS VARCHAR) AS segment FROM kept GROUP BY 1"""


IN_WINDOW = f"CAST(registration_date AS DATE) BETWEEN DATE '{COHORT_START}' AND DATE '{COHORT_END}'"

add(
    "cohort_retention",
    lambda t: retention.cohort_retention(t.P, t.S, COHORT_START, COHORT_END, "all"),
    [P, S],
    elapsed_retention(IN_WINDOW, "'all'"),
)
add(
    "retention_by_segment",
    lambda t: retention.retention_by_segment(t.P, t.S, COHORT_START, COHORT_END, "High Engagement"),
    [P, S],
    elapsed_retention(f"{IN_WINDOW} AND {SEGMENT_CASE} = 'High Engagement'", "'High Engagement'"),
)


# --- calendar retention ---------------------------------------------------------------------------


def calendar_retention(cohort: str, period: str, shifts: tuple[str, str, str], segment: str) -> str:
    counts = ", ".join(
        f"""(SELECT count(DISTINCT a.player_id) FROM act a JOIN c c2 ON a.player_id = c2.player_id
           WHERE c2.cohort_date = z.cohort_date AND c2.segment = z.segment
             AND a.d = CAST(z.cohort_date + {shift} AS DATE)) AS n{n}"""
        for n, shift in zip((1, 7, 30), shifts)
    )
    return f""", c AS (SELECT player_id, CAST({cohort} AS DATE) AS cohort_date, {segment} AS segment FROM P),
    act AS (SELECT DISTINCT player_id, CAST({period} AS DATE) AS d FROM E),
    z AS (SELECT cohort_date, segment, count(*) AS cohort_size FROM c GROUP BY ALL),
    r AS (SELECT z.*, {counts} FROM z)
    SELECT cohort_date, n1::DOUBLE / cohort_size AS day_1_retention, n7::DOUBLE / cohort_size AS day_7_retention,
      n30::DOUBLE / cohort_size AS day_30_retention, cohort_size, segment,
      (n7 <= n1 AND n30 <= n7) AS is_monotone FROM r ORDER BY cohort_date"""


DAYS = ("INTERVAL 1 DAY", "INTERVAL 7 DAY", "INTERVAL 30 DAY")
SPEND_CASE = """CASE WHEN total_purchases = 0 THEN 'non_paying' WHEN total_purchases < 10 THEN 'low_spender'
  WHEN total_purchases < 50 THEN 'medium_spender' ELSE 'high_spender' END"""

add(
    "daily_retention",
    lambda t: retention.daily_retention(t.E, t.P),
    [P, E],
    calendar_retention("registration_date", "timestamp", DAYS, "'all'"),
)
add(
    "weekly_retention",
    lambda t: retention.weekly_retention(t.E, t.P),
    [P, E],
    calendar_retention(
        "date_trunc('week', registration_date)",
        "date_trunc('week', timestamp)",
        ("INTERVAL 7 DAY", "INTERVAL 14 DAY", "INTERVAL 28 DAY"),
        "'weekly'",
    ),
)
add(
    "monthly_retention",
    lambda t: retention.monthly_retention(t.E, t.P),
    [P, E],
    calendar_retention(
        "date_trunc('month', registration_date)",
        "date_trunc('month', timestamp)",
        ("INTERVAL 1 MONTH", "INTERVAL 2 MONTH", "INTERVAL 3 MONTH"),
        "'monthly'",
    ),
)
add(
    "segment_retention",
    lambda t: retention.segment_retention(t.E, t.P),
    [P, E],
    calendar_retention("registration_date", "timestamp", DAYS, SPEND_CASE),
)

# --- cohort grid ----------------------------------------------------------------------------------

GRID = """reg AS (SELECT player_id, CAST(registration_date AS DATE) AS cohort_date FROM P),
  sizes AS (SELECT cohort_date, count(*) AS cohort_size FROM reg GROUP BY cohort_date),
  seen AS (SELECT cohort_date, date_diff('day', cohort_date, CAST(timestamp AS DATE))::INTEGER AS day,
             count(DISTINCT player_id) AS retained
           FROM E JOIN reg USING (player_id) GROUP BY ALL),
  grid AS (SELECT z.cohort_date, d.day, z.cohort_size,
             CASE WHEN z.cohort_date IN (SELECT cohort_date FROM seen) THEN coalesce(s.retained, 0) END AS retained
           FROM sizes z CROSS JOIN (SELECT DISTINCT day FROM seen) d
           LEFT JOIN seen s ON s.cohort_date = z.cohort_date AND s.day = d.day),
  rates AS (SELECT *, retained::DOUBLE / cohort_size AS retention_rate FROM grid)"""

add(
    "cohort_table",
    lambda t: cohorts.cohort_table(t.E, t.P),
    [P, E],
    f", {GRID} SELECT cohort_date, day, retained, cohort_size, retention_rate FROM rates",
)


def _heatmap(t):
    from pyspark.sql import functions as F

    table = cohorts.cohort_heatmap(t.E, t.P)
    return table.select(
        "cohort_date",
        "cohort_size",
        F.concat_ws(",", F.col("days").cast("array<string>")).alias("days"),
        F.concat_ws(
            ",", F.transform("rates", lambda r: F.coalesce(fixed(r, 3), F.lit("-")))
        ).alias("rates"),
        r6("day_0_rate").alias("day_0_rate"),
    )


add(
    "cohort_heatmap",
    _heatmap,
    [P, E],
    f""", {GRID} SELECT cohort_date, cohort_size, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days,
      string_agg(coalesce(format('{{:.3f}}', retention_rate), '-'), ',' ORDER BY day) AS rates,
      round(1e-9 + max(CASE WHEN day = 0 THEN retention_rate END), 6) AS day_0_rate
    FROM rates GROUP BY cohort_date, cohort_size""",
)
add(
    "cohort_long",
    lambda t: cohorts.cohort_long(t.E, t.P),
    [P, E],
    f""", {GRID} SELECT cohort_date, day AS period, retention_rate, cohort_size FROM rates
      WHERE retention_rate IS NOT NULL""",
)
add(
    "cohort_retained_counts",
    lambda t: cohorts.cohort_retained_counts(t.E, t.P),
    [P, E],
    f", {GRID} SELECT cohort_date, day AS period, retained AS players FROM rates WHERE retained IS NOT NULL",
)
add(
    "cohort_sizes",
    lambda t: cohorts.cohort_sizes(t.E, t.P),
    [P, E],
    f""", {GRID} SELECT cohort_date, any_value(cohort_size) AS cohort_size FROM rates
      WHERE retention_rate IS NOT NULL GROUP BY cohort_date""",
)
add(
    "avg_retention_by_day",
    lambda t: rounded(cohorts.avg_retention_by_day(t.E, t.P), "avg_retention"),
    [P, E],
    f""", {GRID} SELECT day, round(1e-9 + avg(retention_rate), 6) AS avg_retention FROM rates WHERE day >= 0 GROUP BY day""",
)
PIVOT = ", ".join(
    f"""CASE WHEN {n} IN (SELECT day FROM seen) THEN max(CASE WHEN day = {n} THEN retention_rate END)
        ELSE 0.0 END AS day_{n}_retention"""
    for n in (1, 7, 30)
)
PERF = f"perf AS (SELECT cohort_date, cohort_size, {PIVOT} FROM rates GROUP BY cohort_date, cohort_size)"
add(
    "cohort_performance",
    lambda t: cohorts.cohort_performance(t.E, t.P),
    [P, E],
    f", {GRID}, {PERF} SELECT * FROM perf",
)
DECLINE = " UNION ALL ".join(
    f"""SELECT 'day_{a}_to_{b}' AS step,
       round(1e-9 + avg((day_{a}_retention - day_{b}_retention) / day_{a}_retention), 6) AS avg_decline
     FROM perf WHERE day_{a}_retention > 0 AND {a} IN (SELECT day FROM seen) AND {b} IN (SELECT day FROM seen)
     HAVING count(*) > 0"""
    for a, b in ((1, 7), (7, 30))
)
add(
    "retention_decline",
    lambda t: rounded(cohorts.retention_decline(t.E, t.P), "avg_decline"),
    [P, E],
    f", {GRID}, {PERF} {DECLINE}",
)
add(
    "best_worst_cohorts",
    lambda t: cohorts.best_worst_cohorts(t.E, t.P),
    [P, E],
    f""", {GRID}, d30 AS (SELECT cohort_date, retention_rate AS r FROM rates WHERE day = 30 AND retention_rate IS NOT NULL),
    cut AS (SELECT quantile_cont(r, 0.8) AS hi, quantile_cont(r, 0.2) AS lo FROM d30)
    SELECT 'best' AS performance, cohort_date, r AS day_30_retention FROM d30, cut WHERE r >= hi
    UNION ALL SELECT 'worst', cohort_date, r FROM d30, cut WHERE r <= lo""",
)
add(
    "lifecycle_segments",
    lambda t: rounded(cohorts.lifecycle_segments(t.E, t.P, AS_OF), "avg_events_per_day"),
    [P, E],
    """, a AS (SELECT player_id, max(CAST(timestamp AS DATE)) AS last_d, count(DISTINCT CAST(timestamp AS DATE)) AS days,
                count(*) AS n FROM E GROUP BY player_id),
    m AS (SELECT p.player_id, CAST(p.registration_date AS DATE) AS registration_date, a.last_d AS last_activity_date,
        date_diff('day', coalesce(a.last_d, CAST(p.registration_date AS DATE)), DATE '2024-01-30')::INTEGER
          AS days_since_last_activity,
        coalesce(a.days, 0) AS total_active_days,
        coalesce(a.n, 0)::DOUBLE / (date_diff('day', CAST(p.registration_date AS DATE), DATE '2024-01-30') + 1) AS r
      FROM P p LEFT JOIN a USING (player_id))
    SELECT player_id, registration_date, last_activity_date, days_since_last_activity, total_active_days,
      round(1e-9 + r, 6) AS avg_events_per_day,
      CASE WHEN last_activity_date IS NULL THEN 'inactive'
        WHEN days_since_last_activity <= 1 THEN CASE WHEN r >= 5 THEN 'highly_active' WHEN r >= 1 THEN 'active' ELSE 'casual' END
        WHEN days_since_last_activity <= 7 THEN 'at_risk' WHEN days_since_last_activity <= 30 THEN 'dormant'
        ELSE 'churned' END AS lifecycle_segment
    FROM m""",
)
add(
    "cohort_ltv",
    lambda t: rounded(cohorts.cohort_ltv(t.E, t.P), "total_revenue", "avg_ltv"),
    [P, E],
    """, r AS (SELECT player_id, sum(purchase_amount) AS rev FROM E WHERE event_type = 'purchase' GROUP BY player_id),
    x AS (SELECT CAST(registration_date AS DATE) AS cohort_date, coalesce(rev, 0) AS rev FROM P LEFT JOIN r USING (player_id))
    SELECT cohort_date, count(*) AS cohort_size, round(1e-9 + sum(rev), 6) AS total_revenue, round(1e-9 + avg(rev), 6) AS avg_ltv,
      count(*) FILTER (rev > 0) AS paying_users, count(*) FILTER (rev > 0)::DOUBLE / count(*) AS conversion_rate
    FROM x WHERE EXISTS (SELECT 1 FROM r) GROUP BY cohort_date""",
)
add(
    "retention_funnel",
    lambda t: rounded(cohorts.retention_funnel(t.E, t.P), "retention_rate", "drop_off_rate"),
    [P, E],
    f""", {GRID}, m AS (SELECT day, avg(retention_rate) AS a FROM rates GROUP BY day),
    st AS (SELECT CAST(i AS INTEGER) AS stage_order, 'Day ' || d AS stage, m.a
           FROM (VALUES (0, 1), (1, 3), (2, 7), (3, 14), (4, 30)) v(i, d) LEFT JOIN m ON m.day = v.d),
    w AS (SELECT *, coalesce((SELECT arg_max(b.a, b.stage_order) FROM st b WHERE b.stage_order < st.stage_order
                              AND b.a IS NOT NULL), 1.0) AS prev FROM st)
    SELECT stage_order, stage, round(1e-9 + coalesce(a, prev), 6) AS retention_rate,
      round(1e-9 + coalesce(prev - a, 0.0), 6) AS drop_off_rate, (SELECT count(*) FROM P) AS total_players FROM w""",
)
add(
    "seasonal_retention",
    lambda t: rounded(cohorts.seasonal_retention(t.E, t.P), "avg_30_day_retention"),
    [P, E],
    f""", {GRID}, d AS (SELECT cohort_date, retention_rate AS r FROM rates WHERE day = 30)
    SELECT 'month' AS pattern, month(cohort_date)::INTEGER AS period, round(1e-9 + avg(r), 6) AS avg_30_day_retention FROM d GROUP BY 2
    UNION ALL SELECT 'day_of_week', (isodow(cohort_date) - 1)::INTEGER, round(1e-9 + avg(r), 6) FROM d GROUP BY 2
    UNION ALL SELECT 'quarter', quarter(cohort_date)::INTEGER, round(1e-9 + avg(r), 6) FROM d GROUP BY 2""",
)

# --- drop-off, segments, activity -----------------------------------------------------------------

add(
    "level_dropoff",
    lambda t: activity.level_dropoff(t.P, t.S, DROPOFF_START, DROPOFF_END, 50),
    [P, S],
    f""", top AS (SELECT player_id, max(level_reached) AS best FROM S GROUP BY player_id),
    hit AS (SELECT DISTINCT player_id, level_reached AS level FROM S
      WHERE start_time >= TIMESTAMP '{DROPOFF_START}' AND start_time <= TIMESTAMP '{DROPOFF_END}' AND level_reached <= 50
        AND player_id IN (SELECT player_id FROM P)),
    tally AS (SELECT level, count(*) AS players_reached, count(*) FILTER (best > level) AS players_completed
      FROM hit JOIN top USING (player_id) GROUP BY level)
    SELECT *, (players_reached - players_completed)::DOUBLE / players_reached AS drop_off_rate,
      players_completed::DOUBLE / players_reached AS completion_rate FROM tally""",
)
add(
    "behavior_segments",
    lambda t: rounded(
        activity.behavior_segments(t.P, t.S, COHORT_START, COHORT_END),
        "avg_sessions", "avg_playtime", "avg_retention_day_7",
    ),
    [P, S],
    f""", m AS (SELECT *, {SEGMENT_CASE} AS segment, CASE WHEN EXISTS (SELECT 1 FROM S s WHERE s.player_id = P.player_id
        AND s.start_time >= P.registration_date + INTERVAL 7 DAY AND s.start_time < P.registration_date + INTERVAL 8 DAY)
        THEN 1.0 ELSE 0.0 END AS r7
      FROM P WHERE registration_date BETWEEN TIMESTAMP '{COHORT_START}' AND TIMESTAMP '{COHORT_END}')
    SELECT segment, count(*) AS player_count, round(1e-9 + avg(total_sessions), 6) AS avg_sessions,
      round(1e-9 + avg(total_playtime_minutes), 6) AS avg_playtime, round(1e-9 + avg(r7), 6) AS avg_retention_day_7
    FROM m GROUP BY segment""",
)
add(
    "dau",
    lambda t: activity.dau(t.S, "2024-01-01", "2024-01-30"),
    [S],
    """SELECT CAST(start_time AS DATE) AS activity_date, count(DISTINCT player_id) AS dau_count FROM S
    WHERE CAST(start_time AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1""",
)
add(
    "wau",
    lambda t: activity.wau(t.S, "2024-01-01", "2024-01-28"),
    [S],
    """SELECT CAST(date_trunc('week', start_time) AS DATE) AS week_start, count(DISTINCT player_id) AS wau_count FROM S
    WHERE start_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-28' GROUP BY 1""",
)
TIMELINE = """tl AS (SELECT CAST(timestamp AS DATE) AS date, count(DISTINCT player_id) AS dau,
    avg(CASE WHEN event_type = 'session_start' THEN session_duration END) AS dur,
    count(*) FILTER (event_type = 'session_start')::DOUBLE / count(DISTINCT player_id) AS per FROM E GROUP BY 1)"""
add(
    "engagement_timeline",
    lambda t: rounded(activity.engagement_timeline(t.E), "avg_session_duration", "sessions_per_user"),
    [E],
    f""", {TIMELINE} SELECT date, dau, (dau * 4.5)::DOUBLE AS wau_est, dau * 15 AS mau_est,
      round(1e-9 + dur, 6) AS avg_session_duration, round(1e-9 + per, 6) AS sessions_per_user FROM tl""",
)
add(
    "engagement_product",
    lambda t: rounded(activity.engagement_products(activity.engagement_timeline(t.E)), "engagement_score"),
    [E],
    f", {TIMELINE} SELECT date, round(1e-9 + dur * per, 6) AS engagement_score FROM tl",
)
BY_DAY = "player_id, CAST(timestamp AS DATE) AS date"
SESSION_METRICS = f"""SELECT {BY_DAY}, count(timestamp) AS session_count, round(1e-9 + avg(session_duration), 6) AS avg_session_duration,
    round(1e-9 + coalesce(sum(session_duration), 0), 6) AS total_session_duration
    FROM E WHERE event_type = 'session_start' GROUP BY 1, 2"""
PURCHASE_METRICS = f"""SELECT {BY_DAY}, count(purchase_amount) AS purchase_count,
    round(1e-9 + coalesce(sum(purchase_amount), 0), 6) AS total_revenue FROM E WHERE event_type = 'purchase' GROUP BY 1, 2"""
LEVEL_METRICS = f"""SELECT {BY_DAY}, count(level) AS levels_completed, max(level) AS max_level
    FROM E WHERE event_type = 'level_complete' GROUP BY 1, 2"""
add(
    "daily_session_metrics",
    lambda t: rounded(activity.daily_session_metrics(t.E), "avg_session_duration", "total_session_duration"),
    [E],
    SESSION_METRICS,
)
add(
    "daily_purchase_metrics",
    lambda t: rounded(activity.daily_purchase_metrics(t.E), "total_revenue"),
    [E],
    PURCHASE_METRICS,
)
add("daily_progression_metrics", lambda t: activity.daily_progression_metrics(t.E), [E], LEVEL_METRICS)
FILLED = ", ".join(
    f"coalesce({c}, 0)::DOUBLE AS {c}"
    for c in (
        "session_count", "avg_session_duration", "total_session_duration", "purchase_count", "total_revenue",
        "levels_completed", "max_level",
    )
)
add(
    "daily_player_summary",
    lambda t: rounded(
        activity.daily_player_summary(t.E), "avg_session_duration", "total_session_duration", "total_revenue"
    ),
    [E],
    f""", sm AS ({SESSION_METRICS}), pm AS ({PURCHASE_METRICS}), lm AS ({LEVEL_METRICS}),
    d AS (SELECT {BY_DAY}, count(*) AS total_events FROM E GROUP BY 1, 2)
    SELECT player_id, date, total_events, {FILLED} FROM d LEFT JOIN sm USING (player_id, date)
      LEFT JOIN pm USING (player_id, date) LEFT JOIN lm USING (player_id, date)""",
)

# --- funnels --------------------------------------------------------------------------------------

FUNNEL = "fu AS (" + " UNION ALL ".join(
    f"""SELECT '{"Tutorial" if m == 1 else f"Level {m}"}' AS stage, {i} AS stage_order,
      (SELECT count(DISTINCT player_id) FROM E WHERE event_type = 'level_complete' AND level >= {m}) AS players"""
    for i, m in enumerate(funnels.MILESTONES)
) + ")"
add(
    "milestone_funnel",
    lambda t: funnels.milestone_funnel(t.E),
    [E],
    f""", {FUNNEL} SELECT stage, players, stage_order,
      players::DOUBLE / (SELECT players FROM fu WHERE stage_order = 0) AS conversion_rate FROM fu""",
)
LEVELS = """lv AS (SELECT level, count(DISTINCT player_id) AS completions, count(timestamp) AS total_attempts
    FROM E WHERE event_type = 'level_complete' GROUP BY level),
  lx AS (SELECT level, completions, total_attempts, total_attempts::DOUBLE / completions AS avg_attempts,
    CASE WHEN level <= 5 THEN 'Tutorial' WHEN level <= 10 THEN 'Beginner' WHEN level <= 15 THEN 'Intermediate'
      ELSE 'Advanced' END AS level_group,
    completions::DOUBLE / (SELECT max(completions) FROM lv) AS completion_rate FROM lv)"""
add("level_progression", lambda t: funnels.level_progression(t.E), [E], f", {LEVELS} SELECT * FROM lx")
add("level_group", lambda t: funnels.level_progression(t.E).select("level", "level_group"), [E],
    f", {LEVELS} SELECT level, level_group FROM lx")
MILES = """pm AS (SELECT strftime(registration_date, '%Y-%m') AS cohort, P.player_id,
    coalesce((SELECT max(level) FROM E WHERE E.player_id = P.player_id AND event_type = 'level_complete'), 0) AS best,
    EXISTS (SELECT 1 FROM E WHERE E.player_id = P.player_id AND event_type = 'purchase') AS first_purchase FROM P)"""
add(
    "player_milestones",
    lambda t: funnels.player_milestones(t.E, t.P),
    [P, E],
    f""", {MILES} SELECT cohort, player_id, best >= 1 AS tutorial_complete, best >= 5 AS level_5_complete,
      best >= 10 AS level_10_complete, first_purchase FROM pm""",
)
add(
    "cohort_funnel_comparison",
    lambda t: rounded(funnels.cohort_funnel_comparison(t.E, t.P), "conversion_rate"),
    [P, E],
    ", " + MILES + " " + " UNION ALL ".join(
        f"""SELECT cohort, '{name}' AS stage, {i} AS stage_order,
          round(1e-9 + avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END), 6) AS conversion_rate FROM pm GROUP BY cohort"""
        for i, (name, cond) in enumerate(
            (("tutorial_complete", "best >= 1"), ("level_5_complete", "best >= 5"),
             ("level_10_complete", "best >= 10"), ("first_purchase", "first_purchase"))
        )
    ),
)
STEP = """st AS (SELECT f.*, b.stage AS stage_b, b.players AS players_b,
    CASE WHEN b.players > 0 THEN (b.players - f.players)::DOUBLE / b.players ELSE 0.0 END AS stage_drop_off
  FROM fu f LEFT JOIN fu b ON b.stage_order = f.stage_order - 1)"""
add(
    "funnel_stage_rates",
    lambda t: funnels.funnel_stage_rates(funnels.milestone_funnel(t.E)),
    [E],
    f""", {FUNNEL}, {STEP} SELECT stage, players, stage_order,
      players::DOUBLE / (SELECT players FROM fu WHERE stage_order = 0) AS conversion_rate,
      1 - players::DOUBLE / (SELECT players FROM fu WHERE stage_order = 0) AS drop_off_rate, stage_drop_off FROM st""",
)
add(
    "funnel_transitions",
    lambda t: funnels.funnel_transitions(funnels.milestone_funnel(t.E)),
    [E],
    f""", {FUNNEL}, {STEP} SELECT stage_b || ' → ' || stage AS transition, stage_drop_off AS drop_off_rate,
      players_b - players AS drop_off_players, stage_order FROM st WHERE stage_b IS NOT NULL""",
)
add(
    "funnel_summary",
    lambda t: funnels.funnel_summary(funnels.milestone_funnel(t.E)),
    [E],
    f""", {FUNNEL}, {STEP}, en AS (SELECT (SELECT players FROM fu WHERE stage_order = 0) AS total_players,
        (SELECT players FROM fu WHERE stage_order = 6) AS final_players)
    SELECT total_players, final_players,
      (SELECT stage FROM st ORDER BY stage_drop_off DESC, stage_order LIMIT 1) AS biggest_dropoff_stage,
      (SELECT max(stage_drop_off) FROM st) AS biggest_dropoff_rate, (SELECT count(*) FROM fu) AS stage_count,
      final_players::DOUBLE / total_players AS overall_conversion FROM en""",
)
add(
    "level_heatmap",
    lambda t: funnels.level_heatmap(funnels.level_progression(t.E), list(range(1, 31))),
    [E],
    f", {LEVELS} SELECT level_group, "
    + ", ".join(f"max(CASE WHEN level = {n} THEN completion_rate END) AS level_{n}" for n in range(1, 31))
    + " FROM lx GROUP BY level_group",
)

# --- churn tables ---------------------------------------------------------------------------------

LEVEL_CASE = """CASE WHEN total_sessions >= 100 AND total_purchases > 50 THEN 'premium' WHEN total_sessions >= 50 THEN 'core'
  WHEN total_sessions >= 10 THEN 'casual' ELSE 'new' END"""
CHURN = f"""ch AS (SELECT player_id, churn_risk_score, {LEVEL_CASE} AS segment,
    date_diff('day', CAST(last_active_date AS DATE), DATE '2024-01-30')::INTEGER AS days_since_last_session,
    total_sessions, total_playtime_minutes AS total_playtime, total_purchases FROM P)"""
add("churn_table", lambda t: churn.churn_table(t.P, AS_OF), [P], f", {CHURN} SELECT * FROM ch")
add(
    "filter_churn",
    lambda t: churn.filter_churn(churn.churn_table(t.P, AS_OF), ["core", "casual"], 0.2, 0.8),
    [P],
    f", {CHURN} SELECT * FROM ch WHERE segment IN ('core', 'casual') AND churn_risk_score BETWEEN 0.2 AND 0.8",
)
RISK_CASE = "CASE WHEN churn_risk_score >= 0.7 THEN 'high' WHEN churn_risk_score >= 0.3 THEN 'medium' ELSE 'low' END"
add(
    "risk_breakdown",
    lambda t: churn.risk_breakdown(churn.churn_table(t.P, AS_OF)),
    [P],
    f"SELECT {RISK_CASE} AS risk_category, count(*) AS players FROM P GROUP BY 1",
)
add(
    "risk_histogram",
    lambda t: churn.risk_histogram(churn.churn_table(t.P, AS_OF)),
    [P],
    f""", {CHURN} SELECT segment, CAST(least(floor(churn_risk_score * 30) + 1, 30) AS INTEGER) AS bin, count(*) AS players
      FROM ch GROUP BY 1, 2""",
)
add(
    "risk_boxplot",
    lambda t: rounded(churn.risk_boxplot(churn.churn_table(t.P, AS_OF)), "q1", "median", "q3"),
    [P],
    f""", {CHURN}, q AS (SELECT segment, quantile_cont(churn_risk_score, 0.25) AS q1, quantile_cont(churn_risk_score, 0.5) AS median,
        quantile_cont(churn_risk_score, 0.75) AS q3 FROM ch GROUP BY segment),
    x AS (SELECT ch.segment, q1, median, q3, churn_risk_score AS v,
        churn_risk_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM ch JOIN q USING (segment))
    SELECT segment, round(1e-9 + q1, 6) AS q1, round(1e-9 + median, 6) AS median, round(1e-9 + q3, 6) AS q3,
      min(v) FILTER (ok) AS lower_whisker, max(v) FILTER (ok) AS upper_whisker, count(*) FILTER (NOT ok) AS outliers
    FROM x GROUP BY ALL""",
)
add(
    "engagement_histogram",
    lambda t: churn.engagement_histogram(t.E),
    [E],
    f""", {TIMELINE}, g AS (SELECT dur * per AS v FROM tl WHERE dur IS NOT NULL),
    b AS (SELECT min(v) AS lo, max(v) AS hi FROM g)
    SELECT CAST(least(floor((v - lo) * 30 / (hi - lo)) + 1, 30) AS INTEGER) AS bin, count(*) AS days FROM g, b GROUP BY 1""",
)
add(
    "churn_summary",
    lambda t: rounded(churn.churn_summary(churn.churn_table(t.P, AS_OF)), "avg_risk_score", "high_risk_pct"),
    [P],
    """SELECT count(*) AS total_players, count(*) FILTER (churn_risk_score >= 0.7) AS high_risk_players,
      round(1e-9 + avg(churn_risk_score), 6) AS avg_risk_score,
      round(1e-9 + count(*) FILTER (churn_risk_score >= 0.7)::DOUBLE / count(*) * 100, 6) AS high_risk_pct FROM P""",
)
add(
    "overview_kpis",
    lambda t: rounded(churn.overview_kpis(t.E, t.P, AS_OF, "core"), "avg_dau", "funnel_conversion"),
    [P, E],
    f""", {CHURN}, {TIMELINE}, {FUNNEL}
    SELECT count(*) AS total_players, count(*) FILTER (churn_risk_score >= 0.7) AS high_risk_players,
      (SELECT round(1e-9 + avg(dau), 6) FROM tl) AS avg_dau,
      round(1e-9 + (SELECT players FROM fu WHERE stage_order = 6)::DOUBLE / (SELECT players FROM fu WHERE stage_order = 0), 6)
        AS funnel_conversion
    FROM ch WHERE segment = 'core'""",
)

# --- the same questions from the bitmap index -------------------------------------------------------


def _indexed(t, query):
    return query(bitmaps.build_index(t.P, t.S, t.E))


for _name, _query in (
    ("cohort_retention", lambda i: bitmaps.cohort_retention(i, COHORT_START, COHORT_END, "all")),
    ("retention_by_segment", lambda i: bitmaps.cohort_retention(i, COHORT_START, COHORT_END, behavior="High Engagement")),
    ("daily_retention", bitmaps.daily_retention),
    ("weekly_retention", bitmaps.weekly_retention),
    ("monthly_retention", bitmaps.monthly_retention),
    ("segment_retention", bitmaps.segment_retention),
    ("cohort_table", bitmaps.cohort_table),
    ("dau", lambda i: bitmaps.dau(i, "2024-01-01", "2024-01-30")),
    ("wau", lambda i: bitmaps.wau(i, "2024-01-01", "2024-01-28")),
):
    add_same(f"bitmap_{_name}", lambda t, q=_query: _indexed(t, q), _name)
