"""Churn features derived from sessions and events, in both dialects."""

from __future__ import annotations

from checks.fixture_sql import E, P, S, SOC
from emberline.operators import features
from checks.fixtures import AS_OF


def churn_feature_table(t):
    return features.derive_churn_features(t.P, t.S, t.E, AS_OF, social=t.SOC)


_NOW = "TIMESTAMP '2024-01-30 00:00:00'"
CF = [
    P,
    E,
    S,
    SOC,
    f"""CF AS (SELECT P.player_id, DATE '2024-01-30' AS feature_date,
      greatest(0, floor(epoch({_NOW} - coalesce((SELECT max(start_time) FROM S WHERE S.player_id = P.player_id AND start_time <= {_NOW}),
        last_active_date)) / 86400.0))::INTEGER AS days_since_last_session,
      (SELECT count(*) FROM S WHERE S.player_id = P.player_id AND start_time > {_NOW} - INTERVAL 7 DAY AND start_time <= {_NOW})
        ::INTEGER AS sessions_last_7_days,
      coalesce((SELECT avg(duration_minutes) FROM S WHERE S.player_id = P.player_id AND start_time <= {_NOW}), 0.0)::DOUBLE
        AS avg_session_duration_minutes,
      (SELECT count(*) FROM E WHERE E.player_id = P.player_id AND event_type = 'level_complete'
         AND timestamp > {_NOW} - INTERVAL 7 DAY AND timestamp <= {_NOW})::INTEGER AS levels_completed_last_week,
      coalesce((SELECT sum(purchase_amount) FROM E WHERE E.player_id = P.player_id AND event_type = 'purchase'
         AND timestamp > {_NOW} - INTERVAL 30 DAY AND timestamp <= {_NOW}), 0.0)::DOUBLE AS purchases_last_30_days,
      coalesce((SELECT max(social_connections) FROM SOC WHERE SOC.player_id = P.player_id), 0) AS social_connections
    FROM P)""",
]
