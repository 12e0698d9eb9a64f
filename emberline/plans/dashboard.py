"""All analytics tables of the dashboard from the three loaded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberline.functions.times import When
from emberline.operators import activity, churn, cohorts, funnels


def dashboard_tables(profiles: DataFrame, events: DataFrame, as_of: When) -> dict[str, DataFrame]:
    """Lazy tables by name; nothing runs until one of them is used."""
    return {
        "cohort_data": cohorts.cohort_long(events, profiles),
        "engagement_data": activity.engagement_timeline(events),
        "churn_data": churn.churn_table(profiles, as_of),
        "funnel_data": funnels.milestone_funnel(events),
        "level_data": funnels.level_progression(events),
        "cohort_funnel_data": funnels.player_milestones(events, profiles),
    }
