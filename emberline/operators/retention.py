"""Cohort retention in its two definitions.

* elapsed time: a session inside [registration + n days, registration + n + 1 days];
* calendar: any event on the calendar day (week, month) n after the cohort's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import behavior_segment, spend_segment
from emberline.functions.times import When, as_date, plus_days, ts_lit
from emberline.operators.rollups import active_periods, registrations, session_days

RETENTION_DAYS = (1, 7, 30)


def session_in_day_window(day: int, closed: bool = True, registered: str = "registration_date") -> Column:
    """Did the (player, day) row have a session n days after the player's registration?"""
    opens = plus_days(F.col(registered), day)
    closes = plus_days(F.col(registered), day + 1)
    tail = (F.col("activity_date") == F.to_date(opens)) & (F.col("last_start") >= opens)
    in_time = F.col("first_start") <= closes if closed else F.col("first_start") < closes
    head = (F.col("activity_date") == F.to_date(closes)) & in_time
    return tail | head


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def retained_players(
    cohorts: DataFrame,
    sessions: DataFrame,
    keys: list[str],
    days: tuple[int, ...] = RETENTION_DAYS,
    closed: bool = True,
) -> DataFrame:
    """One row per cohort player with a 0/1 flag ``day_n`` per retention day.

    ``cohorts`` needs player_id, registration_date and ``keys``. Only player-days
    that hit a window survive the join, so its output stays near one row a player.
    """
    hits = {n: session_in_day_window(n, closed) for n in days}
    rolled = session_days(sessions).withColumnRenamed("player_id", "active_player_id")
    joined = cohorts.join(
        rolled, (F.col("player_id") == F.col("active_player_id")) & _any(hits.values()), "left"
    )
    return joined.groupBy("player_id", *keys).agg(
        *[F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias(f"day_{n}") for n, hit in hits.items()]
    )


def _cohort_counts(cohorts: DataFrame, sessions: DataFrame, start: When, end: When) -> DataFrame:
    """cohort_date, cohort_size and retained counts for registrations in [start, end]."""
    first, last = as_date(start), as_date(end)
    reachable = sessions.where(
        F.col("start_time").between(plus_days(ts_lit(first), 1), plus_days(ts_lit(last), 33))
    )
    return (
        retained_players(cohorts, reachable, ["cohort_date"])
        .groupBy("cohort_date")
        .agg(
            F.count(F.lit(1)).alias("cohort_size"),
            *[F.sum(f"day_{n}").alias(f"day_{n}_retained") for n in RETENTION_DAYS],
        )
    )


def registered_between(profiles: DataFrame, start: When, end: When) -> DataFrame:
    """Profiles whose registration *date* lies in [start, end], as a pushable range."""
    return profiles.where(
        (F.col("registration_date") >= ts_lit(as_date(start)))
        & (F.col("registration_date") < plus_days(ts_lit(as_date(end)), 1))
    )


def cohort_retained_by_date(
    profiles: DataFrame, sessions: DataFrame, start: When, end: When
) -> DataFrame:
    """Exact head-counts behind :func:`cohort_retention`."""
    cohorts = registrations(registered_between(profiles, start, end), "registration_date")
    return _cohort_counts(cohorts, sessions, start, end)


def _as_rates(counts: DataFrame, segment: Column) -> DataFrame:
    return counts.select(
        "cohort_date",
        *[
            (F.col(f"day_{n}_retained") / F.col("cohort_size")).alias(f"day_{n}_retention")
            for n in RETENTION_DAYS
        ],
        "cohort_size",
        segment.alias("segment"),
    ).orderBy("cohort_date")


def cohort_retention(
    profiles: DataFrame, sessions: DataFrame, start: When, end: When, segment: str | None = None
) -> DataFrame:
    """Elapsed-time retention per registration date; ``segment`` is only echoed."""
    counts = cohort_retained_by_date(profiles, sessions, start, end)
    return _as_rates(counts, F.lit(segment).cast("string"))


def retention_by_segment(
    profiles: DataFrame, sessions: DataFrame, start: When, end: When, segment: str
) -> DataFrame:
    """Elapsed-time retention of the players in one behaviour segment."""
    members = profiles.where(behavior_segment() == segment)
    counts = cohort_retained_by_date(members, sessions, start, end)
    return _as_rates(counts, F.lit(segment))


def _calendar_retention(
    events: DataFrame, cohorts: DataFrame, period: str, offsets: tuple[Column, Column, Column]
) -> DataFrame:
    """Share of each (cohort_date, segment) active in the three offset periods."""
    activity = active_periods(events, period).withColumnRenamed("player_id", "active_player_id")
    on = (F.col("player_id") == F.col("active_player_id")) & _any(
        F.col("activity_date") == target for target in offsets
    )
    flags = [
        F.max(F.coalesce(F.col("activity_date") == target, F.lit(False)).cast("int")).alias(f"day_{n}")
        for n, target in zip(RETENTION_DAYS, offsets)
    ]
    size = F.col("cohort_size")
    return (
        cohorts.join(activity, on, "left")
        .groupBy("player_id", "cohort_date", "segment")
        .agg(*flags)
        .groupBy("cohort_date", "segment")
        .agg(F.count(F.lit(1)).alias("cohort_size"), *[F.sum(f"day_{n}").alias(f"n{n}") for n in RETENTION_DAYS])
        .select(
            "cohort_date",
            *[(F.col(f"n{n}") / size).alias(f"day_{n}_retention") for n in RETENTION_DAYS],
            "cohort_size",
            "segment",
            ((F.col("n7") <= F.col("n1")) & (F.col("n30") <= F.col("n7"))).alias("is_monotone"),
        )
    )


def _day_offsets() -> tuple[Column, Column, Column]:
    return tuple(F.date_add("cohort_date", n) for n in RETENTION_DAYS)


def daily_retention(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Calendar-day retention 1, 7 and 30 days after registration."""
    cohorts = registrations(profiles, F.lit("all").alias("segment"))
    return _calendar_retention(events, cohorts, "day", _day_offsets()).orderBy("cohort_date")


def weekly_retention(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Retention 1, 2 and 4 Monday weeks later, in the day-1/7/30 columns."""
    cohorts = registrations(profiles, F.lit("weekly").alias("segment")).withColumn(
        "cohort_date", F.trunc("cohort_date", "week")
    )
    offsets = tuple(F.date_add("cohort_date", 7 * n) for n in (1, 2, 4))
    return _calendar_retention(events, cohorts, "week", offsets).orderBy("cohort_date")


def monthly_retention(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Retention 1, 2 and 3 calendar months later, in the day-1/7/30 columns."""
    cohorts = registrations(profiles, F.lit("monthly").alias("segment")).withColumn(
        "cohort_date", F.trunc("cohort_date", "month")
    )
    offsets = tuple(F.add_months("cohort_date", n) for n in (1, 2, 3))
    return _calendar_retention(events, cohorts, "month", offsets).orderBy("cohort_date")


def segment_retention(
    events: DataFrame, profiles: DataFrame, segment_field: str = "total_purchases"
) -> DataFrame:
    """Calendar-day retention per cohort and spend segment, in one pass."""
    cohorts = registrations(profiles, spend_segment(segment_field=segment_field).alias("segment"))
    return _calendar_retention(events, cohorts, "day", _day_offsets()).orderBy("segment", "cohort_date")
