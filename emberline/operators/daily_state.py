"""Daily KPIs from a stored state of one row a player, moved on by the new day's rows alone.

The state keeps what later KPIs can still ask of a player: registration, last activity, last session
day, whether the retention windows were hit, and a bitmap of the last 64 days (bit ``i`` is set if the
player was active ``i`` days before the state's day). Two states of a day merge by OR, maximum and
minimum, so sessions may come late or twice, and in any order.

Retention windows need the registration. Player-days of players who have none yet wait in a second
table until it arrives or no window can reach them any more.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions.times import When, as_date, date_lit, ts_lit
from emberline.operators.kpi import CHURN_LOOKBACK, COHORT_DAYS, STORED
from emberline.operators.retention import RETENTION_DAYS, session_in_day_window
from emberline.operators.rollups import session_days

#: Days a bitmap holds.
BITS = 64
#: Days after which a waiting player-day can hit no window of a cohort that is still asked for.
WAITING_DAYS = COHORT_DAYS + 1

STATE = (
    "player_id string, registration_date timestamp_ntz, last_active_date timestamp_ntz, last_session date,"
    " active bigint, at_midnight bigint, " + ", ".join(f"day_{n} boolean" for n in RETENTION_DAYS)
)
WAITING = "player_id string, activity_date date, first_start timestamp_ntz, last_start timestamp_ntz"


def empty_state(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The state before any day, and no waiting player-days."""
    return spark.createDataFrame([], STATE), spark.createDataFrame([], WAITING)


def _bit(day: Column, as_of: dt.date) -> Column:
    age = F.datediff(date_lit(as_of), day)
    return F.when(age.between(0, BITS - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), age)).otherwise(F.lit(0).cast("bigint"))


def _or(bits: Column) -> Column:
    return F.coalesce(F.bit_or(bits), F.lit(0).cast("bigint"))


def advance(
    state: DataFrame, waiting: DataFrame, state_day: When | None, sessions: DataFrame, profiles: DataFrame, day: When
) -> tuple[DataFrame, DataFrame]:
    """State and waiting player-days of ``day``, from those of ``state_day``, the sessions and the new or changed profiles.

    ``sessions`` are those of the days since, and any that come late; rows that the state already holds change
    nothing. Sessions after ``day`` are left for the run of their day. A profile given again replaces the last
    activity if its own is later; the registration that is known first stays.
    """
    to = as_date(day)
    gone = (to - as_date(state_day)).days if state_day is not None else 0
    if gone < 0:
        raise ValueError(f"the state is of {state_day}, after {day}")
    kept = state.withColumns({
        c: F.call_function("shiftleft", F.col(c), F.lit(gone)) if gone < BITS else F.lit(0).cast("bigint") for c in ("active", "at_midnight")
    })
    new = session_days(sessions.where(F.col("start_time") < ts_lit(to + dt.timedelta(days=1)))).drop("sessions")
    people = profiles.where(F.col("player_id").isNotNull() & F.col("registration_date").isNotNull()).select(
        "player_id", "registration_date", "last_active_date"
    )
    sides = [kept, waiting, new, people]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    rows = stacked.withColumn("joined", F.min("registration_date").over(Window.partitionBy("player_id")))
    date = F.col("activity_date")
    on_day = F.when(date.isNotNull(), _bit(date, to)).otherwise(F.col("active"))
    midnight = F.when(F.col("first_start") == date.cast("timestamp_ntz"), _bit(date, to)).otherwise(F.col("at_midnight"))
    hits = {n: F.coalesce(session_in_day_window(n, registered="joined"), F.col(f"day_{n}"), F.lit(False)) for n in RETENTION_DAYS}
    moved = rows.groupBy("player_id").agg(
        F.min("registration_date").alias("registration_date"),
        F.max("last_active_date").alias("last_active_date"),
        F.max(F.coalesce(date, "last_session")).alias("last_session"),
        _or(on_day).alias("active"),
        _or(midnight).alias("at_midnight"),
        *[F.bool_or(hit).alias(f"day_{n}") for n, hit in hits.items()],
    )
    oldest = date_lit(to - dt.timedelta(days=WAITING_DAYS))
    still = rows.where(date.isNotNull() & F.col("joined").isNull() & (date >= oldest))
    still = still.groupBy("player_id", "activity_date").agg(F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"))
    return moved, still


def _since(day: dt.date, first: dt.date) -> int:
    """A mask of the days from ``first`` to ``day``."""
    return (1 << ((day - first).days + 1)) - 1


def state_kpis(state: DataFrame, day: When, churn_lookback: int = CHURN_LOOKBACK, inclusive_week_end: bool = False) -> DataFrame:
    """The KPI row of the state's ``day``: that of :func:`kpi.kpi_series` over all sessions the state has seen."""
    to = as_date(day)
    monday, first = to - dt.timedelta(days=to.weekday()), to.replace(day=1)
    week = F.col("active").bitwiseAND(_since(to, monday))
    if to.weekday() == 6 and not inclusive_week_end:
        # the week ends at Sunday's midnight
        week = week.bitwiseAND(~1).bitwiseOR(F.col("at_midnight").bitwiseAND(1))
    registration, cohort = F.col("registration_date"), F.to_date("registration_date")
    due = date_lit(to - dt.timedelta(days=churn_lookback))
    registered = registration <= ts_lit(to)
    silent = F.col("last_session").isNull() | (F.col("last_session") < due)
    churned = registered & silent & (F.to_date("last_active_date") < due)
    trailing = cohort.between(date_lit(to - dt.timedelta(days=COHORT_DAYS)), date_lit(to - dt.timedelta(days=1)))

    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    def ratio(some: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(some) / F.col(whole)).otherwise(F.lit(0.0))

    sums = state.agg(
        count(F.col("active").bitwiseAND(1) != 0).alias("dau"),
        count(week != 0).alias("wau"),
        count(F.col("active").bitwiseAND(_since(to, first)) != 0).alias("mau"),
        count(churned).alias("churned"),
        count(registered).alias("registered"),
        count(cohort == date_lit(to)).alias("new_registrations"),
        count(trailing).alias("cohort_size"),
        *[count(trailing & F.col(f"day_{n}")).alias(f"retained_{n}") for n in RETENTION_DAYS],
    )
    columns = {"churn_rate": ratio("churned", "registered"), "total_active_players": F.col("dau")}
    columns |= {f"day_{n}_retention": ratio(f"retained_{n}", "cohort_size") for n in RETENTION_DAYS}
    return sums.select(date_lit(to).alias("metric_date"), *[columns.get(m, F.col(m)).alias(m) for m in STORED])
