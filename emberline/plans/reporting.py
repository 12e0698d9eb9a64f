"""The daily jobs: KPIs from a stored state, and the report with its alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.times import When, as_date, ts_lit
from emberline.operators import daily_state, kpi
from emberline.sources import sinks
from emberline.sources.readers import read_table


def run_daily_reports(
    profiles: DataFrame, sessions: DataFrame, root: str, start: When, end: When, as_of: When
) -> DataFrame:
    """Store KPIs, alerts and reports of [start, end] under ``root``; returns the stored reports.

    The KPI rows go to the metric history first and everything after reads the
    stored history, so the event-sized work runs once. Rates there have four
    decimals; the reports quote the exact values.
    """
    spark = profiles.sparkSession
    kpis = kpi.kpi_series(profiles, sessions, start, end).persist()  # one row per date
    try:
        sinks.upsert_metrics(kpis, root, as_of)
        history = read_table(spark, root, "daily_metrics_history")
        sinks.append_alerts(kpi.alerts(kpis, history, as_of), root, as_of)
        sinks.upsert_reports(kpi.daily_reports(profiles, sessions, start, end, history, kpis), root, as_of)
    finally:
        kpis.unpersist()
    return read_table(spark, root, "daily_reports")


def _state_folders(root: str, day: dt.date) -> list[str]:
    return [f"{root.rstrip('/')}/{name}/day={day}" for name in ("player_state", "waiting_days")]


def run_daily_state(
    profiles: DataFrame, sessions: DataFrame, root: str, day: When, state_day: When | None = None, late: DataFrame | None = None
) -> DataFrame:
    """Move the player state under ``root`` from ``state_day`` on to ``day``; returns the KPI row of ``day``.

    Of ``sessions`` only those after ``state_day`` are read, a range that reaches the scan; without a ``state_day``
    the state is built from all up to ``day``. ``late`` are sessions of earlier days that have come since. ``profiles``
    need hold only those that are new or have changed. A day's state is a folder of its own, so a run that is
    repeated starts from the same state and gives the same result.
    """
    spark, to = profiles.sparkSession, as_date(day)
    if state_day is not None and as_date(state_day) >= to:
        raise ValueError(f"the state of {state_day} is not before {day}")
    fresh = sessions.where(F.col("start_time") < ts_lit(to + dt.timedelta(days=1)))
    if state_day is None:
        before = daily_state.empty_state(spark)
    else:
        fresh = fresh.where(F.col("start_time") >= ts_lit(as_date(state_day) + dt.timedelta(days=1)))
        schemas = (daily_state.STATE, daily_state.WAITING)
        before = [spark.read.schema(s).parquet(f) for s, f in zip(schemas, _state_folders(root, as_date(state_day)), strict=True)]
    if late is not None:
        fresh = fresh.select("player_id", "start_time").unionByName(late.select("player_id", "start_time"))
    after = daily_state.advance(*before, state_day, fresh, profiles, day)
    for table, folder in zip(after, _state_folders(root, to), strict=True):
        table.write.mode("overwrite").parquet(folder)
    state = spark.read.schema(daily_state.STATE).parquet(_state_folders(root, to)[0])
    return daily_state.state_kpis(state, day)
