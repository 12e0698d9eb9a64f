"""Worked numbers: small inputs whose results are known."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from emberline.functions import columns as col
from emberline.functions import rules
from emberline.operators import jobs, kpi, quality
from tests.conftest import at

NOW = dt.datetime(2024, 6, 1)


def checks_by_rule(df):
    return {r.rule_name: r for r in df.collect()}


def test_missing_values_share(make):
    events = make.E(
        [
            {"player_id": "p1", "timestamp": at("2024-01-01"), "event_type": "purchase"},
            {"player_id": None, "timestamp": at("2024-01-02"), "event_type": None},
            {"player_id": "p3", "timestamp": at("2024-01-03"), "event_type": "purchase"},
            {"player_id": "p4", "timestamp": at("2024-01-04"), "event_type": "purchase"},
        ]
    )
    found = checks_by_rule(quality.missing_values(events, NOW))
    assert found["missing_player_ids"].value == 0.25 and not found["missing_player_ids"].passed
    assert found["missing_event_types"].value == 0.25
    assert found["missing_timestamps"].passed
    assert found["missing_player_ids"].message == "Found 1 missing player_id values (25.00%)"


def test_future_and_duplicates(make):
    row = {"player_id": "p1", "timestamp": at("2024-01-01"), "event_type": "purchase"}
    late = row | {"timestamp": at("2024-07-01")}
    found = checks_by_rule(quality.event_checks(make.E([row, row, row | {"player_id": "p2"}, late]), NOW))
    assert found["future_timestamps"].value == 0.25 and not found["future_timestamps"].passed
    assert found["duplicate_events"].value == 0.25
    assert found["invalid_session_durations"].passed and found["invalid_session_durations"].value == 0.0


def test_null_duration_counts_in_the_denominator(make):
    base = {"player_id": "p", "timestamp": at("2024-01-01"), "event_type": "session_start"}
    events = make.E([base | {"session_duration": d} for d in (None, 5.0, -1.0, 90000.0)])
    assert checks_by_rule(quality.session_durations(events, NOW))["invalid_session_durations"].value == 0.5


def test_empty_events_yield_one_row(make):
    rows = quality.event_checks(make.E([]), NOW).collect()
    assert [(r.rule_name, r.severity, r.passed) for r in rows] == [("empty_dataset", "critical", False)]


def test_report_lists_all_severities(make):
    report = quality.quality_report(quality.event_checks(make.E([]), NOW)).first()
    assert (report.total_checks, report.failed_checks, report.critical_failed, report.info_failed) == (1, 1, 1, 0)
    assert report.recommendations == [quality.RECOMMEND_CRITICAL]


def test_config_is_checked_and_copied():
    with pytest.raises(KeyError):
        quality.DEFAULTS.with_threshold("nonsense", 1.0)
    assert quality.DEFAULTS.with_enabled("orphaned_events", False).active("orphaned_events") is None
    assert quality.DEFAULTS.active("orphaned_events").threshold == 0.05


def test_null_player_is_an_orphan(make):
    events = make.E([{"player_id": p, "timestamp": NOW, "event_type": "purchase"} for p in ("a", "a", None, "x")])
    row = quality.consistency_checks(events, make.P([{"player_id": "a", "registration_date": NOW}])).first()
    assert row.value == 0.5 and row.details == '{"orphaned_player_count":2}'


@pytest.mark.parametrize(
    ("metric", "current", "baseline", "change", "significant", "breached"),
    [
        ("dau", 750.0, 1000.0, -25.0, True, True),
        ("churn_rate", 0.20, 0.15, 33.3333, True, True),
        ("new_registrations", 1.0, 100.0, -99.0, True, False),
        ("mau", 95.0, 100.0, -5.0, False, False),
        ("wau", 10.0, 0.0, 0.0, False, False),
    ],
)
def test_baseline_comparison(spark, make, metric, current, baseline, change, significant, breached):
    day = dt.date(2024, 3, 31)
    values = {m: 0.0 for m in kpi.STORED} | {metric: current}
    kpis = spark.createDataFrame([(day, *values.values())], ["metric_date", *values])
    history = make.H(
        [
            {"metric_date": day - dt.timedelta(days=n), "metric_name": metric, "metric_value": Decimal(str(baseline))}
            for n in (1, 30)
        ]
        + [  # outside the 30 days, and the day itself: both ignored
            {"metric_date": day - dt.timedelta(days=n), "metric_name": metric, "metric_value": Decimal("9999")}
            for n in (0, 31)
        ]
    )
    row = kpi.baseline_comparison(kpis, history).where(F.col("metric_name") == metric).first()
    assert row.baseline_value == pytest.approx(baseline)
    assert row.percentage_change == pytest.approx(change, abs=1e-3)
    assert (row.is_significant, row.threshold_breached) == (significant, breached)


@pytest.mark.parametrize(
    ("change", "severity"), [(-60.0, "critical"), (50.0, "critical"), (-30.0, "high"), (-20.0, "medium"), (-19.9, "low")]
)
def test_alert_severity(spark, change, severity):
    assert spark.range(1).select(kpi.alert_severity(F.lit(change))).first()[0] == severity


def test_alert_message(spark):
    text = spark.range(1).select(
        kpi.alert_message(F.lit("day_1_retention"), F.lit(-25.0), F.lit(1000.0), F.lit(750.0))
    )
    assert text.first()[0] == "Day 1 Retention has decreased by 25.0% from baseline (1000.00 to 750.00)"


def test_weighted_retention(spark, make):
    """Cohorts of 2 and 3 players with 1 and 3 players back on day 1: weighted 4 of 5."""
    people = [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 2)]
    P = make.P([{"player_id": p, "registration_date": dt.datetime(2024, 1, d)} for p, d in people])
    back = ["a", "c", "d", "e"]
    S = make.S(
        [{"player_id": p, "start_time": dt.datetime(2024, 1, d + 1, 5)} for p, d in people if p in back]
    )
    row = kpi.kpi_series(P, S, "2024-01-10", "2024-01-10", ("day_1_retention",)).first()
    assert row.day_1_retention == pytest.approx(0.8)


def test_failed_job_statistics(make):
    reasons = ("processing_error", "timeout_error", "data_validation_error")
    rows = [
        {"job_id": str(i), "job_type": t, "failure_reason": r, "failure_timestamp": dt.datetime(2024, 1, i + 1),
         "retry_count": i, "max_retries": 2, "next_retry_time": dt.datetime(2024, 1, i + 2)}
        for i, (t, r) in enumerate(zip(("type_a", "type_a", "type_b"), reasons))
    ]
    stats = {(r.dimension, r.value): r for r in jobs.failed_jobs_stats(make.FJ(rows), "2024-01-02").collect()}
    assert stats["total", "all"].jobs == 3 and stats["total", "all"].exhausted_retries == 1
    assert stats["total", "all"].ready_for_retry == 1
    assert stats["job_type", "type_a"].jobs == 2 and stats["job_type", "type_b"].jobs == 1
    assert all(stats["failure_reason", r].jobs == 1 for r in reasons)


@pytest.mark.parametrize(
    ("message", "reason"),
    [
        ("Data VALIDATION failed on connection", "data_validation_error"),
        ("lost Connection", "database_connection_error"),
        ("Database is down", "database_connection_error"),
        ("boom", "processing_error"),
    ],
)
def test_failure_class(spark, message, reason):
    assert spark.range(1).select(col.failure_class(F.lit(message))).first()[0] == reason


def test_segment_names(spark):
    rows = spark.createDataFrame([(" VIP ",), ("Whale",), ("core",), ("nobody",), (None,)], "s string")
    assert [r[0] for r in rows.select(col.normalize_segment("s")).collect()] == ["premium", "premium", "core", None, None]


def test_engagement_and_flag(make):
    features = make.CF(
        [
            {"player_id": "idle", "days_since_last_session": 10, "sessions_last_7_days": 0,
             "avg_session_duration_minutes": 4.0, "levels_completed_last_week": 0, "purchases_last_30_days": 0.0},
            {"player_id": "keen", "days_since_last_session": 0, "sessions_last_7_days": 14,
             "avg_session_duration_minutes": 60.0, "levels_completed_last_week": 20, "purchases_last_30_days": 5.0},
        ]
    )
    rows = {r.player_id: r for r in features.select("player_id", col.high_churn_flag().alias("f"),
            col.high_churn_points().alias("n"), col.engagement_score().alias("e")).collect()}
    assert (rows["idle"].f, rows["idle"].n, rows["idle"].e) == (True, 6, 0.0)
    assert (rows["keen"].f, rows["keen"].n, rows["keen"].e) == (False, 0, 1.0)


def test_profile_rules_split(make):
    good = {"player_id": "a", "registration_date": at("2024-01-01"), "last_active_date": at("2024-01-02")}
    bad = good | {"player_id": "b", "churn_risk_score": 1.5, "total_sessions": -1, "last_active_date": at("2023-12-31")}
    clean, rest = rules.split(rules.with_reasons(make.P([good, bad]), rules.profile_rules()))
    assert [r.player_id for r in clean.collect()] == ["a"]
    assert rest.first().reasons == ["risk_out_of_range", "negative_sessions", "registered_after_last_active"]
