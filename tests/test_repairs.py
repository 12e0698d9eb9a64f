"""Behaviour that holds whatever is read later, and however often a job runs."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberline import schemas
from emberline.functions.text import fixed, percent
from emberline.operators import kpi, quality
from emberline.sources import readers, sinks
from tests.conftest import at

PROFILE = {
    "registration_date": "2024-01-01T00:00:00", "last_active_date": "2024-01-05T00:00:00", "total_sessions": 3, "total_playtime_minutes": 30,
    "highest_level_reached": 4, "total_purchases": 1.5, "churn_risk_score": 0.5, "churn_prediction_date": "2024-01-06T00:00:00",
}


NOW = at("2024-01-30T00:00:00")


def _lines(tmp_path, rows):
    path = tmp_path / "profiles.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def test_a_bad_value_without_a_rule_counts_for_every_reader(spark, tmp_path):
    rows = [PROFILE | {"player_id": f"p{i}"} for i in range(19)] + [PROFILE | {"player_id": "bad", "age": "old"}]
    path = _lines(tmp_path, rows)
    array = tmp_path / "array.json"
    array.write_text(json.dumps(rows))
    ways = [
        readers.load_profiles(spark, path), readers.load_profiles(spark, path, landing=str(tmp_path / "landed")),
        readers.load_profiles(spark, str(array), array_file=True),
    ]
    for loaded in ways:
        assert loaded.bad_share == 0.05
        for columns in (["player_id"], ["total_sessions"], loaded.clean.columns):
            assert loaded.clean.select(*columns).count() == 19
        assert [r.player_id for r in loaded.clean.select("player_id").where("player_id = 'bad'").collect()] == []
        assert [r.reasons for r in loaded.quarantine.collect()] == [["corrupt_record"]]
    with pytest.raises(readers.LoadError, match="corrupt_record"):
        readers.load_profiles(spark, _lines(tmp_path, rows[-3:]))


def test_a_file_that_is_no_array_is_a_bad_record(spark, tmp_path):
    (tmp_path / "broken.json").write_text('[{"player_id": "a"')
    with pytest.raises(readers.LoadError, match="corrupt_record"):
        readers.load_profiles(spark, str(tmp_path / "broken.json"), array_file=True)


def test_optional_profile_fields_stay(spark, tmp_path):
    path = _lines(tmp_path, [PROFILE | {"player_id": "a", "age": 30, "location": "DE", "first_purchase_date": "2024-01-02T10:00:00"}])
    clean = readers.load_profiles(spark, path).clean
    row = clean.first()
    assert (row.age, row.location, row.first_purchase_date, row.gender) == (30, "DE", at("2024-01-02T10:00:00"), None)
    sinks.write_json(clean, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["age"] == 30
    assert set(schemas.PROFILE_EXTRAS.names) <= set(clean.columns)


@pytest.mark.parametrize("field", ["highest_level_reached", "total_purchases", "churn_prediction_date"])
def test_a_profile_without_a_required_field_is_bad(spark, tmp_path, field):
    rows = [PROFILE | {"player_id": "a", field: None}]
    with pytest.raises(readers.LoadError, match="missing_field"):
        readers.load_profiles(spark, _lines(tmp_path, rows))


def test_percent_text_is_that_of_the_exact_value(spark):
    fractions = sorted({a / b for b in range(1, 2001) for a in range(b + 1) if b % 97 == 0 or b in (3, 7, 200, 400, 800, 1000, 2000)})
    values = fractions + [0.0005, 0.00125, 1e-9, 12345.675, 0.125, 0.375, 2.5, 1e12, -0.0625, 2.0**31 + 0.25]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", percent(F.col("v"), 1).alias("p"), fixed(F.col("v"), 2).alias("f")
    )
    wrong = [(r.v, r.p, r.f) for r in rows.collect() if r.v < 2**31 and (r.p, r.f) != (f"{r.v:.1%}", f"{r.v:.2f}")]
    assert not wrong
    assert spark.range(1).select(fixed(F.lit(None).cast("double"), 1).alias("x")).first().x is None


def test_old_sessions_change_no_kpi_and_are_not_read(spark, make, tmp_path):
    days = [dt.datetime(2024, 1, 20) - dt.timedelta(days=7 * i) for i in range(40)]
    profiles = make.P([{"player_id": f"p{i}", "registration_date": d, "last_active_date": d + dt.timedelta(days=i % 9)} for i, d in enumerate(days)])
    sessions = make.S(
        [
            {"session_id": f"{i}-{j}", "player_id": f"p{i}", "start_time": d + dt.timedelta(days=j, hours=j % 24)}
            for i, d in enumerate(days)
            for j in (0, 1, 2, 7, 30, 55)
        ]
    )
    sinks.write_table(sessions, str(tmp_path), "player_sessions")
    stored = readers.read_table(spark, str(tmp_path), "player_sessions")
    first = last = dt.date(2024, 1, 20)
    for metrics in (kpi.STORED, ("dau",), ("churn_rate",), ("day_30_retention",), ("wau", "mau")):
        bounded = kpi.kpi_series(profiles, stored, first, last, metrics)
        # a range this long has a lower bound before the first session, so nothing is left out
        whole = kpi.kpi_series(profiles, stored, dt.date(2022, 1, 1), last, metrics).where(F.col("metric_date") == F.lit(first))
        assert bounded.collect() == whole.collect()
    plan = kpi.key_metrics(profiles, stored, first)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(start_time," in plan
    assert "LessThan(start_time," in kpi.kpi_series(profiles, stored, first, last, ("dau",))._jdf.queryExecution().toString()


def test_duplicates_shuffle_a_digest_only(spark, make):
    events = make.E([{"player_id": None, "event_type": "purchase"}, {"player_id": "purchase", "event_type": None}] * 2)
    found = quality.event_checks(events, "2024-01-01 00:00:00").where("rule_name = 'duplicate_events'").first()
    assert found.value == 0.5
    plan = quality.duplicates(events, "2024-01-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert len(keys) == 1 and not any(name in keys[0] for name in events.columns)


def test_each_behaviour_file_has_its_own_header(spark, tmp_path):
    names = schemas.BEHAVIOR_CSV.names
    (tmp_path / "a.csv").write_text(",".join(names) + '\r\n1,"High, very",2,3,0,5\r\nx,Low,2,3,0,5\n,Low,2,3,0,5\n')
    (tmp_path / "b.csv").write_text("Age," + ",".join(reversed(names)) + "\n30,5,0,3,2,Medium,7\n30,5,0,3.5,two,Medium,8\n")
    loaded = readers.load_behavior_csv(spark, str(tmp_path))
    assert sorted(map(tuple, loaded.clean.collect()), key=str) == [(1, "High, very", 2, 3, 0, 5), (7, "Medium", 2, 3, 0, 5), (None, "Low", 2, 3, 0, 5)]
    bad = {r["line"]: r["reasons"] for r in loaded.quarantine.collect()}
    assert bad == {"x,Low,2,3,0,5": ["bad_PlayerID"], "30,5,0,3.5,two,Medium,8": ["bad_SessionsPerWeek", "bad_AvgSessionDurationMinutes"]}
    assert loaded.bad_share == 0.4
    (tmp_path / "c.csv").write_text("PlayerID,Other\n1,2\n")
    again = readers.load_behavior_csv(spark, str(tmp_path))
    assert [r["reasons"][0] for r in again.quarantine.where("line like '%Other' or line = '1,2'").collect()] == ["file_without_header"] * 2
    with pytest.raises(readers.LoadError, match="no behaviour file"):
        readers.read_behavior_csv(spark, str(tmp_path / "c.csv"))


def test_a_repeated_key_needs_an_order(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    assert sorted(r.v for r in sinks.latest_per_key(rows, ["k"], "at").collect()) == ["b", "c"]
    with pytest.raises(PySparkException, match="without an order"):
        sinks.latest_per_key(rows, ["k"], None).collect()


def test_sql_leaves_no_views(spark):
    rows = spark.range(3)
    spark.range(7).createOrReplaceTempView("mine")
    assert readers.run_sql(spark, "SELECT count(*) AS n FROM {mine} WHERE id >= :least", {"least": 1}, {"mine": rows}).first().n == 2
    assert spark.table("mine").count() == 7
    spark.catalog.dropTempView("mine")


def test_event_suite_scans_once_and_shuffles_digests(spark, make, tmp_path):
    make.E([{"player_id": f"p{i % 7}", "timestamp": NOW, "event_type": "purchase", "purchase_amount": float(i % 5)} for i in range(100)]).write.parquet(
        f"{tmp_path}/events"
    )
    events = spark.read.parquet(f"{tmp_path}/events")
    for build in (lambda: quality.event_checks(events, NOW), lambda: quality.duplicates(events, NOW, exact=True)):
        assert build()._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    repeated = [df.first()["message"] for df in (quality.duplicates(events, NOW), quality.duplicates(events, NOW, exact=True))]
    assert repeated == ["Found 65 duplicate events (65.00%)"] * 2
    summary = quality.profile_summary(events, make.P([{"player_id": "p1"}]), NOW)
    assert summary._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_loads_store_their_quarantine(spark, tmp_path):
    good = [PROFILE | {"player_id": f"p{i}"} for i in range(20)]
    path = _lines(tmp_path, [*good, PROFILE | {"player_id": "old", "age": "old"}])
    loaded = readers.load_profiles(spark, path, landing=str(tmp_path / "landed"))
    assert loaded.clean.count() == 20 and loaded.bad_share == 1 / 21
    assert [r["reasons"] for r in readers.read_quarantine(spark, str(tmp_path / "landed")).collect()] == [["corrupt_record"]]
    assert "FileScan text" not in loaded.clean._jdf.queryExecution().sparkPlan().toString()
    clean = readers.load_profiles(spark, _lines(tmp_path, good), landing=str(tmp_path / "all_good"))
    assert clean.quarantine.count() == 0 and readers.load_profiles(spark, _lines(tmp_path, []), landing=str(tmp_path / "none")).clean.count() == 0


def test_keyed_writes_read_the_partitions_of_the_batch(spark, tmp_path):
    rows = [(f"2024-01-{d:02d}", f"m{d}", d) for d in range(1, 29)]
    history = spark.createDataFrame(rows, "d string, metric_name string, v int").select(
        F.col("d").cast("date").alias("metric_date"), "metric_name", F.col("v").cast("decimal(10,4)").alias("metric_value")
    )
    args = (str(tmp_path), "daily_metrics_history", ["metric_date", "metric_name"], "metric_date")
    sinks.upsert(history, *args, "2024-02-01 00:00:00")
    batch = history.where("metric_date between '2024-01-10' and '2024-01-12'")
    near = sinks.stored_near(batch, str(tmp_path), "daily_metrics_history", "metric_date")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric_date" in plan and len(near.inputFiles()) > 0
    assert near.count() == 3 and sinks.stored_near(batch.limit(0), str(tmp_path), "daily_metrics_history", "metric_date").count() == 0
    sinks.upsert(batch, *args, "2024-02-02 00:00:00")
    sinks.insert_if_absent(batch, *args, "2024-02-03 00:00:00")
    stored = readers.read_table(spark, str(tmp_path), "daily_metrics_history")
    assert stored.count() == 28 and stored.where("updated_at > '2024-02-01'").count() == 3
