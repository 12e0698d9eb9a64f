"""Nulls, empties, gates and writers."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from emberline import schemas
from emberline.functions import columns as col
from emberline.functions.times import elapsed_days, ts_lit
from emberline.ml import churn_model as cm
from emberline.ml import evaluation
from emberline.operators import activity, churn, cohorts, features, funnels, kpi, quality, retention
from emberline.plans.dashboard import dashboard_tables
from emberline.plans.reporting import run_daily_reports
from emberline.sources import readers, sinks
from emberline.sources.storage import work_folder
from tests.conftest import at

NOW = dt.datetime(2024, 2, 1)


def test_empty_inputs_give_empty_results(make):
    P, E, S = make.P([]), make.E([]), make.S([])
    frames = [
        retention.cohort_retention(P, S, "2024-01-01", "2024-01-31"),
        retention.daily_retention(E, P),
        cohorts.cohort_table(E, P),
        cohorts.cohort_performance(E, P),
        cohorts.best_worst_cohorts(E, P),
        cohorts.retention_decline(E, P),
        cohorts.cohort_ltv(E, P),
        cohorts.lifecycle_segments(E, P, NOW),
        activity.level_dropoff(P, S, "2024-01-01", "2024-01-31"),
        activity.daily_player_summary(E),
        funnels.milestone_funnel(E),
        funnels.funnel_summary(funnels.milestone_funnel(E)),
        funnels.level_progression(E),
        churn.risk_boxplot(churn.churn_table(P, NOW)),
        quality.hourly_spike(E),
        quality.daily_volume_drop(E, E),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    rows = kpi.kpi_series(P, S, "2024-01-01", "2024-01-03").collect()
    assert [(r.dau, r.churn_rate, r.day_1_retention) for r in rows] == [(0, 0.0, 0.0)] * 3


def test_players_without_activity(make):
    P = make.P([{"player_id": "a", "registration_date": at("2024-01-01")},
                {"player_id": "b", "registration_date": at("2024-01-02")}])
    E = make.E([{"player_id": "a", "timestamp": at("2024-01-02T05:00:00"), "event_type": "purchase", "purchase_amount": 3.0},
                {"player_id": None, "timestamp": at("2024-01-02"), "event_type": "purchase", "purchase_amount": 9.0},
                {"player_id": "ghost", "timestamp": at("2024-01-02"), "event_type": "purchase", "purchase_amount": 9.0}])
    table = {(r.cohort_date.day, r.day): r.retention_rate for r in cohorts.cohort_table(E, P).collect()}
    assert table == {(1, 1): 1.0, (2, 1): None}
    assert [r.avg_retention for r in cohorts.avg_retention_by_day(E, P).collect()] == [1.0]
    performance = cohorts.cohort_performance(E, P).collect()
    assert [(r.day_1_retention, r.day_7_retention) for r in performance] == [(1.0, 0.0), (None, 0.0)]
    life = {r.player_id: r for r in cohorts.lifecycle_segments(E, P, NOW).collect()}
    assert (life["b"].lifecycle_segment, life["b"].last_activity_date) == ("inactive", None)
    assert life["b"].days_since_last_activity == 30 and life["a"].lifecycle_segment == "dormant"
    value = cohorts.cohort_ltv(E, P).collect()
    assert [(r.cohort_size, r.total_revenue, r.paying_users) for r in value] == [(1, 3.0, 1), (1, 0.0, 0)]
    funnel = cohorts.retention_funnel(E, P).collect()
    assert [r.retention_rate for r in funnel] == [1.0] * 5 and funnel[0].total_players == 2


def test_ltv_with_purchases_of_strangers_only(make):
    P = make.P([{"player_id": "a", "registration_date": at("2024-01-01")}])
    E = make.E([{"player_id": None, "timestamp": NOW, "event_type": "purchase", "purchase_amount": 1.0}])
    assert [(r.cohort_size, r.total_revenue) for r in cohorts.cohort_ltv(E, P).collect()] == [(1, 0.0)]


def test_elapsed_days_floor(spark):
    cases = [("2024-01-01 12:00:00", "2024-01-02 11:59:59", 0), ("2024-01-01 12:00:00", "2024-01-02 12:00:00", 1),
             ("2024-01-02 00:00:00", "2024-01-01 23:00:00", -1), ("2024-03-01 00:00:00", "2024-02-29 00:00:00", -1)]
    for start, end, days in cases:
        assert spark.range(1).select(elapsed_days(ts_lit(start), ts_lit(end))).first()[0] == days


def test_case_chains_send_null_to_the_end(spark):
    row = spark.range(1).select(
        col.behavior_segment(F.lit(None).cast("int"), F.lit(None).cast("int")),
        col.engagement_level(F.lit(None).cast("int"), F.lit(None).cast("double")),
        col.risk_category(F.lit(None).cast("double")),
        col.spend_segment(segment_field="level"),
    )
    assert tuple(row.first()) == ("Minimal Engagement", "new", "low", "all")


def test_funnel_ties_pick_the_first_stage(spark):
    funnel = spark.createDataFrame([("a", 8, 0), ("b", 4, 1), ("c", 2, 2)], "stage string, players long, stage_order int")
    summary = funnels.funnel_summary(funnel).first()
    assert (summary.biggest_dropoff_stage, summary.overall_conversion) == ("b", 0.25)
    flat = spark.createDataFrame([("a", 8, 0), ("b", 8, 1)], "stage string, players long, stage_order int")
    assert funnels.funnel_summary(flat).first().biggest_dropoff_stage == "a"
    assert [r.transition for r in funnels.funnel_transitions(funnel).collect()] == ["a → b", "b → c"]


def _profile(n, **change):
    return {
        "player_id": f"p{n}", "registration_date": "2024-01-01T00:00:00", "last_active_date": "2024-01-05T10:30:00.250000",
        "total_sessions": 3, "total_playtime_minutes": 30, "highest_level_reached": 2, "total_purchases": 1.5,
        "churn_risk_score": 0.2, "churn_prediction_date": "2024-01-06T00:00:00",
    } | change


def _write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_profile_loader_gate(spark, tmp_path):
    rows = [_profile(i) for i in range(19)]
    bad = _profile(99, churn_risk_score=7)
    lines = _write(tmp_path, "ok.json", "\n".join(map(json.dumps, [*rows, bad])))
    loaded = readers.load_profiles(spark, lines)
    assert loaded.clean.count() == 19 and loaded.bad_share == 0.05
    assert loaded.quarantine.first().reasons == ["risk_out_of_range"]
    assert loaded.clean.first().last_active_date == dt.datetime(2024, 1, 5, 10, 30, 0, 250000)
    array = _write(tmp_path, "array.json", json.dumps([*rows, bad]))
    assert readers.load_profiles(spark, array, array_file=True).clean.count() == 19
    landed = readers.load_profiles(spark, lines, landing=str(tmp_path / "landed"))
    assert landed.bad_share == 0.05 and landed.quarantine.first().reasons == ["risk_out_of_range"]
    assert landed.clean.exceptAll(loaded.clean).count() == 0 and landed.clean.count() == 19
    with pytest.raises(readers.LoadError, match="of the profile records are bad"):
        readers.load_profiles(spark, _write(tmp_path, "bad.json", json.dumps(bad)))


def test_broken_json_and_types_are_bad_records(spark, tmp_path):
    rows = [json.dumps(_profile(i)) for i in range(30)]
    rows += ["{broken", json.dumps(_profile(31, registration_date="yesterday"))]
    loaded = readers.load_profiles(spark, _write(tmp_path, "p.json", "\n".join(rows)))
    reasons = sorted(r.reasons[0] for r in loaded.quarantine.collect())
    assert loaded.clean.count() == 30 and reasons == ["corrupt_record", "missing_field"]


def test_event_loader_gates(spark, tmp_path):
    def event(**change):
        return {"player_id": "a", "timestamp": "2024-01-01T00:00:00", "event_type": "purchase", "purchase_amount": 1.0} | change

    good = [event(timestamp=f"2024-01-{d:02d}T00:00:00") for d in range(1, 25)]
    path = _write(tmp_path, "e.json", "\n".join(map(json.dumps, [*good, event(event_type="dance")])))
    assert readers.load_events(spark, path, NOW).clean.count() == 24
    nested = [event(purchase_amount=None, event_data={"amount": 5})]
    with pytest.raises(readers.LoadError, match="of the event records are bad"):
        readers.load_events(spark, _write(tmp_path, "n.json", "\n".join(map(json.dumps, [*good[:5], *nested]))), NOW)
    with pytest.raises(readers.LoadError, match="failed critical checks"):
        readers.load_events(spark, _write(tmp_path, "none.json", ""), NOW)


def test_feature_loader_has_no_tolerance(spark, tmp_path):
    row = {"player_id": "a", "feature_date": "2024-01-01", "days_since_last_session": 9, "sessions_last_7_days": 1,
           "avg_session_duration_minutes": 5.0, "levels_completed_last_week": 0, "purchases_last_30_days": 0.0,
           "social_connections": 1}
    with pytest.raises(readers.LoadError):
        readers.load_churn_features(spark, _write(tmp_path, "f.json", json.dumps(row)))


def test_csv_columns_are_found_by_name(spark, tmp_path):
    text = "Age,PlayerLevel,PlayerID,EngagementLevel,SessionsPerWeek,AvgSessionDurationMinutes,InGamePurchases\n30,7,1,High,3,40,1\n"
    row = readers.read_behavior_csv(spark, _write(tmp_path, "b.csv", text)).first()
    assert (row.PlayerID, row.PlayerLevel, row.EngagementLevel) == (1, 7, "High")


def test_upsert_touches_only_its_dates(spark, tmp_path, make):
    root = str(tmp_path)
    rows = [(dt.date(2024, 1, d), "dau", float(d)) for d in (1, 2)]
    frame = spark.createDataFrame(rows, "metric_date date, metric_name string, metric_value double")
    keys = ["metric_date", "metric_name"]
    args = (root, "daily_metrics_history", keys, "metric_date")
    sinks.upsert(frame, *args, "2024-01-03 00:00:00")
    untouched = {p.name for p in (tmp_path / "daily_metrics_history" / "metric_date=2024-01-01").glob("*.parquet")}
    changed = frame.where("metric_date = '2024-01-02'").withColumn("metric_value", F.lit(7.5))
    twice = changed.unionByName(changed.withColumn("metric_value", F.lit(9.5)))
    sinks.upsert(twice, *args, "2024-01-04 00:00:00", order="metric_value")
    added = changed.withColumn("metric_name", F.lit("wau"))
    sinks.upsert(added, *args, "2024-01-05 00:00:00")
    stored = {(r.metric_date.day, r.metric_name): r for r in readers.read_table(spark, root, "daily_metrics_history").collect()}
    assert {k: float(r.metric_value) for k, r in stored.items()} == {(1, "dau"): 1.0, (2, "dau"): 9.5, (2, "wau"): 7.5}
    assert stored[2, "dau"].created_at.day == 3 and stored[2, "dau"].updated_at.day == 4
    assert untouched == {p.name for p in (tmp_path / "daily_metrics_history" / "metric_date=2024-01-01").glob("*.parquet")}


def test_missing_tables_are_empty(spark, tmp_path):
    tables = readers.read_tables(spark, str(tmp_path))
    assert set(tables) == set(schemas.TABLES) and tables["daily_reports"].count() == 0


def test_report_job_can_run_again(spark, tmp_path, make):
    P = make.P([{"player_id": "a", "registration_date": at("2024-01-01"), "last_active_date": at("2024-01-03")}])
    S = make.S([{"player_id": "a", "start_time": at("2024-01-02T01:00:00")}])
    for _ in range(2):
        reports = run_daily_reports(P, S, str(tmp_path), "2024-01-02", "2024-01-03", "2024-01-04 06:00:00")
    rows = {r.report_date.day: json.loads(r.report_data) for r in reports.collect()}
    assert set(rows) == {2, 3} and rows[2]["key_metrics"]["dau"] == 1
    assert rows[2]["alerts"][0]["alert_id"] == "low_dau_2024-01-02"
    assert "- Daily Active Users: 1" in rows[2]["summary"]
    assert rows[2]["cohort_analysis"][0]["day_1_retention"] == 1.0
    history = readers.read_table(spark, str(tmp_path), "daily_metrics_history")
    assert history.count() == 18


def test_work_folder_is_shared_and_ends_with_the_session(spark, tmp_path, monkeypatch):
    """The settings are fixed when a session starts, hence the stand-in for one."""

    class Session:
        conf = {"spark.checkpoint.dir": f"file://{tmp_path}/checkpoints/", "spark.master": "spark://host:7077"}
        sparkContext = spark.sparkContext

    folder = work_folder(Session())
    assert folder.startswith(f"file://{tmp_path}/checkpoints/work-") and (tmp_path / "checkpoints").exists()
    Session.conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Session())
    Session.conf = {"spark.master": "local[4]"}
    assert work_folder(Session()).startswith("/tmp/run-")


def test_dashboard_tables(make):
    P = make.P([{"player_id": "a", "registration_date": at("2024-01-01")}])
    E = make.E([{"player_id": "a", "timestamp": at("2024-01-02"), "event_type": "level_complete", "level": 5}])
    tables = dashboard_tables(P, E, NOW)
    assert {n: t.count() for n, t in tables.items()} == {
        "cohort_data": 1, "engagement_data": 1, "churn_data": 1, "funnel_data": 7, "level_data": 1, "cohort_funnel_data": 1,
    }
    assert tables["cohort_funnel_data"].first().level_5_complete


def test_features_ignore_the_future(make):
    P = make.P([{"player_id": "a", "registration_date": at("2024-01-01"), "last_active_date": at("2024-01-20")}])
    S = make.S([{"player_id": "a", "start_time": t, "duration_minutes": m}
                for t, m in ((at("2024-01-30"), 10), (at("2024-01-10"), 30), (at("2024-02-03"), 500))])
    row = features.derive_churn_features(P, S, make.E([]), NOW).first()
    assert (row.days_since_last_session, row.sessions_last_7_days, row.avg_session_duration_minutes) == (2, 1, 20.0)


def _labelled(make, n):
    """Churn follows idleness closely but not perfectly."""
    rows = [
        {"player_id": f"p{i}", "feature_date": NOW.date(), "days_since_last_session": (i * 7) % 30,
         "sessions_last_7_days": 0 if (i * 7) % 30 > 7 else 1 + i % 9, "avg_session_duration_minutes": 5.0 + i % 60,
         "levels_completed_last_week": i % 11, "purchases_last_30_days": float(i % 5), "social_connections": i % 40}
        for i in range(n)
    ]
    features_frame = make.CF(rows)
    noisy = (F.col("days_since_last_session") > 14) != (F.col("social_connections") == 3)
    return features_frame, features_frame.select("player_id", noisy.alias("churned"))


def test_model_quality_and_storage(spark, make, tmp_path):
    X, y = _labelled(make, 400)
    model = cm.train_models(cm.training_data(X, y), cv_folds=2, grids={"random_forest": {"numTrees": [10], "maxDepth": [3, 5]}})
    scores = model.metrics["random_forest"]
    assert scores["accuracy"] >= 0.8 and scores["roc_auc"] >= 0.7
    assert scores["best_params"]["maxDepth"] in (3, 5)
    model.save(str(tmp_path / "m"))
    again = cm.ChurnModel.load(str(tmp_path / "m"))
    assert again.predict(X).orderBy("player_id").collect() == model.predict(X).orderBy("player_id").collect()
    assert model.predict_proba(make.CF([])).count() == 0
    folds = cm.cross_validate(again, cm.training_data(X, y), 2)
    assert folds["accuracy_mean"] >= 0.8 and folds["roc_auc_std"] >= 0


def test_few_partitions_of_a_fit_do_not_gather_what_comes_before(make, monkeypatch, tmp_path):
    """Sorting and ranking the folds keeps its own tasks, whatever the number of partitions to fit on."""
    X, y = _labelled(make, 400)
    data, folds, folder = cm.training_data(X, y), cm.stratified_folds, str(tmp_path)

    @F.udf("int")
    def noted(fold):
        at = TaskContext.get()
        open(f"{folder}/{at.stageId()}-{at.partitionId()}", "w").close()
        return fold

    monkeypatch.setattr(cm, "stratified_folds", lambda *a: folds(*a).repartition(4, "player_id").withColumn("fold", noted("fold")))
    model = cm.train_models(data, cv_folds=2, grids={"random_forest": cm.POINT_GRIDS["random_forest"]})
    trained = {f.name for f in tmp_path.iterdir()}
    cm.cross_validate(model, data, 2)
    validated = {f.name for f in tmp_path.iterdir()} - trained
    assert len({f.split("-")[1] for f in trained}) == len({f.split("-")[1] for f in validated}) == 4


def test_training_needs_rows(make):
    X, y = _labelled(make, 8)
    with pytest.raises(ValueError, match="10 players or more"):
        cm.train_models(cm.training_data(X, y))
    with pytest.raises(ValueError, match="exactly one label"):
        cm.training_data(X, y.limit(3))
    with pytest.raises(ValueError, match="nothing to train"):
        cm.training_data(make.CF([]), y)


def test_auc_with_ties(spark):
    rows = [(1.0, 0.9, 1.0), (1.0, 0.5, 1.0), (0.0, 0.5, 1.0), (0.0, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "label double, probability double, prediction double")
    row = evaluation.evaluate_predictions(df).first()
    assert row.roc_auc == pytest.approx(0.875) and row.accuracy == 0.75
    assert not evaluation.accuracy_gate(df).first().meets_threshold
