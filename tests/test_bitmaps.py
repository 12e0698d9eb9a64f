"""The bitmap index against the operators that shuffle player-days."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import activity, bitmaps, cohorts, retention
from tests.conftest import at


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(6)
    begin = at("2024-01-29")
    joined = {f"p{n}": begin + dt.timedelta(hours=rng.randrange(24 * 20)) for n in range(70)}
    people = [(p, d, rng.randrange(30), rng.randrange(2000), rng.choice([0.0, 5.0, 20.0, 80.0])) for p, d in joined.items()]
    people += [("gone", None, 1, 1, 0.0), (None, begin, 1, 1, 0.0)]
    who = [*joined, "orphan1", "orphan2", None]
    when = lambda: begin + (dt.timedelta(hours=rng.randrange(24 * 50)) if rng.random() < 0.7 else dt.timedelta(days=rng.randrange(50)))
    visits = [(rng.choice(who), when() if n % 50 else None) for n in range(1500)] + [("p1", begin + dt.timedelta(hours=n)) for n in range(600)]
    P = spark.createDataFrame(people, "player_id string, registration_date timestamp_ntz, total_sessions int, total_playtime_minutes int, total_purchases double")
    S = spark.createDataFrame(visits[::2], "player_id string, start_time timestamp_ntz")
    E = spark.createDataFrame(visits[1::2], "player_id string, timestamp timestamp_ntz")
    return P.cache(), S.repartition(5).cache(), E.repartition(5).cache()


@pytest.fixture(scope="module")
def index(spark, world, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "bits")
    bitmaps.write_index(bitmaps.build_index(*world), path)
    return spark.read.parquet(path)


def _rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


QUESTIONS = {
    "dau": lambda P, S, E, i: (activity.dau(S, "2024-02-01", "2024-02-20"), bitmaps.dau(i, "2024-02-01", "2024-02-20")),
    "wau": lambda P, S, E, i: (activity.wau(S, "2024-02-01", "2024-02-18"), bitmaps.wau(i, "2024-02-01", "2024-02-18")),
    "wau_whole": lambda P, S, E, i: (
        activity.wau(S, "2024-02-01", "2024-02-18", inclusive_end=True), bitmaps.wau(i, "2024-02-01", "2024-02-18", inclusive_end=True),
    ),
    "elapsed": lambda P, S, E, i: (
        retention.cohort_retention(P, S, "2024-01-30", "2024-02-10", "x"), bitmaps.cohort_retention(i, "2024-01-30", "2024-02-10", "x"),
    ),
    "elapsed_segment": lambda P, S, E, i: (
        retention.retention_by_segment(P, S, "2024-01-01", "2024-03-10", "Medium Engagement"),
        bitmaps.cohort_retention(i, "2024-01-01", "2024-03-10", behavior="Medium Engagement"),
    ),
    "daily": lambda P, S, E, i: (retention.daily_retention(E, P), bitmaps.daily_retention(i)),
    "weekly": lambda P, S, E, i: (retention.weekly_retention(E, P), bitmaps.weekly_retention(i)),
    "monthly": lambda P, S, E, i: (retention.monthly_retention(E, P), bitmaps.monthly_retention(i)),
    "segments": lambda P, S, E, i: (retention.segment_retention(E, P), bitmaps.segment_retention(i)),
    "table": lambda P, S, E, i: (cohorts.cohort_table(E, P), bitmaps.cohort_table(i)),
}


@pytest.mark.parametrize("question", QUESTIONS)
def test_equals_the_shuffled_answer(world, index, question):
    plain, united = QUESTIONS[question](*world, index)
    assert plain.schema == united.schema or [f.name for f in plain.schema] == [f.name for f in united.schema]
    assert _rows(plain) == _rows(united) != []


def test_numbers_are_dense_and_cohorts_stand_together(spark, world):
    P, S, _ = world
    people = bitmaps.registrations(P, "registration_date", F.lit("b").alias("behavior"), F.lit("s").alias("spend"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = bitmaps.number_players(people, S.where("player_id is not null")).orderBy("number").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["number"] for r in rows] == list(range(1, len(rows) + 1))
    dates = [r["cohort_date"] for r in rows if r["cohort_date"]]
    assert dates == sorted(dates)


def test_each_fact_table_is_scanned_once(spark, world, tmp_path, monkeypatch):
    P, S, E = world
    plans = []
    staged = bitmaps._staged
    monkeypatch.setattr(bitmaps, "_staged", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), staged(df))[1])
    S.write.parquet(f"{tmp_path}/s")
    E.write.parquet(f"{tmp_path}/e")
    built = bitmaps.build_index(P, spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/e"))
    plans.append(built._jdf.queryExecution().sparkPlan().toString())
    assert sum(p.count(f"{tmp_path}/s") for p in plans) == 1 and sum(p.count(f"{tmp_path}/e") for p in plans) == 1


def test_no_rows(world):
    P, S, E = world
    index = bitmaps.build_index(P.limit(0), S.limit(0), E.limit(0))
    assert index.count() == 0 and bitmaps.dau(index, "2024-02-01", "2024-02-20").count() == 0
    assert bitmaps.daily_retention(bitmaps.build_index(P, S, E.limit(0))).count() > 0
