"""Daily KPIs from the stored state against the full series over what has arrived."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import daily_state, kpi
from emberline.plans.reporting import run_daily_state
from tests.conftest import at

FIRST = dt.date(2024, 2, 20)


@pytest.fixture(scope="module")
def world(spark):
    """Profiles and sessions of eleven weeks, with the day each arrives: some sessions late, some profiles weeks after."""
    rng, people, visits = random.Random(11), [], []
    begin = at("2024-01-01")
    for n in range(60):
        joined = begin + dt.timedelta(hours=rng.randrange(24 * 70)) if n % 6 else begin + dt.timedelta(days=rng.randrange(70))
        seen = joined + dt.timedelta(hours=rng.randrange(24 * 30))
        people.append((f"p{n}", joined, seen, joined.date() + dt.timedelta(days=rng.choice([0, 0, 0, 9, 40]))))
    people.append(("never", at("2024-02-25"), None, dt.date(2024, 2, 25)))
    for n in range(1500):
        start = begin + dt.timedelta(minutes=rng.randrange(60 * 24 * 75)) if n % 4 else begin + dt.timedelta(days=rng.randrange(75))
        visits.append((f"p{rng.randrange(66)}", start, start.date() + dt.timedelta(days=rng.choice([0, 0, 0, 0, 1, 3, 20]))))
    for n in range(40):  # one player on both sides of the bounds of each retention window
        who, joined, _, _ = people[n]
        for k in (1, 7, 30):
            visits.append((who, joined + dt.timedelta(days=k, seconds=rng.choice([-1, 0, 86400, 86401])), joined.date() + dt.timedelta(days=k + 1)))
    P = spark.createDataFrame(people, "player_id string, registration_date timestamp_ntz, last_active_date timestamp_ntz, came date")
    S = spark.createDataFrame(visits, "player_id string, start_time timestamp_ntz, came date")
    return P.cache(), S.where(F.col("came") >= F.to_date("start_time")).cache()


def _same(row, other):
    a, b = row.asDict(), other.asDict()
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) if isinstance(a[k], float) else a[k] == b[k] for k in a), (a, b)


def test_daily_runs_equal_the_series(world, tmp_path):
    P, S = world
    before = None
    for n in range(14):  # across a month's end, with a gap of two days
        if n == 5 or n == 6:
            continue
        day = FIRST + dt.timedelta(days=n)
        came = F.col("came") <= day if before is None else (F.col("came") <= day) & (F.col("came") > before)
        arrived = S.where(came)
        own = F.to_date("start_time") > before if before else F.lit(True)
        found = run_daily_state(P.where(came), arrived.where(own), str(tmp_path), day, before, arrived.where(~own))
        full = kpi.kpi_series(P.where(F.col("came") <= day), S.where(F.col("came") <= day), day, day)
        _same(found.first(), full.first())
        before = day


def test_a_run_can_be_repeated_and_sessions_given_twice(spark, world, tmp_path):
    P, S = world
    arrived = S.where(F.col("came") <= FIRST)
    once = run_daily_state(P, arrived, str(tmp_path), FIRST).first()
    next_day = FIRST + dt.timedelta(days=1)
    runs = [run_daily_state(P.limit(0), S, str(tmp_path), next_day, FIRST, arrived).first() for _ in range(2)]
    assert runs[0] == runs[1]
    stored = [spark.read.parquet(f"{tmp_path}/{name}/day={FIRST}") for name in ("player_state", "waiting_days")]
    _same(daily_state.state_kpis(daily_state.advance(*stored, FIRST, arrived, P, FIRST)[0], FIRST).first(), once)
    with pytest.raises(ValueError):
        run_daily_state(P, arrived, str(tmp_path), FIRST, FIRST)


def test_plan_reads_one_day_of_sessions(spark, world, tmp_path):
    P, S = world
    S.write.parquet(f"{tmp_path}/sessions")
    run_daily_state(P, S, str(tmp_path), FIRST)
    stored = spark.read.parquet(f"{tmp_path}/sessions")
    day = FIRST + dt.timedelta(days=1)
    fresh = stored.where((F.col("start_time") >= F.lit(str(day)).cast("timestamp_ntz")))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    state, _ = daily_state.advance(*daily_state.empty_state(spark), FIRST, fresh, P.limit(0), day)
    plan = state._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"GreaterThanOrEqual(start_time,{day}T00:00" in plan and f"LessThan(start_time,{day + dt.timedelta(days=1)}T00:00" in plan


def test_edges(spark):
    state, waiting = daily_state.empty_state(spark)
    empty = spark.createDataFrame([], "player_id string, start_time timestamp_ntz")
    nobody = spark.createDataFrame([], "player_id string, registration_date timestamp_ntz, last_active_date timestamp_ntz")
    state, waiting = daily_state.advance(state, waiting, None, empty, nobody, FIRST)
    row = daily_state.state_kpis(state, FIRST).first()
    assert row.dau == 0 and row.churn_rate == 0.0 and row.day_30_retention == 0.0
    with pytest.raises(ValueError):
        daily_state.advance(state, waiting, FIRST + dt.timedelta(days=1), empty, nobody, FIRST)
    odd = spark.createDataFrame([(None, at("2024-02-20")), ("a", None), ("a", at("2024-02-20")), ("a", at("2023-01-01"))], empty.schema)
    moved, left = daily_state.advance(state, waiting, FIRST, odd, nobody, FIRST)
    assert daily_state.state_kpis(moved, FIRST).first().dau == 1 and left.count() == 1
    far, _ = daily_state.advance(moved, left, FIRST, empty, nobody, FIRST + dt.timedelta(days=200))
    assert far.first().active == 0 and str(far.first().last_session) == "2024-02-20"
