"""Random skewed inputs against plain Python written from the definitions."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.ml import splits
from emberline.operators import activity, cohorts, kpi, retention
from emberline.operators.quantiles import exact_quantiles, value_counts

DAY = dt.timedelta(days=1)
ORIGIN = dt.datetime(2023, 11, 20)


def midnight(day: dt.date) -> dt.datetime:
    return dt.datetime(day.year, day.month, day.day)


@pytest.fixture(scope="module")
def world():
    """60 players, a third of the sessions owned by one of them, many on exact boundaries."""
    rng = random.Random(7)
    people = {}
    for i in range(60):
        registered = ORIGIN + dt.timedelta(days=rng.randrange(45), hours=rng.choice([0, 0, 6, 23]))
        active = registered + dt.timedelta(days=rng.randrange(60), hours=rng.randrange(24))
        people[f"p{i}"] = (registered, active)
    sessions = []
    for n in range(1500):
        player = "p0" if n % 3 == 0 else f"p{rng.randrange(70)}"  # p60..p69 have no profile
        base = people.get(player, (ORIGIN, None))[0]
        offset = rng.choice([1, 2, 7, 8, 30, 31, rng.randrange(90)])
        jitter = rng.choice([dt.timedelta(0), dt.timedelta(microseconds=1), -dt.timedelta(microseconds=1),
                             dt.timedelta(hours=rng.randrange(24))])
        start = base + offset * DAY + jitter
        if rng.random() < 0.1:
            start = midnight(start.date())
        sessions.append((player, start, rng.choice([None, *range(1, 12)])))
    return people, sessions


@pytest.fixture
def frames(world, make):
    people, sessions = world
    P = make.P(
        [{"player_id": p, "registration_date": r, "last_active_date": a} for p, (r, a) in people.items()]
    )
    S = make.S([{"player_id": p, "start_time": s, "level_reached": lv} for p, s, lv in sessions])
    return P, S


def test_elapsed_retention(world, frames):
    people, sessions = world
    starts = defaultdict(list)
    for p, s, _ in sessions:
        starts[p].append(s)
    cohort = defaultdict(list)
    for p, (r, _) in people.items():
        cohort[r.date()].append(
            [any(r + n * DAY <= s <= r + (n + 1) * DAY for s in starts[p]) for n in (1, 7, 30)]
        )
    got = retention.cohort_retention(*frames, "2023-11-20", "2024-01-10").collect()
    assert [r.cohort_date for r in got] == sorted(cohort)
    for row in got:
        flags = np.array(cohort[row.cohort_date])
        assert row.cohort_size == len(flags)
        assert [row.day_1_retention, row.day_7_retention, row.day_30_retention] == pytest.approx(list(flags.mean(0)))


def test_half_open_day_seven(world, frames):
    people, sessions = world
    back = sum(
        any(p2 == p and r + 7 * DAY <= s < r + 8 * DAY for p2, s, _ in sessions) for p, (r, _) in people.items()
    )
    rows = activity.behavior_segments(*frames, "2023-11-01", "2024-03-01").collect()
    assert sum(r.player_count for r in rows) == len(people)
    assert sum(r.avg_retention_day_7 * r.player_count for r in rows) == pytest.approx(back)


def test_level_dropoff(world, frames):
    people, sessions = world
    lo, hi = dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 15)
    expected = {}
    for level in range(1, 6):
        reached = {p for p, s, lv in sessions if lv == level and lo <= s <= hi and p in people}
        done = {p for p in reached if any(p2 == p and lv and lv > level for p2, _, lv in sessions)}
        if reached:
            expected[level] = (len(reached), len(done))
    rows = activity.level_dropoff(*frames, lo.date(), hi.date(), max_level=5).collect()
    assert {r.level: (r.players_reached, r.players_completed) for r in rows} == expected


def test_kpi_series(world, frames):
    people, sessions = world
    start, end = dt.date(2023, 12, 1), dt.date(2024, 2, 20)
    rows = {r.metric_date: r for r in kpi.kpi_series(*frames, start, end).collect()}
    assert len(rows) == (end - start).days + 1
    flags = {
        p: [any(p2 == p and r + n * DAY <= s <= r + (n + 1) * DAY for p2, s, _ in sessions) for n in (1, 7, 30)]
        for p, (r, _) in people.items()
    }
    for day, row in rows.items():
        monday = day - dt.timedelta(days=day.weekday())
        assert row.dau == len({p for p, s, _ in sessions if s.date() == day})
        week = {p for p, s, _ in sessions if midnight(monday) <= s <= midnight(monday) + 6 * DAY}
        # the calendar ends at `end`: the whole week of every date lies in the data
        assert row.wau == len(week), day
        assert row.mau == len({p for p, s, _ in sessions if day.replace(day=1) <= s.date() <= day})
        cutoff = day - dt.timedelta(days=7)
        recent = {p for p, s, _ in sessions if s.date() >= cutoff}
        known = [p for p, (r, _) in people.items() if r <= midnight(day)]
        gone = [p for p in known if p not in recent and people[p][1] < midnight(cutoff)]
        assert row.churn_rate == pytest.approx(len(gone) / len(known) if known else 0.0)
        assert row.new_registrations == sum(r.date() == day for r, _ in people.values())
        window = [flags[p] for p, (r, _) in people.items() if day - 30 * DAY <= r.date() <= day - DAY]
        means = np.array(window).mean(0) if window else [0, 0, 0]
        assert [row.day_1_retention, row.day_7_retention, row.day_30_retention] == pytest.approx(list(means))


def test_single_day_equals_series(frames):
    series = {r.metric_date: r for r in kpi.kpi_series(*frames, "2023-12-20", "2024-01-10").collect()}
    for day in (dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 1, 7)):
        assert kpi.key_metrics(*frames, day).first() == series[day]


def test_cohort_grid(world, frames, make):
    people, sessions = world
    P, _ = frames
    E = make.E([{"player_id": p, "timestamp": s, "event_type": "session_start"} for p, s, _ in sessions])
    cells, sizes = defaultdict(set), defaultdict(int)
    for r, _ in people.values():
        sizes[r.date()] += 1
    for p, s, _ in sessions:
        if p in people:
            home = people[p][0].date()
            cells[home, (s.date() - home).days].add(p)
    days, active = {d for _, d in cells}, {c for c, _ in cells}
    rows = cohorts.cohort_table(E, P).collect()
    assert len(rows) == len(sizes) * len(days)
    for r in rows:
        expected = len(cells.get((r.cohort_date, r.day), ())) if r.cohort_date in active else None
        assert (r.retained, r.cohort_size) == (expected, sizes[r.cohort_date])
    means = {
        d: sum(len(cells.get((c, d), ())) / sizes[c] for c in active) / len(active) for d in days if d >= 0
    }
    got = {r.day: r.avg_retention for r in cohorts.avg_retention_by_day(E, P).collect()}
    assert got == pytest.approx(means)


def test_weeks_and_months_roll_over(make):
    P = make.P([{"player_id": "a", "registration_date": dt.datetime(2023, 11, 30)},
                {"player_id": "b", "registration_date": dt.datetime(2023, 11, 5)}])
    stamps = [("a", dt.datetime(2023, 12, 31)), ("a", dt.datetime(2024, 1, 31, 23)), ("b", dt.datetime(2024, 2, 29)),
              ("b", dt.datetime(2023, 11, 12, 23, 59)), ("a", dt.datetime(2023, 12, 4))]
    E = make.E([{"player_id": p, "timestamp": t, "event_type": "purchase"} for p, t in stamps])
    month = retention.monthly_retention(E, P).first()
    assert (month.cohort_date, month.cohort_size) == (dt.date(2023, 11, 1), 2)
    assert (month.day_1_retention, month.day_7_retention, month.day_30_retention) == (0.5, 0.5, 0.5)
    weeks = {r.cohort_date: r for r in retention.weekly_retention(E, P).collect()}
    assert weeks[dt.date(2023, 10, 30)].day_1_retention == 1.0  # Sunday 12 November is in the next week
    assert weeks[dt.date(2023, 11, 27)].day_1_retention == 1.0


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_quantiles_are_exact(spark, buckets):
    """Half of one group shares a value, and values leave the bucket range."""
    rng = random.Random(3)
    rows = [("a", 0.25 if i % 2 else rng.uniform(-2, 3)) for i in range(501)]
    rows += [("b", rng.random()) for _ in range(40)] + [("c", 0.5), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"lo": 0.1, "q1": 0.25, "median": 0.5, "hi": 0.99}
    got = exact_quantiles(value_counts(df, "g", "v"), "g", wanted, buckets=buckets).collect()
    for row in got:
        values = [v for g, v in rows if g == row.g and v is not None]
        assert [row[n] for n in wanted] == pytest.approx([np.quantile(values, q) for q in wanted.values()])


@pytest.mark.parametrize("digits", [1, 3])
def test_split_is_exact_and_balanced(spark, digits):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("player_id"), (F.col("id") % 10 == 0).cast("double").alias("label")
    )
    ranked = splits.stratified_rank(df, digits=digits)
    for label, size in ((0.0, 900), (1.0, 100)):
        ranks = sorted(r.class_rank for r in ranked.where(F.col("label") == label).collect())
        assert ranks == list(range(size))
    assert splits.stratified_split(df, 0.2).where("is_test").groupBy("label").count().orderBy("label").collect() == [
        (0.0, 180),
        (1.0, 20),
    ]
    folds = splits.stratified_folds(df, 4).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} == {225, 25}
