"""Times the headline queries; prints one JSON line.

Every query is materialised in full through the no-op sink. ``queries`` holds the
median of three warm runs at ``$BENCH_SF_DIR``. ``scaled`` repeats some of them
on the events table copied 14 times under new user ids: 1.4 million player events, as
many as the published figures refer to, of 21 thousand players.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks import catalog  # noqa: E402
from checks.feature_sql import churn_feature_table  # noqa: E402
from checks.registry import Tables  # noqa: E402
from emberline.operators import activity, cohorts, kpi, quality, retention  # noqa: E402
from emberline.operators.features import engineer_features  # noqa: E402
from emberline.plans.dashboard import dashboard_tables  # noqa: E402
from checks.fixtures import (  # noqa: E402
    AS_OF,
    COHORT_END,
    COHORT_START,
    DROPOFF_END,
    DROPOFF_START,
    KPI_END,
    KPI_START,
)
from emberline.session import build_session  # noqa: E402
from emberline.sources import readers, sinks  # noqa: E402

HEADLINE = (
    "cohort_retention",
    "retention_by_segment",
    "daily_retention",
    "segment_retention",
    "cohort_table",
    "cohort_ltv",
    "lifecycle_segments",
    "retention_funnel",
    "level_dropoff",
    "behavior_segments",
    "dau",
    "wau",
    "daily_player_summary",
    "milestone_funnel",
    "level_progression",
    "risk_boxplot",
    "key_metrics",
    "baseline_comparison",
    "dq_events_suite",
    "dq_orphans",
    "ml_scores",
)
COPIES = 14


def materialise(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run, repeats: int = 3) -> float:
    run()  # warm-up: code generation and file listing
    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times), 3)


def copied_events(spark, sf_dir: str, folder: str) -> None:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.agg(F.max("user_id") + 1).first()[0]
    rows = events.agg(F.max("event_id") + 1).first()[0]
    copies = events.repartition(8).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    (
        copies.withColumn("user_id", F.col("user_id") + F.col("copy") * users)
        .withColumn("event_id", F.col("event_id") + F.col("copy") * rows)
        .drop("copy")
        .repartition(16)
        .write.parquet(f"{folder}/events.parquet")
    )


def scaled_runs(spark, sf_dir: str) -> dict[str, float]:
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    copied_events(spark, sf_dir, folder)
    derived, stored = Tables(spark, folder), {}
    for name, df in (("P", derived.P), ("E", derived.E), ("S", derived.S), ("CF", churn_feature_table(derived))):
        df.repartition(16).write.parquet(f"{folder}/{name}")
        stored[name] = spark.read.parquet(f"{folder}/{name}")
    P, E, S, CF = stored.values()
    inputs, arrays = f"{folder}/json", f"{folder}/arrays"
    for df, name in ((P, "player_profiles"), (E, "player_events"), (CF, "churn_features")):
        sinks.write_json(df, f"{inputs}/{name}.json")
        sinks.write_json_arrays(df.coalesce(1), f"{arrays}/{name}.json")
    as_of = AS_OF.replace(day=31)

    def fresh() -> str:
        return tempfile.mkdtemp(prefix="landed-", dir=folder)

    def load() -> None:
        for df in readers.load_all(spark, inputs, as_of, landing=fresh()).values():
            materialise(df)

    def load_arrays() -> None:
        for df in readers.load_all(spark, arrays, as_of, array_file=True, landing=fresh()).values():
            materialise(df)

    def load_and_derive() -> None:
        loaded = readers.load_all(spark, inputs, as_of, landing=fresh())
        for df in dashboard_tables(loaded["player_profiles"], loaded["player_events"], as_of).values():
            materialise(df)

    runs = {
        "full_json_load": load,
        "full_json_load_of_one_array_each": load_arrays,
        "full_json_load_and_dashboard": load_and_derive,
        "feature_engineering": lambda: materialise(engineer_features(CF)),
        "cohort_retention": lambda: materialise(retention.cohort_retention(P, S, COHORT_START, COHORT_END)),
        "level_dropoff": lambda: materialise(activity.level_dropoff(P, S, DROPOFF_START, DROPOFF_END)),
        "behavior_segments": lambda: materialise(activity.behavior_segments(P, S, COHORT_START, COHORT_END)),
        "daily_retention": lambda: materialise(retention.daily_retention(E, P)),
        "cohort_table": lambda: materialise(cohorts.cohort_table(E, P)),
        "daily_player_summary": lambda: materialise(activity.daily_player_summary(E)),
        "key_metrics": lambda: materialise(kpi.kpi_series(P, S, KPI_START, KPI_END)),
        "events_quality_suite": lambda: materialise(quality.event_checks(E, as_of)),
    }
    result = {"players": P.count(), "player_events": E.count()}
    return result | {name: timed(run, 1 if name.startswith("full") else 3) for name, run in runs.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_ui_enabled="false",
        spark_driver_memory="8g",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    times = {name: timed(lambda: materialise(queries[name](spark, sf_dir))) for name in HEADLINE}
    scaled = scaled_runs(spark, sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "scaled": scaled,
            }
        )
    )


if __name__ == "__main__":
    main()
