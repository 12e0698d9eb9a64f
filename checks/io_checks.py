"""Sources and sinks: each query writes the fixture views out and reads them back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.fixture_sql import BR, E, P, S
from checks.feature_sql import CF, churn_feature_table
from checks.kpi_checks import ALERTS, BASE, COMPARED, H, K, history, series
from checks.registry import add, rounded
from emberline import schemas
from emberline.functions.times import ts_lit
from emberline.operators import kpi
from checks.fixtures import AS_OF, KPI_END, KPI_START
from emberline.plans.reporting import run_daily_reports
from emberline.sources import readers, sinks
from emberline.sources.storage import work_folder

P_COLUMNS = ", ".join(f.name for f in schemas.PROFILES)


def _profiles_with_errors(t):
    """Every 25th registration hour has an impossible risk: below the 10 % gate."""
    broken = F.hour("registration_date") == 23
    return t.P.withColumn("churn_risk_score", F.when(broken, F.lit(1.5)).otherwise(F.col("churn_risk_score")))


def _write_profiles(t, folder):
    sinks.write_json(_profiles_with_errors(t), f"{folder}/player_profiles.json")


def _write_events(t, folder):
    """Completions of level 30 lose their level: below the 5 % gate."""
    sinks.write_json(t.E.withColumn("level", F.when(F.col("level") != 30, F.col("level"))), f"{folder}/player_events.json")


def _write_features(t, folder):
    sinks.write_json(churn_feature_table(t), f"{folder}/churn_features.json")


def _load_profiles(t):
    folder = work_folder(t.spark)
    _write_profiles(t, folder)
    return readers.load_profiles(t.spark, f"{folder}/player_profiles.json", landing=f"{folder}/landed").clean.select(*[f.name for f in schemas.PROFILES])


def _load_events(t):
    folder = work_folder(t.spark)
    _write_events(t, folder)
    return readers.load_events(
        t.spark, f"{folder}/player_events.json", AS_OF + dt.timedelta(days=1), landing=f"{folder}/landed"
    ).clean


def _load_features(t):
    folder = work_folder(t.spark)
    _write_features(t, folder)
    return readers.load_churn_features(t.spark, f"{folder}/churn_features.json")


def _load_all(t):
    folder = work_folder(t.spark)
    _write_profiles(t, folder)
    _write_events(t, folder)
    _write_features(t, folder)
    tables = readers.load_all(t.spark, folder, AS_OF + dt.timedelta(days=1), landing=f"{folder}/landed")
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("records")) for name, df in tables.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


GOOD_P = "hour(registration_date) <> 23"
GOOD_E = "level IS DISTINCT FROM 30"
add("load_profiles", _load_profiles, [P], f"SELECT {P_COLUMNS} FROM P WHERE {GOOD_P}")
add("load_events", _load_events, [E], f"SELECT * FROM E WHERE {GOOD_E}")
add("load_churn_features", lambda t: rounded(_load_features(t), "avg_session_duration_minutes", "purchases_last_30_days"), CF,
    """SELECT * REPLACE (round(1e-9 + avg_session_duration_minutes, 6) AS avg_session_duration_minutes,
      round(1e-9 + purchases_last_30_days, 6) AS purchases_last_30_days) FROM CF""")
add(
    "load_all",
    _load_all,
    [P, E],
    f"""SELECT 'player_profiles' AS table_name, count(*) AS records FROM P WHERE {GOOD_P}
    UNION ALL SELECT 'player_events', count(*) FROM E WHERE {GOOD_E} UNION ALL SELECT 'churn_features', count(*) FROM P""",
)


def _csv(t):
    folder = work_folder(t.spark)
    t.BR.write.option("header", True).csv(f"{folder}/behavior")
    return readers.read_behavior_csv(t.spark, f"{folder}/behavior")


add("read_behavior_csv", _csv, [BR], "SELECT * FROM BR")


def _json_text(t):
    folder = work_folder(t.spark)
    sinks.write_json(t.P, f"{folder}/profiles")
    return t.spark.read.json(f"{folder}/profiles").select("player_id", "registration_date", "total_sessions")


add(
    "write_json",
    _json_text,
    [P],
    """SELECT player_id, strftime(registration_date, '%Y-%m-%dT%H:%M:%S') AS registration_date,
      total_sessions::BIGINT AS total_sessions FROM P""",
)


def _tables(t):
    folder = work_folder(t.spark)
    sinks.write_table(t.P, folder, "player_profiles")
    sinks.write_table(t.S, folder, "player_sessions")
    tables = readers.read_tables(t.spark, folder, ["player_profiles", "player_sessions", "retention_alerts"])
    return (
        tables["player_sessions"]
        .join(tables["player_profiles"], "player_id")
        .groupBy("player_id")
        .agg(F.count(F.lit(1)).alias("sessions"), F.max("level_reached").alias("best"))
        .withColumn("alerts_stored", F.lit(tables["retention_alerts"].count()))
    )


add(
    "read_tables",
    _tables,
    [P, S],
    """SELECT player_id, count(*) AS sessions, max(level_reached) AS best, 0 AS alerts_stored FROM S JOIN P USING (player_id)
      GROUP BY player_id""",
)
add(
    "run_sql",
    lambda t: readers.run_sql(
        t.spark,
        """SELECT to_date(start_time) AS activity_date, count(DISTINCT player_id) AS dau_count FROM {player_sessions}
           WHERE to_date(start_time) BETWEEN :start_date AND :end_date GROUP BY 1 ORDER BY 1""",
        {"start_date": dt.date(2024, 1, 3), "end_date": dt.date(2024, 1, 12)},
        {"player_sessions": t.S},
    ),
    [S],
    """SELECT CAST(start_time AS DATE) AS activity_date, count(DISTINCT player_id) AS dau_count FROM S
      WHERE CAST(start_time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' GROUP BY 1""",
)


def _upserted_metrics(t):
    """Stores a provisional series, then the final one for the second half."""
    folder = work_folder(t.spark)
    final = series(t).persist()
    draft = final.withColumns({"dau": F.col("dau") + 7, "wau": F.lit(0).cast("bigint")})
    sinks.upsert_metrics(draft, folder, "2024-02-01 00:00:00")
    sinks.upsert_metrics(final.where("metric_date >= '2024-01-10'"), folder, "2024-02-02 00:00:00")
    final.unpersist()
    return readers.read_table(t.spark, folder, "daily_metrics_history")


UPSERTED = """SELECT metric_date, metric_name, CASE WHEN metric_date >= DATE '2024-01-10' THEN metric_value
    WHEN metric_name = 'dau' THEN metric_value + 7 WHEN metric_name = 'wau' THEN 0 ELSE metric_value END::DECIMAL(10,4) AS metric_value,
    TIMESTAMP '2024-02-01 00:00:00' AS created_at, CASE WHEN metric_date >= DATE '2024-01-10' THEN TIMESTAMP '2024-02-02 00:00:00'
      ELSE TIMESTAMP '2024-02-01 00:00:00' END AS updated_at FROM h"""
add("upsert_metrics", _upserted_metrics, [P, S], f", {K}, {H} {UPSERTED}")
add(
    "stamp_updated_at",
    lambda t: _upserted_metrics(t).groupBy("created_at", "updated_at").agg(F.count(F.lit(1)).alias("metrics")),
    [P, S],
    f", {K}, {H}, u AS ({UPSERTED}) SELECT created_at, updated_at, count(*) AS metrics FROM u GROUP BY ALL",
)


def _appended_alerts(t):
    folder = work_folder(t.spark)
    kpis = series(t).persist()
    rows = kpi.alerts(kpis, generated_at="2024-01-31 06:00:00")
    sinks.append_alerts(rows.where("metric_date < '2024-01-10'"), folder, "2024-01-31 06:00:00")
    sinks.append_alerts(rows.where("metric_date >= '2024-01-10'"), folder, "2024-01-31 07:00:00")
    sinks.append_alerts(rows.where("false"), folder, "2024-01-31 08:00:00")
    kpis.unpersist()
    return readers.read_table(t.spark, folder, "retention_alerts").select(
        "alert_id", "severity", "metric_name", "resolved", "timestamp", "created_at"
    )


add(
    "append_alerts",
    _appended_alerts,
    [P, S],
    f""", {K}, {H}, {BASE}, {COMPARED}, {ALERTS} SELECT alert_id, severity, metric_name, false AS resolved,
      TIMESTAMP '2024-01-31 06:00:00' AS timestamp, CASE WHEN metric_date < DATE '2024-01-10' THEN TIMESTAMP '2024-01-31 06:00:00'
        ELSE TIMESTAMP '2024-01-31 07:00:00' END AS created_at FROM al""",
)


def _upserted_reports(t):
    folder = work_folder(t.spark)
    reports = kpi.daily_reports(t.P, t.S, KPI_START, KPI_END, kpis=series(t))
    sinks.upsert_reports(reports, folder, "2024-01-31 06:00:00")
    sinks.upsert_reports(reports.where("report_date >= '2024-01-29'"), folder, "2024-01-31 09:00:00")
    return readers.read_table(t.spark, folder, "daily_reports").select(
        "report_date",
        "generated_at",
        "created_at",
        F.get_json_object("report_data", "$.key_metrics.mau").cast("bigint").alias("mau"),
    )


LATE = "CASE WHEN metric_date >= DATE '2024-01-29' THEN TIMESTAMP '2024-01-31 09:00:00' ELSE TIMESTAMP '2024-01-31 06:00:00' END"
add(
    "upsert_report",
    _upserted_reports,
    [P, S],
    f""", {K} SELECT metric_date AS report_date, {LATE} AS generated_at, TIMESTAMP '2024-01-31 06:00:00' AS created_at, mau FROM k""",
)


def _seeded(t):
    """Seed rows meet a history that already holds the later half of them."""
    folder = work_folder(t.spark)
    rows = history(t).persist()
    names = ["metric_date", "metric_name"]
    later = rows.where("metric_date >= '2024-01-10'")
    sinks.insert_if_absent(later, folder, "daily_metrics_history", names, "metric_date", "2024-02-01 00:00:00")
    seed = rows.withColumn("metric_value", F.lit(1).cast("decimal(10,4)"))
    sinks.insert_if_absent(seed, folder, "daily_metrics_history", names, "metric_date", "2024-02-02 00:00:00")
    rows.unpersist()
    return readers.read_table(t.spark, folder, "daily_metrics_history").select(*names, "metric_value")


add(
    "insert_if_absent",
    _seeded,
    [P, S],
    f""", {K}, {H} SELECT metric_date, metric_name,
      CASE WHEN metric_date >= DATE '2024-01-10' THEN metric_value ELSE 1 END::DECIMAL(10,4) AS metric_value FROM h""",
)


def _alerts_of_two_runs(t):
    """The daily job run twice: what is stored for each alert."""
    folder = work_folder(t.spark)
    for as_of in ("2024-01-31 06:00:00", "2024-01-31 07:00:00"):
        run_daily_reports(t.P, t.S, folder, KPI_START, KPI_END, as_of)
    stored = readers.read_table(t.spark, folder, "retention_alerts")
    return stored.groupBy("alert_id").agg(F.count(F.lit(1)).alias("copies"), F.max("created_at").alias("created_at"))


def _array_file(t):
    """Profiles in files of one JSON array each, one record with text where a number belongs."""
    folder = work_folder(t.spark)
    bad = F.col("player_id") == "player_0"
    rows = sinks.with_iso_strings(t.P.select(*[f.name for f in schemas.PROFILES]))
    record = F.to_json(F.struct(*rows.columns))
    spoilt = F.regexp_replace(record, '"total_sessions":[0-9]+', '"total_sessions":"many"')
    sinks.write_array_files(rows.select(F.when(bad, spoilt).otherwise(record)), f"{folder}/profiles")
    return readers.load_profiles(t.spark, f"{folder}/profiles", array_file=True).clean.select("player_id", "total_playtime_minutes")


add("load_json_arrays", _array_file, [P], "SELECT player_id, total_playtime_minutes FROM P WHERE player_id <> 'player_0'")


def _report_job(t):
    stored = run_daily_reports(t.P, t.S, work_folder(t.spark), "2023-12-22", KPI_END, "2024-01-31 06:00:00")
    return stored.select(
        "report_date",
        F.get_json_object("report_data", "$.key_metrics.dau").cast("bigint").alias("dau"),
        F.get_json_object("report_data", "$.summary").alias("summary"),
        (F.col("generated_at") == ts_lit("2024-01-31 06:00:00")).alias("stamped"),
    )


from checks.kpi_checks import SUMMARY  # noqa: E402

add(
    "daily_alerts_rerun",
    _alerts_of_two_runs,
    [P, S],
    f""", {K}, {H}, {BASE}, {COMPARED}, {ALERTS} SELECT alert_id, 1::BIGINT AS copies, TIMESTAMP '2024-01-31 06:00:00' AS created_at FROM al""",
)

add(
    "daily_report_job",
    _report_job,
    [P, S],
    f""", {K}, {H}, {BASE}, {COMPARED}, {ALERTS}, {SUMMARY} SELECT metric_date AS report_date, dau, summary, true AS stamped
      FROM sm JOIN k USING (metric_date)""",
)
add(
    "sample_players",
    lambda t: readers.sample_players(t.P, 40).select("player_id"),
    [P],
    "SELECT player_id FROM P ORDER BY md5('42:' || player_id) LIMIT 40",
)
