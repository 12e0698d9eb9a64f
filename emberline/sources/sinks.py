"""Writers: ISO JSON, appends and keyed upserts on partitioned Parquet.

An upsert rewrites only the date partitions it touches (dynamic partition
overwrite): new files are staged and swapped in when the job commits, so a lost
executor only repeats its tasks. What is stored is read between the batch's first
and last date only, a filter on the partitions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import schemas
from emberline.functions.times import When, ts_lit
from emberline.operators import kpi
from emberline.sources.readers import read_table
from emberline.sources.workers import ship_package


def iso_text(instant: Column) -> Column:
    """ISO text of an instant; the fraction is left out when it is zero."""
    text = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def with_iso_strings(df: DataFrame) -> DataFrame:
    instants = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    days = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    return df.withColumns(
        {n: iso_text(F.col(n)) for n in instants} | {n: F.col(n).cast("string") for n in days}
    )


def write_json(df: DataFrame, path: str) -> None:
    with_iso_strings(df).write.mode("overwrite").json(path)


def _bracketed(batches):
    """The records of one task as the lines of one JSON array."""
    mark = "["
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([mark + lines[0], *["," + x for x in lines[1:]]])], names=["value"])
            mark = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], names=["value"])


def write_array_files(records: DataFrame, path: str) -> None:
    """The JSON texts of a one-column table as files of one array each, one for each partition."""
    ship_package(records.sparkSession)
    records.mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Rows as files of one JSON array each, one for each partition of ``df``."""
    rows = with_iso_strings(df)
    write_array_files(rows.select(F.to_json(F.struct(*rows.columns))), path)


def write_table(df: DataFrame, root: str, name: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{root.rstrip('/')}/{name}")


def stamped(df: DataFrame, existing: DataFrame, keys: list[str], as_of: When) -> DataFrame:
    """created_at survives from an existing row; updated_at is always ``as_of``."""
    old = existing.select(*keys, F.col("created_at").alias("_created"))
    now = ts_lit(as_of)
    return (
        df.drop("created_at", "updated_at")
        .join(old, keys, "left")
        .withColumn("created_at", F.coalesce("_created", now))
        .withColumn("updated_at", now)
        .drop("_created")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key: the greatest ``order`` value. Without an order, a repeated key is an error."""
    rest = [c for c in df.columns if c not in keys]
    if order is None:
        once = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*rest)))
        picked = df.groupBy(*keys).agg(F.coalesce(once, F.raise_error(F.lit(f"repeated {', '.join(keys)} without an order"))).alias("row"))
    else:
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def stored_near(batch: DataFrame, root: str, name: str, partition_by: str) -> DataFrame:
    """The stored rows whose partition lies within those of ``batch`` (its keys include the partition column)."""
    low, high = batch.agg(F.min(partition_by), F.max(partition_by)).first()
    stored = read_table(batch.sparkSession, root, name)
    return stored.where("false") if low is None else stored.where(F.col(partition_by).between(F.lit(low), F.lit(high)))


def upsert(
    df: DataFrame,
    root: str,
    name: str,
    keys: list[str],
    partition_by: str,
    as_of: When,
    order: str | None = None,
) -> None:
    """Insert rows, replacing those with equal keys."""
    schema = schemas.TABLES[name]
    existing = stored_near(df, root, name, partition_by)
    fresh = stamped(latest_per_key(df, keys, order), existing, keys, as_of)
    touched = fresh.select(partition_by).distinct()
    kept = existing.join(touched, partition_by, "left_semi").join(fresh.select(*keys), keys, "left_anti")
    merged = kept.unionByName(fresh.select(*[F.col(f.name).cast(f.dataType) for f in schema]))
    (
        merged.hint("rebalance", F.col(partition_by))  # splits a hot date, merges small ones
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .parquet(f"{root.rstrip('/')}/{name}")
    )


def insert_if_absent(
    df: DataFrame, root: str, name: str, keys: list[str], partition_by: str, as_of: When, order: str | None = None
) -> None:
    """Insert only rows whose keys are new, each once; existing rows stay as they are."""
    schema = schemas.TABLES[name]
    existing = stored_near(df, root, name, partition_by)
    new = latest_per_key(df, keys, order).join(existing.select(*keys), keys, "left_anti")
    now = ts_lit(as_of)
    rows = new.withColumns({"created_at": now, "updated_at": now})
    (
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        .write.mode("append")
        .partitionBy(partition_by)
        .parquet(f"{root.rstrip('/')}/{name}")
    )


def upsert_metrics(kpis: DataFrame, root: str, as_of: When) -> None:
    """Unpivot the KPI rows and upsert them on (date, name)."""
    rows = kpi.metric_rows(kpis)
    upsert(rows, root, "daily_metrics_history", ["metric_date", "metric_name"], "metric_date", as_of)


def append_alerts(alert_rows: DataFrame, root: str, as_of: When) -> None:
    """Append alerts, unresolved; stored ids stay as they are, and no new ids write no files.

    Ids follow from metric and date, so a job that runs again stores no alert twice, and reads the alerts of its dates only.
    """
    stored = stored_near(alert_rows, root, "retention_alerts", "metric_date").select("metric_date", "alert_id")
    alert_rows = alert_rows.join(stored, ["metric_date", "alert_id"], "left_anti")
    now = ts_lit(as_of)
    blank = {
        "resolved_at": F.lit(None),
        "resolved_by": F.lit(None),
        "created_at": now,
        "updated_at": now,
    }
    rows = alert_rows.withColumns(blank)
    (
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.ALERTS])
        .write.mode("append")
        .partitionBy("metric_date")
        .parquet(f"{root.rstrip('/')}/retention_alerts")
    )


def upsert_reports(reports: DataFrame, root: str, as_of: When) -> None:
    """Store nested reports as JSON, one per date."""
    rows = kpi.report_json(reports).withColumn("generated_at", ts_lit(as_of))
    upsert(rows, root, "daily_reports", ["report_date"], "report_date", as_of)
