"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that matter for the plans in this package. All are ordinary Spark
#: SQL options, so a cluster may override every one of them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # recording the Python call site of every Column doubles the time to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "emberline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``extra`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
