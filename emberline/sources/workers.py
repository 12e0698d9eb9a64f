"""Code for the Python workers of a cluster."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Applications whose workers have this package.
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, as ``--py-files`` would, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/emberline_core", "zip", root, "emberline")
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
