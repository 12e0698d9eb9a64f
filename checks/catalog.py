"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

from checks import registry

#: Importing a module registers its queries.
MODULES = ("retention_checks", "row_checks", "quality_checks", "kpi_checks", "io_checks", "ml_checks")

for _module in MODULES:
    importlib.import_module(f"checks.{_module}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
