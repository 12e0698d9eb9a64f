"""Queries next to their SQL, on the smallest given tables."""

from __future__ import annotations

import pytest

from checks.compare import compare, connect
from emberline.llm import queries
from tests.llm.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    note, _ = compare(spark, connect(SF_DIR), queries.QUERIES[name], queries.SQL[name], SF_DIR)
    assert note.startswith("ok"), note


def test_the_entry_module_registers_all():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
