"""Every registered query against its SQL, on the smallest given tables."""

from __future__ import annotations

import pytest

from checks import catalog
from checks.compare import compare, connect
from tests.conftest import SF_DIR

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    note, _ = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    assert note.startswith("ok"), note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
