from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberline import schemas  # noqa: E402
from emberline.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_driver_memory="4g",
        spark_ui_showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def make(spark):
    """make.P(rows) etc.: rows are dicts, absent columns are null."""

    class Make:
        @staticmethod
        def _frame(rows, schema):
            return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

        def P(self, rows):
            filled = [
                {
                    "total_sessions": 0,
                    "total_playtime_minutes": 0,
                    "total_purchases": 0.0,
                    "churn_risk_score": 0.0,
                    "highest_level_reached": 1,
                    "churn_prediction_date": r.get("registration_date"),
                    "last_active_date": r.get("registration_date"),
                }
                | r
                for r in rows
            ]
            return self._frame(filled, schemas.PROFILES)

        def E(self, rows):
            return self._frame(rows, schemas.EVENTS)

        def S(self, rows):
            return self._frame(rows, schemas.SESSIONS)

        def CF(self, rows):
            return self._frame(rows, schemas.CHURN_FEATURES)

        def H(self, rows):
            return self._frame(rows, schemas.METRIC_HISTORY)

        def FJ(self, rows):
            return self._frame(rows, schemas.FAILED_JOBS)

    return Make()
