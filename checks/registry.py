"""Where the check modules register a query next to its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixture_sql import with_views
from checks import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """The fixture views over one directory of the given tables."""

    spark: SparkSession
    sf_dir: str

    @property
    def P(self) -> DataFrame:
        return fx.player_profiles(self.spark, self.sf_dir)

    @property
    def E(self) -> DataFrame:
        return fx.player_events(self.spark, self.sf_dir)

    @property
    def S(self) -> DataFrame:
        return fx.player_sessions(self.spark, self.sf_dir)

    @property
    def DE(self) -> DataFrame:
        return fx.dirty_events(self.spark, self.sf_dir)

    @property
    def HE(self) -> DataFrame:
        return fx.historical_events(self.spark, self.sf_dir)

    @property
    def SOC(self) -> DataFrame:
        return fx.social_connections(self.spark, self.sf_dir)

    @property
    def BR(self) -> DataFrame:
        return fx.behavior_rows(self.spark, self.sf_dir)

    @property
    def AL(self) -> DataFrame:
        return fx.retention_alerts(self.spark, self.sf_dir)

    @property
    def FJ(self) -> DataFrame:
        return fx.failed_jobs(self.spark, self.sf_dir)


def add(name: str, build: Callable[[Tables], DataFrame], views: list[str] | None = None, sql: str | None = None):
    """Register ``build``; ``sql`` is prefixed with the fixture ``views`` it reads."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql is not None:
        SQL[name] = with_views(views, sql) if views else sql.strip()


def add_same(name: str, build: Callable[[Tables], DataFrame], other: str):
    """Register ``build`` with the SQL of the query ``other``."""
    add(name, build)
    SQL[name] = SQL[other]


def r6(column: Column | str) -> Column:
    """Six digits; the nudge keeps exact ties from falling to either side by a last bit."""
    return F.round(F.lit(1e-9) + (F.col(column) if isinstance(column, str) else column), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round sums and means, whose last bits depend on the order of addition."""
    return df.withColumns({c: r6(c) for c in columns})
