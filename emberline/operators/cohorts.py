"""Cohort x day analysis.

Everything below starts from *counts*: one row per (cohort date, days since
registration) with the number of distinct active players, and one more row per
cohort with its size. There are at most (calendar days)^2 rows however large the
event table is, and building them reads events and profiles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from emberline.functions.times import When, date_lit
from emberline.operators.rollups import active_days, registrations

FUNNEL_DAYS = (1, 3, 7, 14, 30)


#: The "day" of the row that holds a cohort's size.
SIZE_ROW = -1_000_000_000


def cohort_counts(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """(cohort_date, day, players); the row with day ``SIZE_ROW`` counts the registrations.

    Player-days and registrations are stacked and meet in a window over the
    player, which has at most one row per calendar day plus one. Both keys are
    declared non-null, so that no consumer pushes its own null filter below the
    aggregation and Spark can reuse one exchange for all of them.
    """
    stacked = active_days(events).unionByName(registrations(profiles), allowMissingColumns=True)
    home = F.max("cohort_date").over(Window.partitionBy("player_id"))
    placed = stacked.select("activity_date", home.alias("home")).where(F.col("home").isNotNull())
    day = F.coalesce(F.date_diff("activity_date", "home"), F.lit(SIZE_ROW))
    cohort = F.coalesce("home", F.lit("1970-01-01").cast("date"))
    return placed.groupBy(cohort.alias("cohort_date"), day.alias("day")).agg(F.count(F.lit(1)).alias("players"))


def _size() -> Column:
    return F.max(F.when(F.col("day") == SIZE_ROW, F.col("players")))


def _seen() -> Column:
    return (F.col("day") != SIZE_ROW) & (F.col("players") > 0)


def cohort_table(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """The dense grid: every cohort by every observed day.

    An active cohort has 0 on days it was not seen; a cohort without any
    activity keeps its rows with null values. Observed days arrive as one array
    (bounded by the calendar), so the grid is emitted at exactly its own size.
    """
    return table_of_counts(cohort_counts(events, profiles))


def table_of_counts(counts: DataFrame) -> DataFrame:
    """The dense grid from :func:`cohort_counts`."""
    observed = counts.agg(F.array_sort(F.collect_set(F.when(_seen(), F.col("day")))).alias("days")).scalar()
    grid = (
        counts.groupBy("cohort_date")
        .agg(_size().alias("cohort_size"), F.max(_seen()).alias("active"))
        .withColumn("days", observed)
        .select("cohort_date", "cohort_size", "active", F.explode("days").alias("day"))
    )
    filled = grid.join(counts, ["cohort_date", "day"], "left")
    retained = F.when(F.col("active"), F.coalesce("players", F.lit(0)))
    return filled.select(
        "cohort_date",
        "day",
        retained.alias("retained"),
        "cohort_size",
        (retained / F.col("cohort_size")).alias("retention_rate"),
    )


def cohort_heatmap(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per cohort: sorted days, their rates, head-count and day-0 rate."""
    cell = F.struct("day", "retention_rate")
    by_cohort = (
        cohort_table(events, profiles)
        .groupBy("cohort_date", "cohort_size")
        .agg(
            F.array_sort(F.collect_list(cell)).alias("cells"),
            F.max(F.when(F.col("day") == 0, F.col("retention_rate"))).alias("day_0_rate"),
        )
    )
    return by_cohort.select(
        "cohort_date",
        "cohort_size",
        F.col("cells.day").alias("days"),
        F.col("cells.retention_rate").alias("rates"),
        "day_0_rate",
    ).orderBy("cohort_date")


def cohort_pivot(events: DataFrame, profiles: DataFrame, days: list[int]) -> DataFrame:
    """The grid with one column ``day_n`` per requested day, for display."""
    return (
        cohort_table(events, profiles)
        .groupBy("cohort_date", "cohort_size")
        .agg(*[F.max(F.when(F.col("day") == n, F.col("retention_rate"))).alias(f"day_{n}") for n in days])
        .orderBy("cohort_date")
    )


def cohort_long(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Non-null grid cells as (cohort_date, period, retention_rate, cohort_size)."""
    table = cohort_table(events, profiles).where(F.col("retention_rate").isNotNull())
    return table.select("cohort_date", F.col("day").alias("period"), "retention_rate", "cohort_size")


def cohort_retained_counts(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Absolute mode of the heatmap: players instead of rates."""
    table = cohort_table(events, profiles).where(F.col("retained").isNotNull())
    return table.select("cohort_date", F.col("day").alias("period"), F.col("retained").alias("players"))


def cohort_sizes(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """One size per cohort that has long-form cells."""
    return (
        cohort_long(events, profiles)
        .groupBy("cohort_date")
        .agg(F.max("cohort_size").alias("cohort_size"))
        .orderBy("cohort_date")
    )


def avg_retention_by_day(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Unweighted mean rate over active cohorts per day >= 0.

    The mean over the zero-filled grid equals the sum over observed cells
    divided by the number of active cohorts, so the grid itself is not built.
    Each active cohort is counted once, at its first observed day.
    """
    per_cohort = Window.partitionBy("cohort_date")
    first_day = F.min(F.when(_seen(), F.col("day"))).over(per_cohort)
    every = Window.partitionBy()  # one row per day
    return (
        cohort_counts(events, profiles)
        .withColumns({"cohort_size": _size().over(per_cohort), "first_day": first_day})
        .where(_seen())
        .groupBy("day")
        .agg(
            F.sum(F.col("players") / F.col("cohort_size")).alias("total"),
            F.count_if(F.col("day") == F.col("first_day")).alias("cohorts"),
        )
        .withColumn("cohorts", F.sum("cohorts").over(every))
        .where(F.col("day") >= 0)
        .select("day", (F.col("total") / F.col("cohorts")).alias("avg_retention"))
        .orderBy("day")
    )


def _key_day_rates(events: DataFrame, profiles: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """All cohorts with rate columns ``d<n>``: 0 where unseen, null for inactive cohorts.

    ``seen<n>`` tells whether any cohort was observed on day n.
    """
    active = F.col("active")
    wide = (
        cohort_counts(events, profiles)
        .groupBy("cohort_date")
        .agg(
            _size().alias("cohort_size"),
            F.max(_seen()).alias("active"),
            *[F.max(F.when(F.col("day") == n, F.col("players"))).alias(f"n{n}") for n in days],
        )
    )
    every = Window.partitionBy()  # one row per cohort date: bounded by the calendar
    return wide.select(
        "cohort_date",
        "cohort_size",
        "active",
        *[F.when(active, F.coalesce(f"n{n}", F.lit(0)) / F.col("cohort_size")).alias(f"d{n}") for n in days],
        *[F.max(F.col(f"n{n}").isNotNull()).over(every).alias(f"seen{n}") for n in days],
    )


def cohort_performance(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Day 1/7/30 rates and size per cohort; a day nobody was seen on counts as 0."""
    rates = _key_day_rates(events, profiles, (1, 7, 30))
    return rates.select(
        "cohort_date",
        *[
            F.when(F.col(f"seen{n}"), F.col(f"d{n}")).otherwise(F.lit(0.0)).alias(f"day_{n}_retention")
            for n in (1, 7, 30)
        ],
        "cohort_size",
    ).orderBy("cohort_date")


def retention_decline(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mean relative loss from day 1 to 7 and from day 7 to 30."""
    rates = _key_day_rates(events, profiles, (1, 7, 30))
    steps = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"day_{a}_to_{b}").alias("step"),
                    F.when(
                        F.col(f"seen{a}") & F.col(f"seen{b}") & (F.col(f"d{a}") > 0),
                        (F.col(f"d{a}") - F.col(f"d{b}")) / F.col(f"d{a}"),
                    ).alias("decline"),
                )
                for a, b in ((1, 7), (7, 30))
            ]
        )
    ).alias("s")
    return (
        rates.select(steps)
        .select("s.*")
        .where(F.col("decline").isNotNull())
        .groupBy("step")
        .agg(F.avg("decline").alias("avg_decline"))
        .orderBy("step")
    )


def best_worst_cohorts(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cohorts at or beyond the 0.8 / 0.2 quantile of day-30 retention."""
    rates = _key_day_rates(events, profiles, (30,)).where(F.col("active") & F.col("seen30"))
    every = Window.partitionBy()  # one row per cohort date: bounded by the calendar
    ranked = rates.withColumn("cut", F.percentile("d30", [0.2, 0.8]).over(every))
    labels = F.array_compact(
        F.array(
            F.when(F.col("d30") >= F.col("cut")[1], F.lit("best")),
            F.when(F.col("d30") <= F.col("cut")[0], F.lit("worst")),
        )
    )
    return ranked.select(
        F.explode(labels).alias("performance"), "cohort_date", F.col("d30").alias("day_30_retention")
    ).orderBy("performance", "cohort_date")


def lifecycle_segments(events: DataFrame, profiles: DataFrame, as_of: When) -> DataFrame:
    """Activity summary and lifecycle segment per player.

    A player without events has no last activity; idle days then count from
    registration.
    """
    today = date_lit(as_of)
    daily = (
        events.where(F.col("player_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("player_id", F.to_date("timestamp").alias("activity_date"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    activity = daily.groupBy("player_id").agg(
        F.max("activity_date").alias("last_activity_date"),
        F.count(F.lit(1)).alias("total_active_days"),
        F.sum("events").alias("events"),
    )
    age = F.date_diff(today, F.col("cohort_date")) + 1
    per_day = F.when(age > 0, F.coalesce("events", F.lit(0)) / age).otherwise(F.lit(0.0))
    idle, rate = F.col("days_since_last_activity"), F.col("avg_events_per_day")
    segment = (
        F.when(F.col("last_activity_date").isNull(), "inactive")
        .when((idle <= 1) & (rate >= 5), "highly_active")
        .when((idle <= 1) & (rate >= 1), "active")
        .when(idle <= 1, "casual")
        .when(idle <= 7, "at_risk")
        .when(idle <= 30, "dormant")
        .otherwise("churned")
    )
    return (
        registrations(profiles)
        .join(activity, "player_id", "left")
        .select(
            "player_id",
            F.col("cohort_date").alias("registration_date"),
            "last_activity_date",
            F.date_diff(today, F.coalesce("last_activity_date", "cohort_date")).alias("days_since_last_activity"),
            F.coalesce("total_active_days", F.lit(0)).alias("total_active_days"),
            per_day.alias("avg_events_per_day"),
        )
        .withColumn("lifecycle_segment", segment)
    )


def cohort_ltv(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Revenue, mean value, payers and conversion per cohort; empty without purchases.

    Purchases and registrations are stacked and summed per player; what belongs
    to no profile ends in a cohort without a date and is left out.
    """
    purchases = events.where(F.col("event_type") == "purchase").select(
        "player_id", F.lit(None).cast("date").alias("cohort_date"), "purchase_amount", F.lit(1).alias("purchases")
    )
    people = registrations(profiles).select(
        "player_id", "cohort_date", F.lit(None).cast("double").alias("purchase_amount"), F.lit(0).alias("purchases")
    )
    per_player = (
        purchases.unionByName(people)
        .groupBy("player_id")
        .agg(
            F.max("cohort_date").alias("cohort_date"),
            F.coalesce(F.sum("purchase_amount"), F.lit(0.0)).alias("revenue"),
            F.sum("purchases").alias("purchases"),
        )
    )
    every = Window.partitionBy()  # one row per cohort date
    return (
        per_player.groupBy("cohort_date")
        .agg(
            F.count(F.lit(1)).alias("cohort_size"),
            F.sum("revenue").alias("total_revenue"),
            F.avg("revenue").alias("avg_ltv"),
            F.count_if(F.col("revenue") > 0).alias("paying_users"),
            F.sum("purchases").alias("purchases"),
        )
        .withColumn("purchases", F.sum("purchases").over(every))
        .where((F.col("purchases") > 0) & F.col("cohort_date").isNotNull())
        .drop("purchases")
        .withColumn("conversion_rate", F.col("paying_users") / F.col("cohort_size"))
        .orderBy("cohort_date")
    )


def retention_funnel(
    events: DataFrame, profiles: DataFrame, funnel_days: tuple[int, ...] = FUNNEL_DAYS
) -> DataFrame:
    """Mean rate per funnel day; a day nobody was seen on repeats the stage before it."""
    spark = events.sparkSession
    stages = spark.createDataFrame(
        [(i, f"Day {day}", day) for i, day in enumerate(funnel_days)],
        T.StructType(
            [
                T.StructField("stage_order", T.IntegerType()),
                T.StructField("stage", T.StringType()),
                T.StructField("day", T.IntegerType()),
            ]
        ),
    )
    total = profiles.agg(F.count(F.lit(1)).alias("n")).scalar()
    in_order = Window.partitionBy().orderBy("stage_order")  # a handful of stages
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last("avg_retention", ignorenulls=True).over(before), F.lit(1.0))
    return (
        stages.join(avg_retention_by_day(events, profiles), "day", "left")
        .select(
            "stage_order",
            "stage",
            F.coalesce("avg_retention", carried).alias("retention_rate"),
            F.coalesce(carried - F.col("avg_retention"), F.lit(0.0)).alias("drop_off_rate"),
            total.alias("total_players"),
        )
        .orderBy("stage_order")
    )


def seasonal_retention(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mean day-30 retention by month, weekday (Monday = 0) and quarter of the cohort date."""
    rates = _key_day_rates(events, profiles, (30,)).where("seen30")
    keyed = rates.select(
        "d30",
        F.month("cohort_date").alias("month_key"),
        F.weekday("cohort_date").alias("weekday_key"),
        F.quarter("cohort_date").alias("quarter_key"),
    )
    return keyed.sparkSession.sql(
        """
        SELECT CASE WHEN grouping(month_key) = 0 THEN 'month'
                    WHEN grouping(weekday_key) = 0 THEN 'day_of_week'
                    ELSE 'quarter' END AS pattern,
               coalesce(month_key, weekday_key, quarter_key) AS period,
               avg(d30) AS avg_30_day_retention
        FROM {keyed}
        GROUP BY GROUPING SETS ((month_key), (weekday_key), (quarter_key))
        ORDER BY pattern, period
        """,
        keyed=keyed,
    )
