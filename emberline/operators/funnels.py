"""Milestone, level and cohort funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions.columns import level_group
from emberline.operators.activity import level_events

# Level milestones of the funnel.
MILESTONES = (1, 5, 10, 15, 20, 25, 30)


def _in_stage_order():
    """Funnel tables have a handful of rows, so the ordered window is unpartitioned."""
    return Window.partitionBy().orderBy("stage_order")


def _stage_name(milestone: int) -> str:
    return "Tutorial" if milestone == 1 else f"Level {milestone}"


def milestone_funnel(events: DataFrame, milestones: tuple[int, ...] = MILESTONES) -> DataFrame:
    """Players whose best completed level reaches each milestone."""
    best = (
        level_events(events)
        .where(F.col("player_id").isNotNull())
        .groupBy("player_id")
        .agg(F.max("level").alias("best"))
    )
    totals = best.agg(
        F.count(F.lit(1)).alias("any"),
        *[F.count_if(F.col("best") >= m).alias(f"m{m}") for m in milestones],
    ).where("any > 0")
    first = F.col(f"m{milestones[0]}")
    stages = F.array(
        *[
            F.struct(
                F.lit(_stage_name(m)).alias("stage"),
                F.col(f"m{m}").alias("players"),
                F.lit(i).alias("stage_order"),
                F.when(first > 0, F.col(f"m{m}") / first).otherwise(F.lit(0.0)).alias("conversion_rate"),
            )
            for i, m in enumerate(milestones)
        ]
    )
    return totals.select(F.inline(stages)).orderBy("stage_order")


def level_progression(events: DataFrame) -> DataFrame:
    """Players, attempts and normalised completion per level."""
    top = F.max("completions").over(Window.partitionBy())  # one row per level
    return (
        level_events(events)
        .where(F.col("level").isNotNull())
        .groupBy("level")
        .agg(
            F.count_distinct("player_id").alias("completions"),
            F.count("timestamp").alias("total_attempts"),
        )
        .select(
            "level",
            "completions",
            "total_attempts",
            F.try_divide("total_attempts", "completions").alias("avg_attempts"),
            level_group("level").alias("level_group"),
            F.when(top > 0, F.col("completions") / top).otherwise(F.lit(0.0)).alias("completion_rate"),
        )
        .orderBy("level")
    )


def player_milestones(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Registration month and milestone flags of every player."""
    progress = (
        events.where(F.col("player_id").isNotNull())
        .groupBy("player_id")
        .agg(
            F.max(F.when(F.col("event_type") == "level_complete", F.col("level"))).alias("best"),
            F.max(F.col("event_type") == "purchase").alias("paid"),
        )
    )
    best = F.coalesce("best", F.lit(0))
    return profiles.join(progress, "player_id", "left").select(
        F.date_format("registration_date", "yyyy-MM").alias("cohort"),
        "player_id",
        (best >= 1).alias("tutorial_complete"),
        (best >= 5).alias("level_5_complete"),
        (best >= 10).alias("level_10_complete"),
        F.coalesce("paid", F.lit(False)).alias("first_purchase"),
    )


def cohort_funnel_comparison(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Share of each monthly cohort passing each milestone."""
    flags = ("tutorial_complete", "level_5_complete", "level_10_complete", "first_purchase")
    shares = (
        player_milestones(events, profiles)
        .groupBy("cohort")
        .agg(*[F.avg(F.col(name).cast("int")).alias(name) for name in flags])
    )
    stages = F.array(
        *[
            F.struct(
                F.lit(name).alias("stage"), F.lit(i).alias("stage_order"), F.col(name).alias("conversion_rate")
            )
            for i, name in enumerate(flags)
        ]
    )
    return shares.select("cohort", F.inline(stages)).orderBy("cohort", "stage_order")


def _lost():
    before = F.lag("players").over(_in_stage_order())
    return before, before - F.col("players")


def funnel_stage_rates(funnel: DataFrame) -> DataFrame:
    """Conversion against the first stage and loss against the stage before."""
    first = F.first("players").over(_in_stage_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before, lost = _lost()
    conversion = F.try_divide(F.col("players"), first)
    return funnel.select(
        "stage",
        "players",
        "stage_order",
        conversion.alias("conversion_rate"),
        (1 - conversion).alias("drop_off_rate"),
        F.when(before > 0, lost / before).otherwise(F.lit(0.0)).alias("stage_drop_off"),
    ).orderBy("stage_order")


def funnel_transitions(funnel: DataFrame) -> DataFrame:
    """One row per step between neighbouring stages."""
    before, lost = _lost()
    stage_before = F.lag("stage").over(_in_stage_order())
    return (
        funnel.select(
            F.concat_ws(" → ", stage_before, "stage").alias("transition"),
            F.when(before > 0, lost / before).otherwise(F.lit(0.0)).alias("drop_off_rate"),
            lost.alias("drop_off_players"),
            "stage_order",
        )
        .where(F.col("drop_off_players").isNotNull())
        .orderBy("stage_order")
    )


def funnel_summary(funnel: DataFrame) -> DataFrame:
    """Totals, final conversion and the stage with the largest loss (earliest on ties)."""
    rates = funnel_stage_rates(funnel)
    loss_rank = F.struct("stage_drop_off", -F.col("stage_order"))
    total, final = F.col("total_players"), F.col("final_players")
    return (
        rates.agg(
            F.min_by("players", "stage_order").alias("total_players"),
            F.max_by("players", "stage_order").alias("final_players"),
            F.max_by("stage", loss_rank).alias("biggest_dropoff_stage"),
            F.max("stage_drop_off").alias("biggest_dropoff_rate"),
            F.count(F.lit(1)).alias("stage_count"),
        )
        .where("stage_count > 0")
        .withColumn("overall_conversion", F.when(total > 0, final / total).otherwise(F.lit(0.0)))
    )


def level_heatmap(levels: DataFrame, columns: list[int]) -> DataFrame:
    """Completion rate as level group (rows) by level (columns ``level_n``)."""
    return levels.groupBy("level_group").agg(
        *[F.max(F.when(F.col("level") == n, F.col("completion_rate"))).alias(f"level_{n}") for n in columns]
    )
