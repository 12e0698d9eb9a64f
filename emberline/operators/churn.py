"""Churn risk tables, distributions and the overview row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions.columns import engagement_level, risk_category
from emberline.functions.times import When, date_lit
from emberline.operators.activity import engagement_products, engagement_timeline
from emberline.operators.funnels import milestone_funnel
from emberline.operators.quantiles import exact_quantiles, value_counts

BINS = 30
HIGH_RISK = 0.7


def churn_table(profiles: DataFrame, as_of: When) -> DataFrame:
    return profiles.select(
        "player_id",
        "churn_risk_score",
        engagement_level().alias("segment"),
        F.date_diff(date_lit(as_of), F.to_date("last_active_date")).alias("days_since_last_session"),
        "total_sessions",
        F.col("total_playtime_minutes").alias("total_playtime"),
        "total_purchases",
    )


def filter_churn(
    churn: DataFrame, segments: list[str] | None = None, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Keep the named segments (``all`` keeps every one) and an inclusive risk range."""
    if segments and "all" not in segments:
        churn = churn.where(F.col("segment").isin(*segments))
    if low is not None and high is not None:
        churn = churn.where(F.col("churn_risk_score").between(low, high))
    return churn


def risk_breakdown(churn: DataFrame) -> DataFrame:
    return (
        churn.groupBy(risk_category().alias("risk_category"))
        .agg(F.count(F.lit(1)).alias("players"))
        .orderBy(F.desc("players"), "risk_category")
    )


def risk_histogram(churn: DataFrame) -> DataFrame:
    """30 equal bins over [0, 1] per segment; a score of 1 belongs to the last bin."""
    score = F.col("churn_risk_score")
    bin_no = F.least(F.floor(score * BINS) + 1, F.lit(BINS)).cast("int")
    return (
        churn.where(score.isNotNull())
        .groupBy("segment", bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("players"))
        .orderBy("segment", "bin")
    )


def risk_boxplot(churn: DataFrame) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count of the risk score per segment."""
    counted = value_counts(churn, "segment", "churn_risk_score")
    quartiles = exact_quantiles(counted, "segment", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counted.join(quartiles, "segment")
        .groupBy("segment", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
            F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
            F.sum(F.when(inside, 0).otherwise(F.col("copies"))).alias("outliers"),
        )
        .orderBy("segment")
    )


def engagement_histogram(events: DataFrame) -> DataFrame:
    """30 equal bins over the observed range of the daily engagement score."""
    every = Window.partitionBy()  # one row per day
    daily = (
        engagement_products(engagement_timeline(events))
        .where(F.col("engagement_score").isNotNull())
        .withColumn("low", F.min("engagement_score").over(every))
        .withColumn("high", F.max("engagement_score").over(every))
    )
    place = F.floor((F.col("engagement_score") - F.col("low")) * BINS / (F.col("high") - F.col("low"))) + 1
    bin_no = F.when(F.col("high") > F.col("low"), F.least(place, F.lit(BINS))).otherwise(1).cast("int")
    return daily.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("days")).orderBy("bin")


def churn_summary(churn: DataFrame) -> DataFrame:
    total, high = F.col("total_players"), F.col("high_risk_players")
    return churn.agg(
        F.count(F.lit(1)).alias("total_players"),
        F.count_if(F.col("churn_risk_score") >= HIGH_RISK).alias("high_risk_players"),
        F.avg("churn_risk_score").alias("avg_risk_score"),
    ).withColumn("high_risk_pct", F.when(total > 0, high / total * 100).otherwise(F.lit(0.0)))


def overview_kpis(
    events: DataFrame, profiles: DataFrame, as_of: When, segment: str = "all"
) -> DataFrame:
    """Headline row: players and high-risk players of a segment, mean DAU, funnel conversion."""
    churn = filter_churn(churn_table(profiles, as_of), [segment])
    mean_dau = engagement_timeline(events).agg(F.avg("dau").alias("avg_dau")).scalar()
    ends = milestone_funnel(events).agg(
        F.try_divide(F.max_by("players", "stage_order"), F.min_by("players", "stage_order")).alias("c")
    )
    return churn.agg(
        F.count(F.lit(1)).alias("total_players"),
        F.count_if(F.col("churn_risk_score") >= HIGH_RISK).alias("high_risk_players"),
    ).select(
        "*", mean_dau.alias("avg_dau"), F.coalesce(ends.scalar(), F.lit(0.0)).alias("funnel_conversion")
    )
