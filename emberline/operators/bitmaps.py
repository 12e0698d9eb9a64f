"""A bitmap index of active players: distinct counts and retention as unions of stored bitmaps.

Players get dense numbers in the order of their cohorts. One row of the index is the set of players of
one cohort (registration date and segments) that were active on one day, as bits of one range of
numbers. As a cohort's numbers stand together, a cohort's row is one bitmap or a few. Any range of
days, weeks or months is then an OR of bitmaps, and nobody's days are shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions.columns import behavior_segment, spend_segment
from emberline.functions.times import When, as_date, date_lit
from emberline.operators import cohorts
from emberline.operators.retention import RETENTION_DAYS, session_in_day_window
from emberline.operators.rollups import active_days, registrations, session_days
from emberline.sources.storage import work_folder

#: A cohort of the index; all null for players without a profile.
COHORT = ("cohort_date", "behavior", "spend")
#: Kinds of rows: registered players; active by events or by sessions on a day; with a session at a day's
#: midnight; with a session n days after registration (``at_n``).
MEMBER, EVENT, SESSION, MIDNIGHT, ELAPSED = "member", "event", "session", "midnight", "elapsed"


def _staged(df: DataFrame) -> DataFrame:
    folder = f"{work_folder(df.sparkSession)}/table"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def number_players(people: DataFrame, active: DataFrame) -> DataFrame:
    """``number`` from 1 without gaps for each player of ``people`` or ``active``, with the columns of ``people``, by cohort."""
    columns = [c for c in people.columns if c != "player_id"]
    every = people.unionByName(active.select("player_id").distinct(), allowMissingColumns=True)
    once = every.groupBy("player_id").agg(F.max(F.struct(*columns)).alias("home")).select("player_id", "home.*")
    order = [*COHORT, "player_id"]
    placed = _staged(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    # the upper bits of a place are the partition's number; there are as many rows as partitions
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    rows = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    starts = rows.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    numbered = placed.withColumn("part", part).join(starts, "part")
    return _staged(numbered.select("player_id", *columns, (F.col("before") + nth + 1).alias("number")))


def _bits(rows: DataFrame, keys: list[str]) -> DataFrame:
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return rows.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("players"))


def build_index(profiles: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """kind, at (a day), at_n, the cohort, bucket and players: one scan of each fact table.

    Facts are reduced to player-days on the map side and stored before players are numbered. Rows of players
    without a registration have no cohort. Player ids are unique in the profiles.
    """
    people = registrations(profiles, "registration_date", behavior_segment().alias("behavior"), spend_segment().alias("spend"))
    session_rows = session_days(sessions).drop("sessions").withColumn("kind", F.lit(SESSION))
    days = _staged(session_rows.unionByName(active_days(events).withColumn("kind", F.lit(EVENT)), allowMissingColumns=True))
    players = number_players(people, days)
    joined = days.join(players, "player_id")
    at_midnight = F.col("first_start") == F.col("activity_date").cast("timestamp_ntz")
    hits = [(F.coalesce(session_in_day_window(n), F.lit(False)), ELAPSED, F.lit(None).cast("date"), F.lit(n)) for n in RETENTION_DAYS]
    nothing = F.lit(None).cast("int")
    found = [(F.lit(True), F.col("kind"), F.col("activity_date"), nothing), (at_midnight, MIDNIGHT, F.col("activity_date"), nothing), *hits]
    rows = [
        F.when(F.coalesce(holds, F.lit(False)), F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), at.alias("at"), n.alias("at_n")))
        for holds, kind, at, n in found
    ]
    active = joined.select(*COHORT, "number", F.inline(F.array_compact(F.array(*rows))))
    members = players.where(F.col("cohort_date").isNotNull()).select(
        *COHORT, "number", F.lit(MEMBER).alias("kind"), F.lit(None).cast("date").alias("at"), nothing.alias("at_n")
    )
    return _bits(active.unionByName(members), ["kind", "at", "at_n", *COHORT])


def write_index(index: DataFrame, path: str) -> None:
    """Store the index; queries read the kinds they need."""
    index.write.mode("overwrite").partitionBy("kind").parquet(path)


def players(rows: DataFrame, keys: dict[str, Column], name: str = "players") -> DataFrame:
    """Distinct players of the index rows for each value of ``keys``."""
    united = rows.groupBy(*[c.alias(k) for k, c in keys.items()], "bucket").agg(F.bitmap_or_agg("players").alias("united"))
    return united.groupBy(*keys).agg(F.sum(F.bitmap_count("united")).alias(name))


# ---------------------------------------------------------------- queries


def dau(index: DataFrame, start: When, end: When) -> DataFrame:
    """As :func:`activity.dau`."""
    rows = index.where((F.col("kind") == SESSION) & F.col("at").between(date_lit(start), date_lit(end)))
    return players(rows, {"activity_date": F.col("at")}, "dau_count").orderBy("activity_date")


def wau(index: DataFrame, start: When, end: When, inclusive_end: bool = False) -> DataFrame:
    """As :func:`activity.wau`: by default only the midnight of the last day is counted."""
    whole = (F.col("kind") == SESSION) & (F.col("at") >= date_lit(start))
    whole &= (F.col("at") <= date_lit(end)) if inclusive_end else (F.col("at") < date_lit(end))
    last = F.lit(False) if inclusive_end else (F.col("kind") == MIDNIGHT) & (F.col("at") == date_lit(end))
    return players(index.where(whole | last), {"week_start": F.trunc("at", "week")}, "wau_count").orderBy("week_start")


def _retained(index: DataFrame, kind: str, keys: dict[str, Column], offsets: dict[int, Column]) -> DataFrame:
    """cohort_size and retained_n for the cohorts ``keys``; ``offsets`` tell which rows of ``kind`` count for n."""
    none = F.lit(None).cast("int")
    which = F.coalesce(*[F.when(holds, F.lit(n)) for n, holds in offsets.items()])
    step = F.when(F.col("kind") == MEMBER, F.lit(0)).when(F.col("kind") == kind, which).otherwise(none)
    rows = index.where(F.col("kind").isin(MEMBER, kind) & F.col("cohort_date").isNotNull()).withColumn("step", step).where("step is not null")
    counted = players(rows, {**keys, "step": F.col("step")})

    def of(n: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("step") == n, F.col("players"))), F.lit(0))

    return counted.groupBy(*keys).agg(of(0).alias("cohort_size"), *[of(n).alias(f"retained_{n}") for n in offsets])


def _rates(days: tuple[int, ...]) -> list[Column]:
    return [(F.col(f"retained_{n}") / F.col("cohort_size")).alias(f"day_{n}_retention") for n in days]


def cohort_retention(index: DataFrame, start: When, end: When, segment: str | None = None, behavior: str | None = None) -> DataFrame:
    """As :func:`retention.cohort_retention`; with ``behavior`` as :func:`retention.retention_by_segment`."""
    rows = index.where(F.col("cohort_date").between(date_lit(as_date(start)), date_lit(as_date(end))))
    if behavior is not None:
        rows = rows.where(F.col("behavior") == behavior)
    counts = _retained(rows, ELAPSED, {"cohort_date": F.col("cohort_date")}, {n: F.col("at_n") == n for n in RETENTION_DAYS})
    label = F.lit(segment if behavior is None else behavior).cast("string").alias("segment")
    return counts.select("cohort_date", *_rates(RETENTION_DAYS), "cohort_size", label).orderBy("cohort_date")


def _calendar(index: DataFrame, label: Column, period: str | None, later: Callable[[Column, int], Column], steps: tuple[int, ...]) -> DataFrame:
    def start(day: str) -> Column:
        return F.trunc(day, period) if period else F.col(day)

    offsets = {n: start("at") == later(start("cohort_date"), step) for n, step in zip(RETENTION_DAYS, steps, strict=True)}
    counts = _retained(index, EVENT, {"cohort_date": start("cohort_date"), "segment": label}, offsets)
    n1, n7, n30 = (F.col(f"retained_{n}") for n in RETENTION_DAYS)
    return counts.select("cohort_date", *_rates(RETENTION_DAYS), "cohort_size", "segment", ((n7 <= n1) & (n30 <= n7)).alias("is_monotone"))


def _days_later(day: Column, n: int) -> Column:
    return F.date_add(day, n)


def daily_retention(index: DataFrame) -> DataFrame:
    return _calendar(index, F.lit("all"), None, _days_later, RETENTION_DAYS).orderBy("cohort_date")


def weekly_retention(index: DataFrame) -> DataFrame:
    return _calendar(index, F.lit("weekly"), "week", _days_later, (7, 14, 28)).orderBy("cohort_date")


def monthly_retention(index: DataFrame) -> DataFrame:
    return _calendar(index, F.lit("monthly"), "month", F.add_months, (1, 2, 3)).orderBy("cohort_date")


def segment_retention(index: DataFrame) -> DataFrame:
    return _calendar(index, F.col("spend"), None, _days_later, RETENTION_DAYS).orderBy("segment", "cohort_date")


def cohort_table(index: DataFrame) -> DataFrame:
    """As :func:`cohorts.cohort_table`."""
    rows = index.where(F.col("kind").isin(MEMBER, EVENT) & F.col("cohort_date").isNotNull())
    day = F.coalesce(F.date_diff("at", "cohort_date"), F.lit(cohorts.SIZE_ROW))
    return cohorts.table_of_counts(players(rows, {"cohort_date": F.col("cohort_date"), "day": day}))
