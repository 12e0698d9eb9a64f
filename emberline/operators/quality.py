"""Data-quality checks: each yields rows (ordinal, rule_name, passed, value, ...)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.columns import SESSION_TYPES
from emberline.functions.text import fixed, percent
from emberline.functions.times import When, elapsed_days, ts_lit

SEVERITIES = ("info", "warning", "error", "critical")
MAX_DURATION = 86400


@dataclass(frozen=True)
class Rule:
    description: str
    threshold: float
    severity: str
    enabled: bool = True


# Default rules with their thresholds and severities.
DEFAULT_RULES = {
    "missing_player_ids": Rule("Percentage of events with missing player IDs", 0.01, "error"),
    "missing_timestamps": Rule("Percentage of events with missing timestamps", 0.001, "critical"),
    "missing_event_types": Rule("Percentage of events with missing event types", 0.001, "critical"),
    "duplicate_events": Rule("Percentage of duplicate events", 0.05, "warning"),
    "future_timestamps": Rule("Percentage of events with future timestamps", 0.001, "error"),
    "invalid_session_durations": Rule("Percentage of sessions with invalid durations", 0.02, "warning"),
    "orphaned_events": Rule("Percentage of events without corresponding player profiles", 0.05, "warning"),
    "inactive_player_events": Rule("Percentage of events from players inactive >90 days", 0.1, "info"),
    "daily_event_volume_drop": Rule("Daily event volume drop percentage", 0.3, "error"),
    "hourly_event_volume_spike": Rule("Hourly event volume spike percentage", 5.0, "warning"),
}


@dataclass(frozen=True)
class QualityConfig:
    """Immutable rule set; the ``with_`` methods return an adjusted copy."""

    rules: dict[str, Rule] = field(default_factory=lambda: dict(DEFAULT_RULES))

    def active(self, name: str) -> Rule | None:
        rule = self.rules.get(name)
        return rule if rule and rule.enabled else None

    def with_threshold(self, name: str, threshold: float) -> QualityConfig:
        return self._changed(name, threshold=threshold)

    def with_enabled(self, name: str, enabled: bool = True) -> QualityConfig:
        return self._changed(name, enabled=enabled)

    def _changed(self, name: str, **change) -> QualityConfig:
        if name not in self.rules:
            raise KeyError(f"unknown quality rule: {name}")
        return QualityConfig({**self.rules, name: replace(self.rules[name], **change)})

    def as_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, r.description, r.threshold, r.severity, r.enabled) for n, r in self.rules.items()]
        return spark.createDataFrame(
            rows, "rule_name string, description string, threshold double, severity string, enabled boolean"
        )


DEFAULTS = QualityConfig()


def _row(
    ordinal: int,
    name: str,
    value: Column,
    threshold: float,
    severity: str,
    message: Column,
    passed: Column | None = None,
    details: Column | None = None,
) -> Column:
    """One check result as a struct column."""
    return F.struct(
        F.lit(ordinal).alias("ordinal"),
        F.lit(name).alias("rule_name"),
        (value <= threshold if passed is None else passed).alias("passed"),
        value.cast("double").alias("value"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        (F.lit(None).cast("string") if details is None else details).alias("details"),
    )


def _share(part: Column, total: Column) -> Column:
    """part / total as a double; null (no row is emitted) when there is nothing to divide."""
    return F.try_divide(part, total)


def _found(count: Column, what: str, share: Column) -> Column:
    return F.concat(F.lit("Found "), count.cast("string"), F.lit(f" {what} ("), percent(share, 2), F.lit(")"))


#: missing-value rule -> (ordinal, column)
_MISSING = {
    "missing_player_ids": (1, "player_id"),
    "missing_timestamps": (2, "timestamp"),
    "missing_event_types": (3, "event_type"),
}


def _alike(events: DataFrame, flags: dict[str, Column], keys: list[str], extra: dict[str, Column], exact: bool) -> DataFrame:
    """One row for all rows that are equal: how many (``copies``) and, in ``flags``, which conditions hold for them.

    Equal rows meet by a digest of 128 bits, nulls included, so little is shuffled whatever the width of a row; with
    ``exact`` by all their columns. Flags are a function of the row, so they never part equal rows.
    """
    columns = [F.col(c) for c in events.columns]
    digests = [F.xxhash64(F.lit(salt), *columns, *[c.isNull() for c in columns]).alias(f"digest{salt}") for salt in (1, 2)]
    same = columns if exact else [*[F.col(k) for k in keys], *digests]
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(flags.values())), F.lit(0))
    return events.groupBy(*same, bits.alias("flags")).agg(F.count(F.lit(1)).alias("copies"), *[c.alias(n) for n, c in extra.items()])


def _flagged(flags: dict[str, Column]) -> dict[str, Column]:
    """For each condition the number of rows it holds for, over the output of :func:`_alike`."""
    return {
        name: F.coalesce(F.sum(F.when(F.col("flags").bitwiseAND(1 << i) != 0, F.col("copies"))), F.lit(0))
        for i, name in enumerate(flags)
    }


def _conditions(columns: list[str], as_of: When | None) -> dict[str, Column]:
    """What is counted of the event rows."""
    in_session = F.col("event_type").isin(*SESSION_TYPES)
    found = {"sessions": in_session} | {f"no_{c}": F.col(c).isNull() for _, c in _MISSING.values()}
    if as_of is not None:
        found["future"] = F.col("timestamp") > ts_lit(as_of)
    if "session_duration" in columns:
        length = F.col("session_duration")
        found["bad_durations"] = in_session & ((length < 0) | (length > MAX_DURATION))
    return {name: F.coalesce(c, F.lit(False)) for name, c in found.items()}


def _result_rows(config: QualityConfig, names: list[str], has_durations: bool) -> list[Column]:
    total, rows = F.col("total"), []
    for name in names:
        rule = config.active(name)
        if rule is None:
            continue
        if name in _MISSING:
            ordinal, column = _MISSING[name]
            share = _share(F.col(f"no_{column}"), total)
            text = _found(F.col(f"no_{column}"), f"missing {column} values", share)
        elif name == "duplicate_events":
            ordinal, share = 4, _share(F.col("duplicates"), total)
            text = _found(F.col("duplicates"), "duplicate events", share)
        elif name == "future_timestamps":
            ordinal, share = 5, _share(F.col("future"), total)
            text = _found(F.col("future"), "events with future timestamps", share)
        else:
            ordinal = 6
            nothing = F.lit("No session duration data available for validation")
            if has_durations:
                known = F.col("sessions") > 0
                share = F.coalesce(_share(F.col("bad_durations"), F.col("sessions")), F.lit(0.0))
                found = _found(F.col("bad_durations"), "sessions with invalid durations", share)
                text = F.when(known, found).otherwise(nothing)
            else:
                share, text = F.lit(0.0), nothing
        rows.append(_row(ordinal, name, share, rule.threshold, rule.severity, text))
    return rows


def _empty_row(name: str, severity: str, message: str) -> Column:
    return _row(0, name, F.lit(0.0), 1.0, severity, F.lit(message), passed=F.lit(False))


EVENT_CHECKS = [*_MISSING, "duplicate_events", "future_timestamps", "invalid_session_durations"]


def event_checks(
    events: DataFrame, as_of: When, config: QualityConfig = DEFAULTS, names: list[str] | None = None, exact: bool = False
) -> DataFrame:
    """The event suite in one scan.

    Without the duplicate check, nothing but one row is shuffled. With it, a digest per row is, and all other
    checks are summed over the same groups of equal rows; ``exact`` compares whole rows instead of digests.
    """
    names = EVENT_CHECKS if names is None else names
    if "duplicate_events" in names and config.active("duplicate_events"):
        flags = _conditions(events.columns, as_of)
        copies = {"total": F.coalesce(F.sum("copies"), F.lit(0)), "duplicates": F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))}
        measured = _alike(events, flags, [], {}, exact).agg(*[m.alias(n) for n, m in (copies | _flagged(flags)).items()])
    else:
        counted = {"total": F.lit(True), **_conditions(events.columns, as_of)}
        measured = events.agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    rows = _result_rows(config, names, "session_duration" in events.columns)
    empty = _empty_row("empty_dataset", "critical", "Events dataset is empty")
    results = F.when(F.col("total") == 0, F.array(empty))
    if rows:
        results = results.otherwise(F.array(*rows))
    return measured.select(F.inline(results)).orderBy("ordinal")


def missing_values(events: DataFrame, as_of: When, config: QualityConfig = DEFAULTS) -> DataFrame:
    return event_checks(events, as_of, config, list(_MISSING))


def duplicates(events: DataFrame, as_of: When, config: QualityConfig = DEFAULTS, exact: bool = False) -> DataFrame:
    return event_checks(events, as_of, config, ["duplicate_events"], exact)


def future_timestamps(events: DataFrame, as_of: When, config: QualityConfig = DEFAULTS) -> DataFrame:
    return event_checks(events, as_of, config, ["future_timestamps"])


def session_durations(events: DataFrame, as_of: When, config: QualityConfig = DEFAULTS) -> DataFrame:
    return event_checks(events, as_of, config, ["invalid_session_durations"])


def critical_event_checks(events: DataFrame, as_of: When, config: QualityConfig = DEFAULTS) -> DataFrame:
    """The event checks that can stop a load: those of critical severity, and emptiness."""
    names = [n for n in EVENT_CHECKS if (rule := config.active(n)) and rule.severity == "critical"]
    return event_checks(events, as_of, config, names)


def empty_inputs(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """A row for each input that has no rows at all."""

    def check(df: DataFrame, row: Column) -> DataFrame:
        # limit(1) keeps the emptiness test from counting the table
        return df.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.inline(F.array(row)))

    return check(events, _empty_row("empty_dataset", "critical", "Events dataset is empty")).unionByName(
        check(profiles, _empty_row("empty_profiles", "error", "Player profiles dataset is empty"))
    )


def profile_checks(profiles: DataFrame) -> DataFrame:
    """Share of repeated player ids; a null id counts as an id."""
    counted = profiles.groupBy("player_id").agg(F.count(F.lit(1)).alias("copies"))
    sums = counted.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated"),
    )
    share = _share(F.col("repeated"), F.col("total"))
    row = _row(7, "duplicate_player_profiles", share, 0.0, "error",
               _found(F.col("repeated"), "duplicate player profiles", share))
    empty = _empty_row("empty_profiles", "error", "Player profiles dataset is empty")
    return sums.select(F.inline(F.array(F.when(F.col("total") == 0, empty).otherwise(row))))


def consistency_checks(events: DataFrame, profiles: DataFrame, config: QualityConfig = DEFAULTS) -> DataFrame:
    """Share of events whose player has no profile (a null player never has one)."""
    rule = config.active("orphaned_events")
    per_player = events.groupBy("player_id").agg(F.count(F.lit(1)).alias("events"))
    known = profiles.select("player_id").distinct().withColumn("known", F.lit(True))
    orphan = F.col("known").isNull()
    sums = per_player.join(known, "player_id", "left").agg(
        F.sum("events").alias("total"),
        F.coalesce(F.sum(F.when(orphan, F.col("events"))), F.lit(0)).alias("orphans"),
        F.count_if(orphan).alias("orphan_players"),
    )
    if rule is None:
        return sums.select(F.inline(F.array(_empty_row("", "", "")))).where("false")
    share = _share(F.col("orphans"), F.col("total"))
    details = F.to_json(F.struct(F.col("orphan_players").alias("orphaned_player_count")))
    row = _row(8, "orphaned_events", share, rule.threshold, rule.severity,
               _found(F.col("orphans"), "orphaned events", share), details=details)
    return sums.where("total > 0").select(F.inline(F.array(row)))


def inactive_player_events(
    events: DataFrame, profiles: DataFrame, as_of: When, config: QualityConfig = DEFAULTS, days: int = 90
) -> DataFrame:
    """Share of events whose player was last active more than ``days`` whole days before ``as_of``.

    Events of a player without a profile count as events only. No events, or the rule switched off: no row.
    """
    rule = config.active("inactive_player_events")
    gone = profiles.where(elapsed_days(F.col("last_active_date"), ts_lit(as_of)) > days).select("player_id").distinct()
    per_player = events.groupBy("player_id").agg(F.count(F.lit(1)).alias("events"))
    left = per_player.join(gone.withColumn("gone", F.lit(True)), "player_id", "left")
    sums = left.agg(
        F.sum("events").alias("total"),
        F.coalesce(F.sum(F.when(F.col("gone"), F.col("events"))), F.lit(0)).alias("inactive"),
        F.count_if("gone").alias("players"),
    )
    share = _share(F.col("inactive"), F.col("total"))
    details = F.to_json(F.struct(F.col("players").alias("inactive_player_count")))
    threshold, severity = (rule.threshold, rule.severity) if rule else (0.0, "")
    row = _row(11, "inactive_player_events", share, threshold, severity,
               _found(F.col("inactive"), "events from inactive players", share), details=details)
    return sums.where((F.col("total") > 0) & F.lit(rule is not None)).select(F.inline(F.array(row)))


def _hourly_volume(events: DataFrame) -> DataFrame:
    """Events per (date, hour): the common ground of the two volume checks."""
    timed = events.where(F.col("timestamp").isNotNull())
    return timed.groupBy(F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("volume")
    )


def daily_volume_drop(events: DataFrame, history: DataFrame, config: QualityConfig = DEFAULTS) -> DataFrame:
    """A failed row for each day far below the mean daily volume of ``history``."""
    rule = config.active("daily_event_volume_drop")

    def daily(df: DataFrame) -> DataFrame:
        return _hourly_volume(df).groupBy("date").agg(F.sum("volume").alias("volume"))

    typical = daily(history).agg(F.avg("volume").alias("typical")).scalar()
    drops = (
        daily(events)
        .withColumn("typical", typical)
        .withColumn("drop", (F.col("typical") - F.col("volume")) / F.col("typical"))
        .where(F.col("drop") > (rule.threshold if rule else float("inf")))
    )
    severity, threshold = (rule.severity, rule.threshold) if rule else ("error", 0.3)
    details = F.to_json(
        F.struct(F.col("date").cast("string").alias("date"), "volume", F.round("typical", 4).alias("historical_avg"))
    )
    message = F.concat(
        F.lit("Daily volume drop of "), percent(F.col("drop"), 1), F.lit(" on "), F.col("date").cast("string")
    )
    row = _row(9, "daily_event_volume_drop", F.col("drop"), threshold, severity, message, F.lit(False), details)
    return drops.select(F.inline(F.array(row))).orderBy("message")


def hourly_spike(events: DataFrame, config: QualityConfig = DEFAULTS) -> DataFrame:
    """Peak over mean volume by hour of day; no row when at most one hour has events."""
    rule = config.active("hourly_event_volume_spike") or Rule("", 5.0, "warning", False)
    hours = (
        _hourly_volume(events)
        .groupBy("hour")
        .agg(F.sum("volume").alias("volume"))
        .agg(F.count(F.lit(1)).alias("hours"), F.max("volume").alias("peak"), F.avg("volume").alias("mean"))
        .where((F.col("hours") > 1) & F.lit(rule.enabled))
    )
    ratio = F.col("peak") / F.col("mean")
    message = F.concat(F.lit("Hourly volume spike of "), fixed(ratio, 1), F.lit("x average detected"))
    row = _row(10, "hourly_event_volume_spike", ratio, rule.threshold, rule.severity, message)
    return hours.select(F.inline(F.array(row)))


def volume_checks(
    events: DataFrame, history: DataFrame | None = None, config: QualityConfig = DEFAULTS
) -> DataFrame:
    spikes = hourly_spike(events, config)
    return spikes if history is None else daily_volume_drop(events, history, config).unionByName(spikes)


def all_checks(
    events: DataFrame,
    profiles: DataFrame,
    as_of: When,
    history: DataFrame | None = None,
    config: QualityConfig = DEFAULTS,
) -> DataFrame:
    """Every suite, as one table of check rows."""
    suites = [
        event_checks(events, as_of, config),
        profile_checks(profiles),
        consistency_checks(events, profiles, config),
        volume_checks(events, history, config),
    ]
    return reduce(DataFrame.unionByName, suites)


# Recommendation texts.
RECOMMEND_CRITICAL = "CRITICAL: Address data completeness issues immediately"
RECOMMEND_ERROR = "ERROR: Review data ingestion pipeline for consistency issues"
RECOMMEND_BY_RULE = {
    "orphaned_events": "Ensure player profile creation precedes event ingestion",
    "duplicate_events": "Implement event deduplication in ingestion pipeline",
    "future_timestamps": "Validate timestamp formats and timezone handling",
}


def quality_report(checks: DataFrame) -> DataFrame:
    """One row: totals, failures per severity, failed checks, recommendations."""
    failed = ~F.col("passed")
    advice = F.lit(None).cast("string")
    for name, text in RECOMMEND_BY_RULE.items():
        advice = F.when(F.col("rule_name") == name, text).otherwise(advice)
    issue = F.struct("ordinal", "message", "rule_name", "severity", "value", "threshold", "details")
    sums = checks.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(failed).alias("failed_checks"),
        *[F.count_if(failed & (F.col("severity") == s)).alias(f"{s}_failed") for s in SEVERITIES],
        F.array_sort(F.collect_list(F.when(failed, issue))).alias("issues"),
        F.array_sort(
            F.collect_list(F.when(failed & advice.isNotNull(), F.struct("ordinal", advice.alias("text"))))
        ).alias("advice"),
    )
    general = F.array_compact(
        F.array(
            F.when(F.col("critical_failed") > 0, RECOMMEND_CRITICAL),
            F.when(F.col("error_failed") > 0, RECOMMEND_ERROR),
        )
    )
    return sums.withColumn("recommendations", F.concat(general, F.col("advice.text"))).drop("advice")


def profile_summary(events: DataFrame, profiles: DataFrame, as_of: When) -> DataFrame:
    """One row of ingestion statistics with the list of issues found."""
    # equal rows, then players: the events are read once
    flags = {"future_events": F.coalesce(F.col("timestamp") > ts_lit(as_of), F.lit(False))}
    instants = {"first_event": F.min("timestamp"), "last_event": F.max("timestamp")}
    rows = _alike(events, flags, ["player_id"], instants, False)
    per_player = rows.groupBy("player_id").agg(
        F.sum("copies").alias("total_events"),
        F.sum(F.col("copies") - 1).alias("duplicate_events"),
        *[c.alias(n) for n, c in _flagged(flags).items()],
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
    )
    known = profiles.groupBy("player_id").agg(F.count(F.lit(1)).alias("profiles"))
    counts = ["total_events", "duplicate_events", "future_events"]
    both = per_player.unionByName(known, allowMissingColumns=True).groupBy("player_id").agg(
        *[F.sum(c).alias(c) for c in (*counts, "profiles")], F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"),
    )
    no_events = F.col("total_events").isNull()
    columns = both.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
        F.coalesce(F.sum("profiles"), F.lit(0)).alias("total_players"),
        F.count_if(F.col("profiles").isNull()).alias("players_without_profile"),
        F.count_if(no_events).alias("players_without_events"),
    )

    def issue(count: str, before: str, after: str) -> Column:
        return F.when(F.col(count) > 0, F.concat(F.lit(before), F.col(count).cast("string"), F.lit(after)))

    return columns.withColumn(
        "issues",
        F.array_compact(
            F.array(
                issue("players_without_profile", "Events found for ", " players without profiles"),
                issue("players_without_events", "", " players have profiles but no events"),
                issue("duplicate_events", "", " duplicate events found"),
                issue("future_events", "", " events have future timestamps"),
            )
        ),
    )


def event_type_counts(events: DataFrame) -> DataFrame:
    """Events per type, most frequent first."""
    return (
        events.where(F.col("event_type").isNotNull())
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.desc("events"), "event_type")
    )
