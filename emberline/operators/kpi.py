"""Daily KPI series, trailing baselines, alerts and report rows.

KPIs are computed for a *range* of dates in one job that reads the sessions
once: they are reduced to (player, day), looked at per player, and turned into
amounts that add up per date. Questions of the form "how many players satisfy X
on date d" are answered by the date on which a player starts to satisfy X and a
running sum over the calendar, so no player is ever paired with every date.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.functions.text import fixed, grouped, percent, title
from emberline.functions.times import When, as_date, date_lit, month_start, ts_lit, week_start
from emberline.operators.retention import RETENTION_DAYS, cohort_retention, session_in_day_window
from emberline.operators.rollups import session_days

# KPI names in reporting order, and the look-back of the baseline.
REPORTED = (
    "dau",
    "wau",
    "mau",
    "churn_rate",
    "day_1_retention",
    "day_7_retention",
    "day_30_retention",
    "new_registrations",
)
STORED = (*REPORTED, "total_active_players")
BASELINE_DAYS = 30
COHORT_DAYS = 30
CHURN_LOOKBACK = 7

#: Additive per-date amounts the KPIs are made of.
_PARTS = (
    "dau",
    "week_first",
    "month_first",
    "registered",
    "churned",
    "new_registrations",
    "cohort_size",
    *(f"retained_{n}" for n in RETENTION_DAYS),
)


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    days = (end - start).days + 1
    return spark.range(max(days, 0)).select(F.date_add(date_lit(start), F.col("id").cast("int")).alias("metric_date"))


def _player_timeline(profiles: DataFrame | None, sessions: DataFrame | None) -> DataFrame:
    """Player-days with, as one more row of the player, the profile.

    Stacking the two and looking at them through windows over the player brings
    them together with a single shuffle of the rollup. A player has at most one
    row per calendar day plus one, however many sessions there are.
    """
    sides = []
    if sessions is not None:
        sides.append(session_days(sessions).drop("sessions"))
    if profiles is not None:
        people = profiles.where(F.col("player_id").isNotNull() & F.col("registration_date").isNotNull())
        sides.append(people.select("player_id", "registration_date", "last_active_date"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    absent = {
        name: F.lit(None).cast(kind)
        for name, kind in (
            ("activity_date", "date"),
            ("first_start", "timestamp_ntz"),
            ("last_start", "timestamp_ntz"),
            ("registration_date", "timestamp_ntz"),
            ("last_active_date", "timestamp_ntz"),
        )
        if name not in stacked.columns
    }
    return stacked.withColumns(absent) if absent else stacked


def _first_of_period(previous: Column, period) -> Column:
    day = F.col("activity_date")
    return previous.isNull() | (period(previous) < period(day))


def _contributions(
    timeline: DataFrame, wanted: set[str], first: dt.date, churn_lookback: int, inclusive_week_end: bool
) -> DataFrame:
    """(date, part, amount) rows whose sums per date and part make up the KPIs.

    ``month_first`` and ``week_first`` mark a player's first day in a month and
    week; ``registered`` and ``churned`` the date from which a player counts.
    """
    by_player = Window.partitionBy("player_id")
    day, registration = F.col("activity_date"), F.col("registration_date")
    known = F.max(registration).over(by_player)
    columns = {"previous_day": F.lag(day).over(by_player.orderBy(day)), "last_session": F.max(day).over(by_player)}
    retention = wanted & {f"day_{n}_retention" for n in RETENTION_DAYS}
    if retention:
        rows = timeline.withColumn("joined", known)
        hits = {n: session_in_day_window(n, registered="joined") for n in RETENTION_DAYS}
        columns |= {
            f"day_{n}": F.max(F.coalesce(hit, F.lit(False)).cast("bigint")).over(by_player) for n, hit in hits.items()
        }
    else:
        rows = timeline
    rows = rows.withColumns(columns)

    parts: list[tuple[Column, str, Column]] = []
    previous = F.col("previous_day")
    if wanted & {"dau", "total_active_players"}:
        parts.append((day, "dau", F.lit(1)))
    if "mau" in wanted:
        parts.append((day, "month_first", _first_of_period(previous, month_start).cast("bigint")))
    if "wau" in wanted:
        # the week runs from Monday's to Sunday's midnight: other activity on Sunday is not counted
        at_midnight = F.col("first_start") == day.cast("timestamp_ntz")
        counted = F.lit(True) if inclusive_week_end else (F.weekday(day) < 6) | at_midnight
        starts = (_first_of_period(previous, week_start) & counted).cast("bigint")
        parts.append((week_start(day), "week_first", starts))
    cohort = F.to_date(registration)
    if "new_registrations" in wanted:
        parts.append((cohort, "new_registrations", F.lit(1)))
    if retention:
        parts.append((cohort, "cohort_size", F.lit(1)))
        parts += [(cohort, f"retained_{n}", F.col(f"day_{n}")) for n in RETENTION_DAYS]
    if "churn_rate" in wanted:
        # registered on date d: registration <= d's midnight. Churned: moreover the last
        # session day and the last active instant lie before d - lookback days.
        counted_from = F.when(registration > cohort.cast("timestamp_ntz"), F.date_add(cohort, 1)).otherwise(cohort)
        churned_from = F.greatest(  # greatest() skips the null of "no session"
            counted_from,
            F.date_add(F.to_date("last_active_date"), churn_lookback + 1),
            F.date_add("last_session", churn_lookback + 1),
        )
        since = date_lit(first)
        parts.append((F.greatest(counted_from, since), "registered", registration.isNotNull().cast("bigint")))
        churned = registration.isNotNull() & F.col("last_active_date").isNotNull()
        parts.append((F.greatest(churned_from, since), "churned", churned.cast("bigint")))
    structs = [
        F.struct(date.alias("metric_date"), F.lit(name).alias("part"), amount.cast("bigint").alias("amount"))
        for date, name, amount in parts
    ]
    return rows.select(F.inline(F.array(*structs))).where(F.col("metric_date").isNotNull() & (F.col("amount") > 0))


def _sessions_that_matter(wanted: set[str], first: dt.date, last: dt.date, churn_lookback: int) -> Column:
    """A pushable range of ``start_time`` outside of which no session changes a KPI from ``first`` to ``last``.

    A last session before the lower bound makes a player churned from ``first`` on at the latest,
    as no session does. Churn needs the very last session and so has no upper bound; else
    weeks end within six days after ``last`` and the longest retention window 32 days after it.
    """
    matters = F.col("start_time") >= ts_lit(first - dt.timedelta(days=churn_lookback + 1))
    if "churn_rate" not in wanted:
        ahead = max(RETENTION_DAYS) + 2 if wanted & {f"day_{n}_retention" for n in RETENTION_DAYS} else 7
        matters &= F.col("start_time") < ts_lit(last + dt.timedelta(days=ahead + 1))
    return matters


def kpi_series(
    profiles: DataFrame,
    sessions: DataFrame,
    start: When,
    end: When,
    metrics: tuple[str, ...] = STORED,
    churn_lookback: int = CHURN_LOOKBACK,
    inclusive_week_end: bool = False,
) -> DataFrame:
    """One row per date in [start, end] with the requested KPI columns, in one pass."""
    first, last = as_date(start), as_date(end)
    wanted = set(metrics)
    # running sums need the month and week so far, trailing ones the cohorts before the first date
    lead_in = min(first.replace(day=1), first - dt.timedelta(days=COHORT_DAYS))
    activity_only = wanted <= {"dau", "wau", "mau", "total_active_players"}
    profiles_only = wanted <= {"new_registrations"}
    reachable = sessions.where(_sessions_that_matter(wanted, lead_in, last, churn_lookback))
    people = profiles
    if profiles_only:
        people = profiles.where(
            (F.col("registration_date") >= ts_lit(lead_in)) & (F.col("registration_date") < ts_lit(last + dt.timedelta(days=1)))
        )
    timeline = _player_timeline(None if activity_only else people, None if profiles_only else reachable)
    facts = _contributions(timeline, wanted, lead_in, churn_lookback, inclusive_week_end)
    spine = calendar(profiles.sparkSession, lead_in, last).select(
        "metric_date", F.lit("calendar").alias("part"), F.lit(0).cast("bigint").alias("amount")
    )

    def part(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == name, F.col("amount"))), F.lit(0)).alias(name)

    per_date = (
        facts.where(F.col("metric_date").between(date_lit(lead_in), date_lit(last)))
        .unionByName(spine)
        .groupBy("metric_date")
        .agg(*[part(p) for p in _PARTS])
    )
    # one row per date from here on: bounded by the calendar
    to_date = Window.partitionBy().orderBy("metric_date")
    in_month = Window.partitionBy(month_start(F.col("metric_date"))).orderBy("metric_date")
    in_week = Window.partitionBy(week_start(F.col("metric_date")))
    trailing = Window.partitionBy().orderBy(F.unix_date("metric_date")).rangeBetween(-COHORT_DAYS, -1)

    def ratio(some: Column, whole: Column) -> Column:
        return F.when(whole > 0, some / whole).otherwise(F.lit(0.0))

    formulas = {
        "dau": lambda: F.col("dau"),
        "wau": lambda: F.sum("week_first").over(in_week),
        "mau": lambda: F.sum("month_first").over(in_month),
        "churn_rate": lambda: ratio(F.sum("churned").over(to_date), F.sum("registered").over(to_date)),
        "new_registrations": lambda: F.col("new_registrations"),
        "total_active_players": lambda: F.col("dau"),
    }
    for n in RETENTION_DAYS:
        formulas[f"day_{n}_retention"] = lambda n=n: ratio(
            F.sum(f"retained_{n}").over(trailing), F.sum("cohort_size").over(trailing)
        )
    return (
        per_date.select("metric_date", *[formulas[m]().alias(m) for m in metrics])
        .where(F.col("metric_date") >= date_lit(first))
        .orderBy("metric_date")
    )


def key_metrics(profiles: DataFrame, sessions: DataFrame, start: When, end: When | None = None) -> DataFrame:
    """All KPIs for one date or a range of dates."""
    return kpi_series(profiles, sessions, start, end or start)


def metric_rows(kpis: DataFrame) -> DataFrame:
    """Long form (metric_date, metric_name, metric_value) at storage precision."""
    pairs = [
        F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("decimal(10,4)").alias("metric_value")) for m in STORED
    ]
    return kpis.select("metric_date", F.inline(F.array(*pairs)))


def metric_baseline(history: DataFrame, lookback: int = BASELINE_DAYS) -> DataFrame:
    """Mean of the preceding ``lookback`` days for every stored metric and date; 0 without history."""
    window = Window.partitionBy("metric_name").orderBy(F.unix_date("metric_date")).rangeBetween(-lookback, -1)
    mean = F.avg(F.col("metric_value").cast("double")).over(window)
    return history.withColumn("baseline_value", F.coalesce(mean, F.lit(0.0)))


def _own_baselines(kpis: DataFrame, lookback: int) -> DataFrame:
    """Baseline columns from the KPI rows themselves, at storage precision."""
    window = Window.partitionBy().orderBy(F.unix_date("metric_date")).rangeBetween(-lookback, -1)
    means = {
        f"base_{m}": F.coalesce(F.avg(F.col(m).cast("decimal(10,4)").cast("double")).over(window), F.lit(0.0))
        for m in REPORTED
    }
    return kpis.select("*", *[c.alias(n) for n, c in means.items()])


def _stored_baselines(kpis: DataFrame, history: DataFrame, lookback: int) -> DataFrame:
    """Baseline columns from a stored metric history (nine rows a day)."""
    targets = kpis.select("metric_date").select(
        "metric_date",
        F.explode(F.array(*[F.lit(m) for m in REPORTED])).alias("metric_name"),
        F.lit(None).cast("decimal(10,4)").alias("metric_value"),
        F.lit(True).alias("target"),
    )
    past = history.select("metric_date", "metric_name", "metric_value", F.lit(False).alias("target"))
    based = (
        metric_baseline(past.unionByName(targets), lookback)
        .where("target")
        .groupBy("metric_date")
        .agg(*[F.max(F.when(F.col("metric_name") == m, F.col("baseline_value"))).alias(f"base_{m}") for m in REPORTED])
    )
    return kpis.join(based, "metric_date", "left").fillna(0.0, [f"base_{m}" for m in REPORTED])


# Significance and breach limits in percent.
SIGNIFICANT = 10.0
MAX_DROP = -20.0
MAX_CHURN_RISE = 25.0
DROP_WATCHED = ("dau", "wau", "mau", "day_1_retention", "day_7_retention", "day_30_retention")


def percentage_change(current: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, F.lit(0.0)).otherwise((current - baseline) / baseline * 100)


def threshold_breached(metric: Column, change: Column) -> Column:
    return (
        F.when(metric.isin(*DROP_WATCHED), change < MAX_DROP)
        .when(metric == "churn_rate", change > MAX_CHURN_RISE)
        .otherwise(F.lit(False))
    )


def alert_severity(change: Column) -> Column:
    size = F.abs(change)
    return F.when(size >= 50, "critical").when(size >= 30, "high").when(size >= 20, "medium").otherwise("low")


def alert_message(metric: Column, change: Column, baseline: Column, current: Column) -> Column:
    return F.concat(
        title(metric),
        F.lit(" has "),
        F.when(change > 0, "increased").otherwise("decreased"),
        F.lit(" by "),
        fixed(F.abs(change), 1),
        F.lit("% from baseline ("),
        fixed(baseline, 2),
        F.lit(" to "),
        fixed(current, 2),
        F.lit(")"),
    )


def _comparisons() -> Column:
    """One struct per reported KPI of the row."""
    pairs = [
        F.struct(
            F.lit(m).alias("metric_name"),
            F.col(m).cast("double").alias("current_value"),
            F.col(f"base_{m}").alias("baseline_value"),
        )
        for m in REPORTED
    ]

    def compare(pair: Column) -> Column:
        name, baseline = pair["metric_name"], pair["baseline_value"]
        change = percentage_change(pair["current_value"], baseline)
        return F.struct(
            name.alias("metric_name"),
            pair["current_value"].alias("current_value"),
            baseline.alias("baseline_value"),
            change.alias("percentage_change"),
            ((baseline != 0) & (F.abs(change) >= SIGNIFICANT)).alias("is_significant"),
            threshold_breached(name, change).alias("threshold_breached"),
        )

    return F.transform(F.array(*pairs), compare)


# Limits and expectations of the two absolute rules.
CHURN_LIMIT, CHURN_EXPECTED = 0.3, 0.15
DAU_LIMIT, DAU_EXPECTED = 100, 500.0


def _alert(key: Column, severity: Column, metric: Column, current, expected, change, message) -> Column:
    return F.struct(
        F.concat_ws("_", key, F.col("metric_date").cast("string")).alias("alert_id"),
        severity.alias("severity"),
        metric.alias("metric_name"),
        current.cast("double").alias("current_value"),
        expected.cast("double").alias("expected_value"),
        change.cast("double").alias("deviation_percentage"),
        message.alias("message"),
    )


def _alerts() -> Column:
    def breach(c: Column) -> Column:
        change, base, now = c["percentage_change"], c["baseline_value"], c["current_value"]
        text = alert_message(c["metric_name"], change, base, now)
        return _alert(c["metric_name"], alert_severity(change), c["metric_name"], now, base, change, text)

    breaches = F.transform(F.filter("comparisons", lambda c: c["threshold_breached"]), breach)
    churn, active = F.col("churn_rate"), F.col("dau")
    churn_text = F.concat(
        F.lit("Critical: Churn rate has reached "), percent(churn, 1), F.lit(", immediate action required")
    )
    dau_text = F.concat(
        F.lit("High: Daily active users dropped to "), active.cast("string"), F.lit(", well below expected levels")
    )
    rules = F.array_compact(
        F.array(
            F.when(
                churn > CHURN_LIMIT,
                _alert(
                    F.lit("high_churn"),
                    F.lit("critical"),
                    F.lit("churn_rate"),
                    churn,
                    F.lit(CHURN_EXPECTED),
                    (churn - CHURN_EXPECTED) / CHURN_EXPECTED * 100,
                    churn_text,
                ),
            ),
            F.when(
                active < DAU_LIMIT,
                _alert(
                    F.lit("low_dau"),
                    F.lit("high"),
                    F.lit("dau"),
                    active,
                    F.lit(DAU_EXPECTED),
                    (active - DAU_EXPECTED) / DAU_EXPECTED * 100,
                    dau_text,
                ),
            ),
        )
    )
    return F.concat(breaches, rules)


def with_comparisons(
    kpis: DataFrame, history: DataFrame | None = None, lookback: int = BASELINE_DAYS
) -> DataFrame:
    """Add ``comparisons`` and ``alerts`` arrays to each KPI row.

    Without a stored ``history`` the KPI rows serve as their own history. All of
    it is expressions on one row per date, so the KPIs are computed once.
    """
    based = _own_baselines(kpis, lookback) if history is None else _stored_baselines(kpis, history, lookback)
    compared = based.withColumn("comparisons", _comparisons())
    return compared.withColumn("alerts", _alerts()).drop(*[f"base_{m}" for m in REPORTED])


def baseline_comparison(kpis: DataFrame, history: DataFrame | None = None) -> DataFrame:
    return with_comparisons(kpis, history).select("metric_date", F.inline("comparisons"))


def alerts(kpis: DataFrame, history: DataFrame | None = None, generated_at: When | None = None) -> DataFrame:
    """Alert rows; ``timestamp`` defaults to the midnight of the metric date."""
    stamp = F.col("metric_date").cast("timestamp_ntz") if generated_at is None else ts_lit(generated_at)
    return with_comparisons(kpis, history).select(
        "metric_date", F.inline("alerts"), stamp.alias("timestamp"), F.lit(False).alias("resolved")
    )


def alerts_to_notify(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.where(F.col("severity").isin("critical", "high"))


def report_cohorts(profiles: DataFrame, sessions: DataFrame, date: When) -> DataFrame:
    """Elapsed-time retention of the cohorts of the last seven days."""
    last = as_date(date)
    return cohort_retention(profiles, sessions, last - dt.timedelta(days=7), last)


def _summary() -> Column:
    def line(label: str, text: Column) -> Column:
        return F.concat(F.lit(f"- {label}: "), text)

    def of_severity(name: str) -> Column:
        return F.size(F.filter("alerts", lambda a: a["severity"] == name))

    head = F.array(
        F.concat(F.lit("Daily Retention Report for "), F.col("metric_date").cast("string")),
        F.lit(""),
        F.lit("Key Metrics:"),
        line("Daily Active Users", grouped(F.col("dau"))),
        line("Weekly Active Users", grouped(F.col("wau"))),
        line("Monthly Active Users", grouped(F.col("mau"))),
        line("Churn Rate", percent(F.col("churn_rate"), 1)),
        line("Day 1 Retention", percent(F.col("day_1_retention"), 1)),
        line("Day 7 Retention", percent(F.col("day_7_retention"), 1)),
        line("Day 30 Retention", percent(F.col("day_30_retention"), 1)),
        line("New Registrations", grouped(F.col("new_registrations"))),
        F.lit(""),
    )
    significant = F.filter("comparisons", lambda c: c["is_significant"])
    changes = F.transform(
        significant,
        lambda c: F.concat(
            F.lit("- "),
            title(c["metric_name"]),
            F.lit(": "),
            F.when(c["percentage_change"] > 0, "↑").otherwise("↓"),
            F.lit(" "),
            fixed(F.abs(c["percentage_change"]), 1),
            F.lit("%"),
        ),
    )
    none = F.array().cast("array<string>")
    change_part = F.when(
        F.size(significant) > 0,
        F.concat(F.array(F.lit("Significant Changes from Baseline:")), changes, F.array(F.lit(""))),
    ).otherwise(none)
    critical, high = of_severity("critical"), of_severity("high")
    alert_part = F.when(
        F.size("alerts") > 0,
        F.array_compact(
            F.array(
                F.concat(F.lit("Alerts Generated: "), F.size("alerts").cast("string")),
                F.when(critical > 0, F.concat(F.lit("- Critical: "), critical.cast("string"))),
                F.when(high > 0, F.concat(F.lit("- High: "), high.cast("string"))),
            )
        ),
    ).otherwise(F.array(F.lit("No alerts generated - all metrics within expected ranges")))
    return F.array_join(F.concat(head, change_part, alert_part), "\n")


def report_summary(kpis: DataFrame, history: DataFrame | None = None) -> DataFrame:
    return with_comparisons(kpis, history).select("metric_date", _summary().alias("summary"))


def daily_reports(
    profiles: DataFrame,
    sessions: DataFrame,
    start: When,
    end: When,
    history: DataFrame | None = None,
    kpis: DataFrame | None = None,
) -> DataFrame:
    """One nested report per date: metrics, comparisons, alerts, recent cohorts, summary."""
    first, last = as_date(start), as_date(end)
    if kpis is None:
        warm_up = first if history is not None else first - dt.timedelta(days=BASELINE_DAYS)
        kpis = kpi_series(profiles, sessions, warm_up, last)
    cohorts = cohort_retention(profiles, sessions, first - dt.timedelta(days=7), last)
    recent = (
        cohorts.select("*", F.explode(F.sequence(F.col("cohort_date"), F.date_add("cohort_date", 7))).alias("report_date"))
        .groupBy("report_date")  # at most eight cohorts per report
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("cohort_date", *[f"day_{n}_retention" for n in RETENTION_DAYS], "cohort_size", "segment")
                )
            ).alias("cohort_analysis")
        )
    )
    reported = with_comparisons(kpis, history).where(F.col("metric_date").between(date_lit(first), date_lit(last)))
    return (
        reported.select(
            F.col("metric_date").alias("report_date"),
            F.struct(F.col("metric_date").alias("date"), *STORED).alias("key_metrics"),
            F.col("comparisons").alias("baseline_comparisons"),
            "alerts",
            _summary().alias("summary"),
        )
        .join(recent, "report_date", "left")
        .orderBy("report_date")
    )


def report_json(reports: DataFrame) -> DataFrame:
    """(report_date, report_data) with the report as one JSON document."""
    body = F.struct("key_metrics", "baseline_comparisons", "alerts", "cohort_analysis", "summary")
    return reports.select("report_date", F.to_json(body).alias("report_data"))


def recent_alerts_summary(alert_rows: DataFrame, as_of: When, days: int = 7) -> DataFrame:
    """Alerts of the last days by severity, most severe first."""
    ranks = F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low")])
    return (
        alert_rows.where(F.col("timestamp") >= F.date_sub(date_lit(as_of), days).cast("timestamp_ntz"))
        .groupBy("severity")
        .agg(
            F.count(F.lit(1)).alias("alert_count"),
            F.count_if(~F.col("resolved")).alias("unresolved_count"),
            F.max("timestamp").alias("latest_alert"),
        )
        .orderBy(F.array_position(ranks, F.col("severity")))
    )


def metrics_trends(history: DataFrame, as_of: When, days: int = 90) -> DataFrame:
    """Each stored value with the values 1, 7 and 30 *rows* before it."""
    by_metric = Window.partitionBy("metric_name").orderBy("metric_date")
    return (
        history.where(F.col("metric_date") >= F.date_sub(date_lit(as_of), days))
        .select(
            "metric_name",
            "metric_date",
            "metric_value",
            F.lag("metric_value", 1).over(by_metric).alias("previous_value"),
            F.lag("metric_value", 7).over(by_metric).alias("week_ago_value"),
            F.lag("metric_value", 30).over(by_metric).alias("month_ago_value"),
        )
        .orderBy("metric_name", F.desc("metric_date"))
    )


def latest_reports(reports: DataFrame, n: int = 5) -> DataFrame:
    """The newest n stored reports with their summary text."""
    return (
        reports.select("report_date", F.get_json_object("report_data", "$.summary").alias("summary"))
        .orderBy(F.desc("report_date"))
        .limit(n)
    )
