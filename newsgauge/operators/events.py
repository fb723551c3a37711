"""Event checks: three rules that differ in the prior value and in the thresholds.

Input series: (month, value), one row per month. The event list is a handful of fixed rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.calendar import month_from_text, month_text
from newsgauge.functions.stats import series_window

Event = tuple[str, str, str]


def event_table(spark: SparkSession, events: Sequence[Event]) -> DataFrame:
    return spark.createDataFrame(list(events), "month string, event string, expected string")


def _percent(current: Column, prior: Column) -> Column:
    return F.when(prior > 0, F.try_divide(current - prior, prior) * 100).otherwise(F.lit(0.0))


def _at_events(series: DataFrame, events: Sequence[Event]) -> DataFrame:
    return event_table(series.sparkSession, events).join(series, "month", "left")


def check_calendar(
    series: DataFrame, events: Sequence[Event] = fixed.CALENDAR_EVENTS
) -> DataFrame:
    """Change against the previous calendar month (or none): spike above +10 %, drop below -10 %."""
    previous = series.select(
        month_text(F.add_months(month_from_text(F.col("month")), 1)).alias("month"),
        F.col("value").alias("_prior"),
    )
    found = _at_events(series.withColumn("_has", F.lit(True)), events).join(previous, "month", "left")
    prior = F.coalesce("_prior", "value")
    change = _percent(F.col("value"), prior)
    passed = F.when(F.col("expected") == "spike", change > 10).otherwise(change < -10)
    return found.select(
        "month", "event", "expected",
        F.round("value", 1).alias("actual"),
        F.when(F.col("_has"), F.round(prior, 1)).alias("prior"),
        F.when(F.col("_has"), F.round(change, 1)).alias("change_percent"),
        F.when(F.col("_has").isNull(), "NO DATA")
        .when(passed, "PASS").otherwise("FAIL").alias("result"),
    )


def check_previous(
    series: DataFrame, events: Sequence[Event] = fixed.REGISTERED_EVENTS
) -> DataFrame:
    """Change against the previous month that exists; without one the event fails."""
    lagged = series.select(
        "month", "value",
        F.lag("value").over(series_window((), ["month"])).alias("prev_value"),
        F.lit(True).alias("_has"),
    )
    found = _at_events(lagged, events)
    change = F.col("value") - F.col("prev_value")
    percent = F.when(F.col("prev_value") != 0, F.try_divide(change, F.col("prev_value")) * 100)
    percent = F.coalesce(percent, F.lit(0.0))
    expected = F.col("expected")
    passed = (
        F.when(F.col("prev_value").isNull(), False)
        .when(expected.isin("spike", "spike_then_drop"), percent >= 5)
        .when(expected == "increase", change > 0)
        .when(expected == "decrease", change < 0)
        .when(expected == "stable", F.abs(percent) < 10)
        .otherwise(False)
    )
    actual = (
        F.when(F.col("prev_value").isNull(), "unknown")
        .when(change > 0, "increase").when(change < 0, "decrease").otherwise("stable")
    )
    return found.select(
        "month", "event", "expected",
        F.when(F.col("_has"), actual).alias("actual"),
        "value", "prev_value",
        F.when(F.col("_has").isNull(), "no_data")
        .when(passed, "passed").otherwise("failed").alias("status"),
    )


def event_accuracy(checked: DataFrame, empty: float | None = None) -> DataFrame:
    """Events with data, events passed, and their ratio (``empty`` when nothing was checked)."""
    tested = F.count_if(F.expr("status in ('passed', 'failed')"))
    passed = F.count_if(F.expr("status = 'passed'"))
    return checked.agg(
        tested.alias("events_checked"),
        passed.alias("events_passed"),
        F.coalesce(F.try_divide(passed, tested), F.lit(empty).cast("double")).alias("accuracy"),
    )


def check_window(series: DataFrame, events: Sequence[Event] = fixed.REPORT_EVENTS) -> DataFrame:
    """Change against the mean of up to three previous rows, with level-dependent thresholds."""
    before = F.avg("value").over(series_window((), ["month"]).rowsBetween(-3, -1))
    smoothed = series.select(
        "month", "value", F.coalesce(before, F.col("value")).alias("_prior"),
        F.lit(True).alias("_has"),
    )
    found = _at_events(smoothed, events)
    level, change = F.col("value"), _percent(F.col("value"), F.col("_prior"))
    actual = (
        F.when((change > 8) | ((level > 105) & (change > 3)),
               F.when(change > 15, "spiked").otherwise("increased"))
        .when((change < -8) | ((level < 95) & (change < -3)), "decreased")
        .otherwise("stable")
    )
    passed = (
        F.when(F.col("expected") == "spike", (change > 5) | (level > 105))
        .when(F.col("expected") == "increase", (change > 2) | (level > 100))
        .when(F.col("expected") == "decrease", (change < -2) | (level < 98))
        .otherwise(False)
    )
    return found.select(
        "month", "event", "expected",
        F.when(F.col("_has"), actual).otherwise("No data").alias("actual"),
        F.round(level, 1).alias("value"),
        F.when(F.col("_has"), F.round(change, 1)).alias("change_pct"),
        F.when(F.col("_has").isNull(), "unknown")
        .when(passed, "passed").otherwise("failed").alias("status"),
    )
