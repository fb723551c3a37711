"""Months as 'yyyy-MM' text or first-of-month dates, and calendar completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM").cast("date")


def month_from_text(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def months_between_dates(first: Column, last: Column) -> Column:
    """Array of the first days of all months that start within [first, last].

    A first day in mid-month is rounded up to the next month start. Empty if the range is.
    """
    start = F.when(first == F.trunc(first, "MM"), first.cast("date")).otherwise(
        F.add_months(F.trunc(first, "MM"), 1)
    )
    return F.when(
        start <= last, F.sequence(start, last.cast("date"), F.expr("interval 1 month"))
    ).otherwise(F.array().cast("array<date>"))


def month_bounds(month: Column) -> tuple[Column, Column]:
    """First and last day of a 'yyyy-MM' month."""
    first = month_from_text(month)
    return first, F.last_day(first)


def calendar_of(df: DataFrame, date: str, name: str = "month") -> DataFrame:
    """Every month from the earliest to the latest date, as 'yyyy-MM'."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    months = months_between_dates(F.trunc(F.col("lo"), "MM").cast("date"), F.col("hi").cast("date"))
    return span.select(F.explode(months).alias("m")).select(month_text(F.col("m")).alias(name))


def fill_months(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    first: Column | None = None,
    last: Column | None = None,
    month: str = "month",
) -> DataFrame:
    """Calendar-complete panel: one row per key and month, 0 in every value of an absent month.

    ``df`` holds at most one row per key and month. Rows of a key are packed into a map (bounded
    by the number of months) and unpacked along the calendar, which keeps the data partitioned
    by key for the windows that follow; months present keep their NULLs.
    """
    types = dict(df.dtypes)
    packed = df.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col(month), F.struct(*[F.col(v) for v in values])))
        ).alias("_by_month"),
        F.min(month).alias("_first"),
        F.max(month).alias("_last"),
    )
    span = months_between_dates(
        first if first is not None else F.col("_first"),
        last if last is not None else F.col("_last"),
    )
    rows = packed.select(*keys, "_by_month", F.explode(span).alias(month))
    found = F.try_element_at(F.col("_by_month"), F.col(month))
    return rows.select(*keys, month, found.alias("_row"), ).select(
        *keys,
        month,
        *[
            F.when(F.col("_row").isNull(), F.lit(0).cast(types[v]))
            .otherwise(F.col("_row")[v]).alias(v)
            for v in values
        ],
    )
