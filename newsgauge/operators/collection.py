"""Progress of monthly collection: open months, status, and query fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.calendar import month_bounds
from newsgauge.functions.text import fingerprint


def pending_months(calendar: DataFrame, completed: DataFrame) -> DataFrame:
    """Calendar months without a completed collection."""
    return calendar.join(completed.select("month"), "month", "left_anti").orderBy("month")


def collection_status(calendar: DataFrame, progress: DataFrame) -> DataFrame:
    """Months in range, completed, pending, share completed, and articles of completed months."""
    done = progress.where("completed_at is not null").select("month", "articles_fetched").distinct()
    joined = calendar.join(done.withColumn("_done", F.lit(True)), "month", "left")
    total, completed = F.count("*"), F.count_if("_done")
    return joined.agg(
        total.alias("total_months"),
        completed.alias("completed_months"),
        (total - completed).alias("pending_months"),
        F.coalesce(F.try_divide(completed, total), F.lit(0.0)).alias("percent_complete"),
        F.coalesce(F.sum("articles_fetched"), F.lit(0)).alias("total_articles_collected"),
    )


def date_filter(month: Column) -> Column:
    """'Date ge 2021-02-01 and Date le 2021-02-28' for a month."""
    first, last = month_bounds(month)
    return F.concat(
        F.lit("Date ge "), first.cast("string"), F.lit(" and Date le "), last.cast("string")
    )


def query_fingerprints(calendar: DataFrame, query: str) -> DataFrame:
    """Short hash of the search text and the month's date filter."""
    return calendar.select(
        "month", fingerprint(F.lit(query), date_filter(F.col("month"))).alias("query_hash")
    )
