"""Statistics expressions shared by the operators, and an exact distributed median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from newsgauge.session import cut_lineage

# Fixed value: two-sided 95 % point of the standard normal distribution.
Z_95 = 1.959963984540054
# Fixed value: rounded point used for the Fisher band.
Z_BAND = 1.96
# Groups whose median brackets (three numbers each) are broadcast.
BROADCAST_GROUPS = 100_000


def series_window(keys: Sequence[str], order: Sequence[str] | None = None) -> WindowSpec:
    """Window over one series per key; a constant key stands in when there is a single series.

    Series are monthly aggregates, so a window partition holds one row per calendar month.
    """
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(*order) if order else window


def pearson(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over rows where both sides are known; NULL if a side is constant.

    Built from moments because ``corr`` raises a division error on constants in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    moments = [F.covar_pop(px, py), F.stddev_pop(px), F.stddev_pop(py)]
    if over is not None:
        moments = [m.over(over) for m in moments]
    covariance, sx, sy = moments
    return F.when((sx > 0) & (sy > 0), F.try_divide(covariance, sx * sy))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def stddev_or_zero(value: Column) -> Column:
    """Sample standard deviation, 0 for a single row."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def format_value(value: Column, integral: bool = False) -> Column:
    """CSV text of a number: blank for NULL or NaN, no decimals when whole, else at most two."""
    if integral:
        return F.coalesce(value.cast("string"), F.lit(""))
    text = F.round(value, 2).cast("decimal(38,2)").cast("string")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(""))
        .when(value == F.floor(value), value.cast("decimal(38,0)").cast("string"))
        .otherwise(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"))
    ).alias("text")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per group without bringing a group into one task.

    A mergeable sketch brackets the middle of every group; rows below the bracket are only
    counted, and just the distinct values inside it (a fixed small share of the group) are ranked.
    The rank offsets come from exact counts, and the bracket is wider than the sketch's error
    bound, so the result is the exact interpolated median.
    """
    known = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    bands = known.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", [0.499, 0.501], 10000).alias("_band"),
    )
    # one row per group; while there are few groups, the records stay where they are
    bands = cut_lineage(bands)
    bands = F.broadcast(bands) if bands.count() <= BROADCAST_GROUPS else bands
    placed = known.join(bands, list(keys)).select(
        *keys, "_n", "_v",
        F.when(F.col("_v") < F.col("_band")[0], -1)
        .when(F.col("_v") > F.col("_band")[1], 1)
        .otherwise(0).alias("_side"),
    )
    counted = (
        placed.where("_side <= 0")
        .groupBy(*keys, F.when(F.col("_side") == 0, F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    )
    # NULL (everything below the bracket) sorts first, so the running count is the exact rank.
    running = counted.withColumn(
        "_to",
        F.sum("_c").over(
            Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    ).where("_v is not null")
    first_rank = F.floor((F.col("_n") + 1) / 2)
    second_rank = F.floor((F.col("_n") + 2) / 2)
    return running.groupBy(*keys).agg(
        (
            (F.min(F.when(F.col("_to") >= first_rank, F.col("_v")))
             + F.min(F.when(F.col("_to") >= second_rank, F.col("_v")))) / 2
        ).alias(name)
    )
