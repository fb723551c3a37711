"""Monthly panels: joins with the index, rolling statistics, differences and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.stats import Z_BAND, pearson, series_window


def panel_join(monthly: DataFrame, index: DataFrame, column: str = "normalized_index") -> DataFrame:
    """Months that both sides have, with the chosen index column as ``cpu_index``."""
    if column not in index.columns:
        raise ValueError(f"column {column!r} not found in the index")
    return monthly.join(index.select("month", F.col(column).alias("cpu_index")), "month")


def panel_overlap(
    monthly: DataFrame, index: DataFrame,
    columns: Sequence[str] = ("cpu_index", "cpu_impl", "cpu_reversal"),
) -> DataFrame:
    """Activity and index over their common date range.

    A month in both tables lies inside both ranges, so the inner join already makes the cut.
    """
    return monthly.join(index.select("month", *columns), "month")


def rolling_stats(
    panel: DataFrame, window: int = 12,
    columns: Sequence[str] = ("deal_count", "total_amount"), keys: Sequence[str] = (),
) -> DataFrame:
    """Trailing mean and sample deviation; NULL until the window holds ``window`` values."""
    frame = series_window(keys, ["month"]).rowsBetween(-(window - 1), 0)
    added = {}
    for c in columns:
        if c in panel.columns:
            full = F.count(c).over(frame) == window
            added[f"{c}_rolling_mean"] = F.when(full, F.avg(c).over(frame))
            added[f"{c}_rolling_std"] = F.when(full, F.stddev_samp(c).over(frame))
    return panel.withColumns(added) if added else panel


def rolling_correlation(
    panel: DataFrame, x: str, y: str, window: int = 24, keys: Sequence[str] = ()
) -> DataFrame:
    """Trailing correlation with a 95 % Fisher band over the rows where both sides are known.

    For 3 or fewer rows the band is the correlation itself.
    """
    both = panel.dropna(subset=[x, y])
    series = series_window(keys, ["month"])
    frame = series.rowsBetween(-(window - 1), 0)
    r = F.when(
        F.count("*").over(frame) == window, pearson(F.col(x), F.col(y), frame)
    )
    result = both.select(*keys, "month", r.alias("correlation"))
    if window <= 3:
        return result.withColumns({"ci_lower": F.col("correlation"), "ci_upper": F.col("correlation")})
    z = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("correlation"))))
    z = F.when(F.col("correlation").isNotNull(), z)
    step = Z_BAND / (window - 3) ** 0.5
    return result.withColumns({"ci_lower": F.tanh(z - step), "ci_upper": F.tanh(z + step)})


def difference(
    panel: DataFrame, columns: Sequence[str], order: int = 1, keys: Sequence[str] = ()
) -> DataFrame:
    """Repeated first differences; the leading rows drop out."""
    window = series_window(keys, ["month"])
    for _ in range(order):
        panel = panel.withColumns({
            c: F.col(c) - F.lag(c).over(window) for c in columns
        }).dropna(subset=list(columns))
    return panel


def ols_trend(panel: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of each column on the row position, which starts at 0."""
    position = (F.row_number().over(series_window(keys, ["month"])) - 1).cast("double")
    long = panel.dropna(subset=list(columns)).withColumn("_x", position).select(
        *keys, "_x",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("_y")) for c in columns
        ])),
    )
    return long.groupBy(*keys, "series").agg(
        F.count("*").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
    )


def ols_scatter(panel: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Slope, intercept and correlation of y on x for several column pairs."""
    long = panel.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"),
                 F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        for x, y in pairs
    ])))
    return long.groupBy("x_name", "y_name").agg(
        F.count_if(F.expr("_x is not null and _y is not null")).alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        pearson(F.col("_x"), F.col("_y")).alias("r"),
    )


def panel_summary(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of several columns, one row each."""
    long = panel.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("_v")) for c in columns
    ])))
    return long.groupBy("metric").agg(
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"), F.max("_v").alias("max"),
    )


def stage_bands(monthly: DataFrame) -> DataFrame:
    """Cumulative stage counts: the upper edges of stacked bands."""
    return monthly.select(
        "month",
        F.col("seed_count").alias("seed_top"),
        (F.col("seed_count") + F.col("early_count")).alias("early_top"),
        (F.col("seed_count") + F.col("early_count") + F.col("late_count")).alias("late_top"),
    )


def regime_tag(
    series: DataFrame, regimes: Sequence[tuple] = fixed.REGIMES,
    transitions: Sequence[tuple] = fixed.TRANSITIONS, months: int = fixed.TRANSITION_MONTHS,
    date: str = "month",
) -> DataFrame:
    """Name of the regime a date falls into and of a transition that began up to 6 months before.

    The few intervals become one expression; transitions outside the span of the data are skipped.
    """
    day = F.col(date)
    window = series_window(())

    def within(start: str, end: Column | None) -> Column:
        inside = day >= F.lit(start).cast("date")
        return inside if end is None else inside & (day < end)

    regime: Column = F.lit(None).cast("string")
    for start, end, name in reversed(regimes):
        regime = F.when(within(start, F.lit(end).cast("date") if end else None), name).otherwise(regime)
    transition: Column = F.lit(None).cast("string")
    for start, kind in reversed(transitions):
        first = F.lit(start).cast("date")
        seen = (F.min(day).over(window) <= first) & (F.max(day).over(window) >= first)
        inside = within(start, F.add_months(first, months))
        transition = F.when(seen & inside, kind).otherwise(transition)
    return series.withColumns({"regime": regime, "transition": transition})
