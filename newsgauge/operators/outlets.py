"""Outlet panels: volume scaling, standardisation, averaging, base normalisation, correlations.

Input panel: (outlet, month, numerator, denominator), optionally with leading series keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.stats import pearson, ratio_or_zero, series_window

# Fixed value: below this a deviation counts as zero.
TINY = 1e-10


def keep_outlets(panel: DataFrame, outlets: Iterable[str] = fixed.BENCHMARK_OUTLETS) -> DataFrame:
    """Whitelist, ignoring case."""
    return panel.where(F.lower("outlet").isin([o.lower() for o in outlets]))


def drop_outlets(panel: DataFrame, outlets: Iterable[str]) -> DataFrame:
    """Exclusion list, ignoring case; an outlet without a name stays."""
    names = [o.lower() for o in outlets]
    return panel.where(~F.coalesce(F.lower("outlet"), F.lit("")).isin(names)) if names else panel


def outlet_ratio(panel: DataFrame) -> DataFrame:
    """Numerator over volume, 0 in months without volume."""
    return panel.withColumn("value", ratio_or_zero(F.col("numerator"), F.col("denominator")))


def standardize(
    series: DataFrame, keys: Sequence[str] = ("outlet",), center: bool = True
) -> DataFrame:
    """z-score per series with the population deviation; a constant series becomes 0.

    ``center=False`` only divides by the deviation, which keeps a level that the base
    normalisation can divide by.
    """
    window = series_window(keys)
    deviation = F.stddev_pop("value").over(window)
    shifted = F.col("value") - F.avg("value").over(window) if center else F.col("value")
    return series.withColumn(
        "value", F.when(deviation > TINY, shifted / deviation).otherwise(F.lit(0.0))
    )


def average_outlets(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the outlets that have the month."""
    return series.groupBy(*keys, "month").agg(F.avg("value").alias("value"))


def base_normalize(
    series: DataFrame, base_start: str | Column, base_end: str | Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Base-period mean := 100. Unchanged without base months; all 0 when their mean is 0."""
    start, end = (b if isinstance(b, Column) else F.lit(b) for b in (base_start, base_end))
    in_base = F.when(F.col("month").between(start, end), F.col("value"))
    mean = F.avg(in_base).over(series_window(keys))
    return series.withColumn(
        "value",
        F.when(mean.isNull(), F.col("value"))
        .when(mean != 0, F.try_divide(F.col("value"), mean) * 100)
        .otherwise(F.lit(0.0)),
    )


def pooled_index(
    panel: DataFrame,
    base_start: str,
    base_end: str,
    exclude_outlets: Iterable[str] = (),
    skip_volume_scaling: bool = False,
    skip_standardization: bool = False,
    center: bool = True,
) -> DataFrame:
    """Scale by volume, standardise per outlet, average over outlets, normalise to the base."""
    kept = drop_outlets(panel, exclude_outlets)
    if skip_volume_scaling:
        series = kept.withColumn("value", F.coalesce(F.col("numerator"), F.lit(0)).cast("double"))
    else:
        series = outlet_ratio(kept)
    if not skip_standardization:
        series = standardize(series, center=center)
    return base_normalize(average_outlets(series), base_start, base_end)


def outlet_index(panel: DataFrame, base_start: str, base_end: str) -> DataFrame:
    """Every outlet's own ratio index, without standardisation."""
    return base_normalize(outlet_ratio(panel), base_start, base_end, ["outlet"])


def _joint_series(series: DataFrame, condition: str) -> DataFrame:
    left = series.select("month", F.col("outlet").alias("outlet1"), F.col("value").alias("v1"))
    right = series.select("month", F.col("outlet").alias("outlet2"), F.col("value").alias("v2"))
    return left.join(right, "month").where(condition)


def outlet_correlations(series: DataFrame, full_matrix: bool = False) -> DataFrame:
    """Correlation of outlet pairs over their joint months.

    The result is one row per outlet pair by definition; the work on the way stays at outlets² per
    calendar month of the aggregated panel and is summed before the shuffle. Pairs with fewer
    than 2 joint months are dropped, or NULL in the full matrix.
    """
    pairs = _joint_series(series, "true" if full_matrix else "outlet1 < outlet2")
    grouped = pairs.groupBy("outlet1", "outlet2").agg(
        F.count_if(F.expr("v1 is not null and v2 is not null")).alias("n_months"),
        pearson(F.col("v1"), F.col("v2")).alias("correlation"),
    )
    if not full_matrix:
        return grouped.where("n_months >= 2")
    return grouped.withColumn(
        "correlation", F.when(F.col("n_months") >= 2, F.col("correlation"))
    )


def outlet_names(series: DataFrame) -> list[str]:
    """All outlets of a series by name; they become columns, so there can only be so many."""
    return [r["outlet"] for r in series.select("outlet").where("outlet IS NOT NULL").distinct()
            .orderBy("outlet").collect()]


def outlet_wide(series: DataFrame, outlets: Sequence[str] | None = None) -> DataFrame:
    """Months in rows, outlets in columns (all that occur, unless a list is given), NULL where one misses a month."""
    names = outlet_names(series) if outlets is None else list(outlets)
    return series.groupBy("month").pivot("outlet", names).agg(F.first("value"))
