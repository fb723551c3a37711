"""Stationarity of many series at once: level test, unit-root test, verdicts, differencing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge import fixed_values as fixed
from newsgauge.functions import inference as inf
from newsgauge.functions.gram import gram_of, swept
from newsgauge.functions.stats import series_window
from newsgauge.session import cut_lineage

ALPHA = 0.05


def kpss_panel(
    series: DataFrame, keys: Sequence[str], value: str = "value",
    min_rows: int = fixed.MIN_OBSERVATIONS,
) -> DataFrame:
    """Level-stationarity statistic with automatic Bartlett bandwidth, and its bounded p-value.

    The residuals of one series (one value per month) travel as an array; sums over lags are
    higher-order functions on it.
    """
    known = series.where(F.col(value).isNotNull())
    centred = known.select(
        *keys, "month",
        (F.col(value) - F.avg(value).over(series_window(keys))).alias("_r"),
        F.count("*").over(series_window(keys)).alias("n"),
    ).where(F.col("n") >= min_rows)
    walked = centred.withColumn("_walk", F.sum("_r").over(series_window(keys, ["month"])))
    packed = walked.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.sum(F.col("_walk") * F.col("_walk")).alias("_walk2"),
        F.sum(F.col("_r") * F.col("_r")).alias("_r2"),
        F.transform(F.array_sort(F.collect_list(F.struct("month", "_r"))), lambda s: s["_r"])
        .alias("_rs"),
    )

    def lag_product(lag: Column) -> Column:
        return F.aggregate(
            F.zip_with(
                F.slice("_rs", lag + 1, F.col("n").cast("int") - lag),
                F.slice("_rs", F.lit(1), F.col("n").cast("int") - lag),
                lambda a, b: a * b,
            ),
            F.lit(0.0), lambda total, v: total + v,
        )

    def lag_sum(last: Column, term) -> Column:
        counted = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(counted, F.lit(0.0), lambda total, lag: total + term(lag))

    n = F.col("n")
    products = packed.withColumn("_cov", F.floor(F.pow(n.cast("double"), F.lit(2 / 9))).cast("int"))
    sized = products.withColumns({
        "_s0": F.col("_r2") / n + lag_sum(F.col("_cov"), lambda k: lag_product(k) / (n / 2)),
        "_s1": lag_sum(F.col("_cov"), lambda k: k * lag_product(k) / (n / 2)),
    })
    ratio = F.try_divide(F.col("_s1"), F.col("_s0"))
    gamma = 1.1447 * F.pow(ratio * ratio, F.lit(1 / 3))
    bandwidth = F.least(
        F.floor(gamma * F.pow(n.cast("double"), F.lit(1 / 3))), n - 1
    ).cast("int")
    lagged = sized.withColumn("kpss_lags", F.coalesce(bandwidth, F.lit(0)))
    variance = (
        F.col("_r2")
        + 2 * lag_sum(
            F.col("kpss_lags"), lambda k: lag_product(k) * (1 - k / (F.col("kpss_lags") + 1.0))
        )
    ) / n
    result = lagged.select(
        *keys, "n", "kpss_lags",
        F.try_divide(F.col("_walk2") / (n * n), F.when(variance > 0, variance))
        .alias("kpss_statistic"),
    )
    return result.withColumn("kpss_pvalue", _kpss_p(F.col("kpss_statistic")))


def _kpss_p(stat: Column) -> Column:
    """Linear interpolation between the published critical values, bounded at both ends."""
    crit, p = inf.KPSS_CRITICAL, inf.KPSS_P
    value = F.when(stat <= crit[0], F.lit(p[0]))
    for i in range(len(crit) - 1):
        slope = (p[i + 1] - p[i]) / (crit[i + 1] - crit[i])
        value = value.when(stat <= crit[i + 1], p[i] + (stat - crit[i]) * slope)
    return F.when(stat.isNotNull(), value.otherwise(F.lit(p[-1])))


def adf_panel(
    series: DataFrame, keys: Sequence[str], value: str = "value",
    min_rows: int = fixed.MIN_OBSERVATIONS,
) -> DataFrame:
    """Unit-root test per key; keys with fewer than ``min_rows`` known values have no row.

    Augmented regression of the steps on the level before, with a constant; the lag order has the least AIC on a
    sample common to all orders. One elimination gives the sums of squares of all orders.
    A series (one value per month) travels as an array. Constant series have NULL figures.
    """
    known = series.where(F.col(value).isNotNull()).select(*keys, "month", F.col(value).cast("double").alias("_v"))
    packed = known.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("month", "_v"))), lambda s: s["_v"]).alias("ys"),
        F.count("*").cast("int").alias("n"), F.avg("_v").alias("mean"), F.expr("max(_v) > min(_v)").alias("varies"),
    ).where((F.col("n") >= min_rows))
    most = F.least(F.floor(F.col("n") / 2).cast("int") - 2,
                   F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))).cast("int"))
    usable = F.col("varies") & (F.col("n") >= 4) & (most >= 0)
    ready = packed.select(*keys, F.when(usable, most).alias("most"), "n",
                          F.transform("ys", lambda v: v - F.col("mean")).alias("y"))
    steps = ready.withColumn("step", F.zip_with(
        F.slice("y", F.lit(2), F.col("n") - 1), F.slice("y", F.lit(1), F.col("n") - 1), lambda b, a: b - a))

    def lag_columns(order: Column, first: Column, rows: Column) -> Column:
        """step[t - 1] .. step[t - order] for ``rows`` positions t from ``first`` on."""
        orders = F.when(order >= 1, F.sequence(F.lit(1), order)).otherwise(F.array().cast("array<int>"))
        return F.transform(orders, lambda k: F.slice("step", first - k, rows))

    ones = lambda rows: F.array_repeat(F.lit(1.0), rows)
    rows = F.col("n") - 1 - F.col("most")
    first = F.col("most") + 1
    common = steps.withColumn("common", F.concat(
        F.array(ones(rows), F.slice("y", first, rows)), lag_columns(F.col("most"), first, rows),
        F.array(F.slice("step", first, rows))))
    rss = common.withColumn("gram", gram_of(F.col("common"))).withColumn(
        "rss", swept(F.col("gram"), F.col("most") + 2)["corners"])
    criteria = F.transform(F.sequence(F.lit(0), F.col("most")), lambda k: (
        rows * F.log(F.greatest(F.get("rss", k + 2), F.lit(1e-300)) / rows) + 2 * (k + 2)))
    chosen = rss.withColumn("criteria", criteria).withColumn(
        "adf_lags", F.array_position("criteria", F.array_min("criteria")).cast("int") - 1)
    order = F.col("adf_lags")
    own = chosen.select(*keys, "n", "step", "y", "adf_lags", (F.col("n") - 1 - order).alias("adf_nobs"))
    own = own.withColumn("own", F.concat(
        F.array(ones(F.col("adf_nobs"))), lag_columns(order, order + 1, F.col("adf_nobs")),
        F.array(F.slice("y", order + 1, F.col("adf_nobs")), F.slice("step", order + 1, F.col("adf_nobs")))))
    # the level stands behind constant and lags: what is left is a simple regression of the step on it
    left = own.withColumn("gram", gram_of(F.col("own"))).select(
        *keys, "adf_lags", "adf_nobs", swept(F.col("gram"), order + 1)["m"].alias("m"))
    cell = lambda i, j: F.get(F.get("m", order + i), order + j)
    slope = F.try_divide(cell(1, 2), cell(1, 1))
    rest = cell(2, 2) - slope * cell(1, 2)
    spread = F.try_divide(rest, (F.col("adf_nobs") - order - 2) * cell(1, 1))
    tau = left.withColumn("adf_statistic", F.when(spread > 0, slope / F.sqrt(spread)))
    held = F.col("adf_statistic").isNotNull()
    n = F.col("adf_nobs").cast("double")

    def critical(level: str) -> Column:
        return F.when(held, sum((c / F.pow(n, F.lit(i)) for i, c in enumerate(inf.TAU_CRITICAL[level])), F.lit(0.0)))

    return tau.select(
        *keys, "adf_statistic", _unit_root_p("adf_statistic").alias("adf_pvalue"),
        F.when(held, order).alias("adf_lags"), F.when(held, F.col("adf_nobs")).alias("adf_nobs"),
        critical("1%").alias("adf_crit_1"), critical("5%").alias("adf_crit_5"), critical("10%").alias("adf_crit_10"))


@F.pandas_udf(T.DoubleType())
def _unit_root_p(tau: pd.Series) -> pd.Series:
    return tau.map(inf.unit_root_p, na_action="ignore")


def stationarity(
    series: DataFrame, keys: Sequence[str], value: str = "value", alpha: float = ALPHA,
    min_rows: int = fixed.MIN_OBSERVATIONS,
) -> DataFrame:
    """Both tests and the joint verdict per key; NULL verdict where a test cannot be computed."""
    both = kpss_panel(series, keys, value, min_rows).join(
        adf_panel(series, keys, value, min_rows), list(keys)
    )
    adf = F.col("adf_pvalue") < alpha
    kpss = F.col("kpss_pvalue") >= alpha
    conclusion = (
        F.when(adf & kpss, "stationary")
        .when(~adf & ~kpss, "non_stationary")
        .when(adf & ~kpss, "trend_stationary")
        .when(~adf & kpss, "inconclusive")
    )
    return both.withColumns({
        "adf_stationary": adf,
        "kpss_stationary": kpss,
        "conclusion": conclusion,
    }).withColumn(
        "differencing_needed",
        F.when(F.col("conclusion").isNotNull(),
               F.col("conclusion").isin("non_stationary", "trend_stationary")),
    )


def differencing_ladder(
    series: DataFrame, keys: Sequence[str], value: str = "value", max_differences: int = 2
) -> DataFrame:
    """(keys, month, ladder): differences of order 0, 1, .. of each value, shorter where earlier values lack.

    The difference of order k is the alternating sum of k + 1 neighbours with binomial weights, so one window gives
    all orders.
    """
    ordered = series_window(keys, ["month"])
    known = series.where(F.col(value).isNotNull()).select(*keys, "month", F.col(value).cast("double").alias("v0"))
    back = known.select(*keys, "month", "v0", *[
        F.lag("v0", k).over(ordered).alias(f"v{k}") for k in range(1, max_differences + 1)])
    orders = [sum(((-1) ** j * math.comb(d, j) * F.col(f"v{j}") for j in range(1, d + 1)), F.col("v0"))
              for d in range(max_differences + 1)]
    return back.select(*keys, "month", F.array_compact(F.array(*orders)).alias("ladder"))


def _ladder_ends(
    ladder: DataFrame, keys: Sequence[str], max_differences: int, alpha: float, min_rows: int
) -> DataFrame:
    """(keys, original_length, final_length, differences, is_stationary): where each series leaves the ladder."""
    orders = ladder.select(*keys, "month", F.posexplode("ladder").alias("d", "value"))
    sizes = orders.groupBy(*keys, "d").agg(F.count("*").alias("final_length"))
    verdicts = stationarity(orders, [*keys, "d"], "value", alpha, min_rows).select(
        *keys, "d", "differencing_needed")
    tested = sizes.join(verdicts, [*keys, "d"], "left")
    passed = F.coalesce(~F.col("differencing_needed"), F.lit(False))
    stops = passed | (F.col("d") == max_differences) | (
        (F.col("d") > 0) & F.col("differencing_needed").isNull()
    )
    ended = tested.groupBy(*keys).agg(
        F.max(F.when(F.col("d") == 0, F.col("final_length"))).alias("original_length"),
        F.min_by(F.struct("d", "final_length", passed.alias("ok")), F.when(stops, F.col("d"))).alias("_end"),
    ).where("_end IS NOT NULL")
    return ended.select(
        *keys, "original_length", F.col("_end.final_length").alias("final_length"),
        F.col("_end.d").alias("differences"), F.col("_end.ok").alias("is_stationary"))


def make_stationary(
    series: DataFrame, keys: Sequence[str], value: str = "value", max_differences: int = 2,
    alpha: float = ALPHA, min_rows: int = fixed.MIN_OBSERVATIONS,
) -> DataFrame:
    """Smallest order of differencing that needs no more, per key.

    All orders are tested together. The search ends early at an order that is too short or
    cannot be tested; the last order is the best effort. ``stationary_series`` returns the values.
    """
    ladder = cut_lineage(differencing_ladder(series, keys, value, max_differences))
    return _ladder_ends(ladder, keys, max_differences, alpha, min_rows).withColumnRenamed(
        "differences", "differences_applied")


def stationary_series(
    series: DataFrame, keys: Sequence[str], value: str = "value", max_differences: int = 2,
    alpha: float = ALPHA, min_rows: int = fixed.MIN_OBSERVATIONS,
) -> DataFrame:
    """(keys, month, differences, value): every series at the order that ``make_stationary`` ends with."""
    ladder = cut_lineage(differencing_ladder(series, keys, value, max_differences))
    ends = _ladder_ends(ladder, keys, max_differences, alpha, min_rows).select(*keys, "differences")
    return ladder.join(ends, list(keys)).select(
        *keys, "month", "differences", F.get("ladder", F.col("differences")).alias("value")
    ).where("value IS NOT NULL")
