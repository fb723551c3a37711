"""Lead-lag correlation of two monthly series for every key at once.

A positive lag means that the first series leads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.stats import Z_95, pearson, series_window


def cross_correlation(
    pairs: DataFrame,
    keys: Sequence[str] = (),
    x: str = "s1",
    y: str = "s2",
    max_lag: int = fixed.MAX_LAG,
    min_rows: int = fixed.MIN_OBSERVATIONS,
    month: str = "month",
) -> DataFrame:
    """Correlation of x[i] with y[i + lag] for every lag, by row position within a key.

    One sort per key delivers all shifted values, and the moments per (key, lag) reuse that
    partitioning, so the whole step costs a single shuffle of the monthly panel. Keys with fewer
    than ``min_rows`` joint rows return no row.
    """
    window = series_window(keys, [month])
    shifted = [
        F.struct(F.lit(lag).alias("lag"), F.lead(F.col(y), lag).over(window).alias("_y"))
        for lag in range(-max_lag, max_lag + 1)
    ]
    rows = (
        pairs.select(*keys, month, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
        .dropna(subset=[x, y])
        .select(
            *keys,
            F.col(x).alias("_x"),
            F.count("*").over(series_window(keys)).alias("_rows"),
            F.array(*shifted).alias("_lags"),
        )
        .where(F.col("_rows") >= min_rows)
        .select(*keys, "_x", F.inline("_lags"))
    )
    lagged = rows.groupBy(*keys, "lag").agg(
        F.count("_y").alias("n_observations"),
        pearson(F.col("_x"), F.col("_y")).alias("correlation"),
    )
    correlation = F.when(F.col("n_observations") >= 3, F.col("correlation"))
    return lagged.select(
        *keys, "lag", correlation.alias("correlation"), "n_observations",
        F.when(correlation.isNull(), "insufficient_data")
        .when(F.col("lag") > 0, F.format_string("series1_leads_by_%d_periods", F.col("lag")))
        .when(F.col("lag") < 0, F.format_string("series2_leads_by_%d_periods", -F.col("lag")))
        .otherwise("contemporaneous").alias("interpretation"),
    )


def optimal_lag(
    ccf: DataFrame, keys: Sequence[str] = (), min_correlation: float = 0.0
) -> DataFrame:
    """Lag of the strongest absolute correlation per key; the smallest lag wins a tie."""
    known = F.col("correlation").isNotNull()
    strength = F.when(known, F.struct(F.abs("correlation"), -F.col("lag")))
    best = ccf.groupBy(*keys).agg(
        F.max_by(F.struct("lag", "correlation"), strength).alias("_best"),
        F.max(F.when(F.col("lag") == 0, F.col("n_observations"))).alias("n_observations"),
        F.max(F.when(F.col("lag") == 0, F.col("correlation"))).alias("contemporaneous"),
    )
    lag, corr = F.col("_best.lag"), F.col("_best.correlation")
    return best.select(
        *keys,
        lag.alias("optimal_lag"),
        corr.alias("max_correlation"),
        F.coalesce(F.abs(corr) >= min_correlation, F.lit(False)).alias("is_significant"),
        F.when(corr.isNotNull(), F.when(corr > 0, "positive").otherwise("negative"))
        .alias("direction"),
        F.when(lag > 0, "series1").when(lag < 0, "series2")
        .when(lag == 0, "contemporaneous").alias("lead_series"),
        "n_observations",
        "contemporaneous",
    )


def ccf_significance(ccf: DataFrame, keys: Sequence[str] = (), z: float = Z_95) -> DataFrame:
    """Flag against z / sqrt(n), with n from the first (most negative) lag."""
    n_first = F.first("n_observations").over(series_window(keys, ["lag"]))
    bound = z / F.sqrt(n_first)
    return ccf.withColumn("bound", bound).withColumn(
        "significant", F.coalesce(F.abs("correlation") > F.col("bound"), F.lit(False))
    )


def stack_pairs(
    panel: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ()
) -> DataFrame:
    """Several column pairs of one panel in long form: (keys, pair, month, s1, s2)."""
    return panel.select(*keys, "month", F.inline(F.array(*[
        F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).cast("double").alias("s1"),
                 F.col(b).cast("double").alias("s2"))
        for a, b in pairs
    ])))


def leadlag_pairs(panel: DataFrame, pairs: Sequence[tuple[str, str]], max_lag: int = fixed.MAX_LAG) -> DataFrame:
    """Contemporaneous and strongest lagged correlation of several column pairs in one job."""
    ccf = cross_correlation(stack_pairs(panel, pairs), ["pair"], max_lag=max_lag)
    return optimal_lag(ccf, ["pair"])


def lead_label(name: Column, lag: Column, corr: Column, direction: Column) -> Column:
    """'Energy: Index leads activity by 3 months, r=-0.419 (negative)'."""
    lead = (
        F.when(lag > 0, "CPU leads VC").when(lag < 0, "VC leads CPU").otherwise("Contemporaneous")
    )
    return F.when(
        lag.isNotNull(),
        F.format_string("%s: %s by %d months, r=%.3f (%s)", name, lead, F.abs(lag), corr, direction),
    )
