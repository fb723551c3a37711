"""Sector sensitivity: one job for all sectors, classifiers, index columns, eras and bands."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.calendar import fill_months, month_start
from newsgauge.functions.stats import series_window
from newsgauge.operators.deals import exposure_band
from newsgauge.operators.leadlag import cross_correlation, lead_label, optimal_lag
from newsgauge.session import cut_lineage

METRICS = ("deal_count", "total_amount")


def sector_counts(
    companies: DataFrame, keys: Sequence[str], start_date: str, end_date: str | None = None
) -> DataFrame:
    """Monthly number of financings and amount raised per key since the start date."""
    date = F.col("last_financing_date")
    rows = companies.where(date >= F.lit(start_date).cast("date"))
    if end_date:
        rows = rows.where(date <= F.lit(end_date).cast("date"))
    return rows.groupBy(*keys, month_start(date).alias("month")).agg(
        F.count("company_id").alias("deal_count"),
        F.coalesce(F.sum("total_raised"), F.lit(0.0)).alias("total_amount"),
    )


def sector_monthly(
    companies: DataFrame, start_date: str, end_date: str, category: str = "judge_category",
    exclude: Iterable[str] = fixed.EXCLUDED_SECTORS,
) -> DataFrame:
    """Calendar-complete monthly counts of every sector between two dates."""
    rows = companies.where(keep_sector(F.col(category), exclude)).withColumnRenamed(category, "sector")
    counts = sector_counts(rows, ["sector"], start_date, end_date).drop("total_amount")
    return fill_months(
        counts, ["sector"], ["deal_count"],
        F.lit(start_date).cast("date"), F.lit(end_date).cast("date"),
    )


def keep_sector(category: Column, exclude: Iterable[str]) -> Column:
    return category.isNotNull() & ~category.isin(list(exclude))


def stack_index(index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Index columns in long form: (index_column, month, s1)."""
    return index.select("month", F.inline(F.array(*[
        F.struct(F.lit(c).alias("index_column"), F.col(c).cast("double").alias("s1"))
        for c in columns
    ])))


def aligned_panel(
    companies: DataFrame, index: DataFrame, keys: Sequence[str], columns: Sequence[str],
    metric: str, start_date: str,
) -> DataFrame:
    """Gap-free activity per key joined with the index columns, month by month.

    The calendar runs from the start date to the last index month. The index has one row per
    calendar month and column, so broadcasting it is safe at any corpus size.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    first = F.lit(start_date).cast("date")
    era = index.where(F.col("month") >= first)
    counts = sector_counts(companies, keys, start_date).select(*keys, "month", metric)
    panel = fill_months(counts, keys, [metric], first, era.agg(F.max("month")).scalar())
    return panel.join(F.broadcast(stack_index(era, columns)), "month").select(
        "index_column", *keys, "month", "s1", F.col(metric).cast("double").alias("s2")
    )


def sector_sensitivity(
    companies: DataFrame, index: DataFrame, keys: Sequence[str],
    columns: Sequence[str] = ("cpu_index",), metric: str = "deal_count",
    start_date: str = fixed.RECENT_START, max_lag: int = fixed.MAX_LAG,
) -> DataFrame:
    """Strongest lagged correlation per (index column, keys); the last key is the sector name.

    Groups with too few joint months stay in the result with NULL statistics.
    """
    # Small, and read twice: keep it instead of aggregating the records again.
    panel = cut_lineage(aligned_panel(companies, index, keys, columns, metric, start_date))
    all_keys = ["index_column", *keys]
    ccf = cross_correlation(panel, all_keys, max_lag=max_lag)
    best = optimal_lag(ccf, all_keys).drop("n_observations")
    sizes = panel.groupBy(*all_keys).agg(
        F.count_if(F.expr("s1 is not null and s2 is not null")).alias("n_observations")
    )
    found = sizes.join(best, all_keys, "left")
    corr = F.col("max_correlation")
    return found.select(
        *all_keys,
        "optimal_lag",
        corr.alias("correlation"),
        F.when(corr != 0, F.abs(corr)).alias("abs_correlation"),
        "direction",
        "n_observations",
        lead_label(F.col(keys[-1]), F.col("optimal_lag"), corr, F.col("direction"))
        .alias("interpretation"),
    )


def sector_ranking(
    companies: DataFrame, index: DataFrame, column: str = "cpu_index",
    metric: str = "deal_count", category: str = "judge_category",
    start_date: str = fixed.RECENT_START, max_lag: int = fixed.MAX_LAG,
    exclude: Iterable[str] = fixed.EXCLUDED_SECTORS,
) -> DataFrame:
    """All sectors ordered by absolute correlation, unknown ones last."""
    rows = companies.where(keep_sector(F.col(category), exclude)).withColumnRenamed(category, "sector")
    result = sector_sensitivity(rows, index, ["sector"], [column], metric, start_date, max_lag)
    return result.drop("index_column").orderBy(F.desc_nulls_last("abs_correlation"), "sector")


def decomposition(
    companies: DataFrame, index: DataFrame, category: str = "judge_category",
    metric: str = "deal_count", start_date: str = fixed.RECENT_START,
    max_lag: int = fixed.MAX_LAG, exclude: Iterable[str] = fixed.EXCLUDED_SECTORS,
) -> DataFrame:
    """Implementation against reversal sensitivity per sector, with asymmetry and dominant side."""
    rows = companies.where(keep_sector(F.col(category), exclude)).withColumnRenamed(category, "sector")
    sides = {"cpu_impl": "impl", "cpu_reversal": "reversal"}
    both = sector_sensitivity(rows, index, ["sector"], list(sides), metric, start_date, max_lag)

    def pick(column: str, source: str) -> Column:
        return F.max(F.when(F.col("index_column") == column, F.col(source)))

    wide = both.groupBy("sector").agg(*[
        pick(column, source).alias(f"{side}_{name}")
        for column, side in sides.items()
        for source, name in (("correlation", "correlation"), ("optimal_lag", "lag"),
                             ("abs_correlation", "abs"))
    ])
    asymmetry = F.when(
        F.col("impl_abs") + F.col("reversal_abs") > 0,
        F.try_divide(F.col("impl_abs") - F.col("reversal_abs"),
                     F.col("impl_abs") + F.col("reversal_abs")),
    )
    return wide.withColumn("asymmetry_ratio", asymmetry).withColumn(
        "dominant_type",
        F.when(F.col("asymmetry_ratio") > 0.1, "implementation")
        .when(F.col("asymmetry_ratio") < -0.1, "reversal")
        .otherwise("balanced"),
    ).orderBy(F.asc_nulls_last("asymmetry_ratio"), "sector")


def both_components_known(decomposed: DataFrame) -> DataFrame:
    """Rows of a decomposition with both correlations, by asymmetry."""
    return decomposed.dropna(subset=["impl_correlation", "reversal_correlation"]).orderBy(
        "asymmetry_ratio"
    )


def exposure_strata(
    companies: DataFrame, index: DataFrame, column: str = "cpu_index",
    metric: str = "deal_count", start_date: str = fixed.RECENT_START,
    max_lag: int = fixed.MAX_LAG, high: int = fixed.HIGH_EXPOSURE, low: int = fixed.LOW_EXPOSURE,
) -> DataFrame:
    """Sensitivity of the high and the low exposure band next to their distinct companies."""
    if "ira_index" not in companies.columns:
        raise ValueError("companies need an 'ira_index' column")
    rows = companies.withColumn("band", exposure_band(F.col("ira_index"), high, low)).where(
        "band is not null"
    )
    era = rows.where(F.col("last_financing_date") >= F.lit(start_date).cast("date"))
    sizes = era.groupBy("band").agg(
        (F.count_distinct("company_id")
         + F.when(F.count("company_id") < F.count("*"), 1).otherwise(0)).alias("n_companies")
    )
    result = sector_sensitivity(rows, index, ["band"], [column], metric, start_date, max_lag)
    return result.drop("index_column", "interpretation").join(sizes, "band")


def exposure_comparison(strata: DataFrame) -> DataFrame:
    """Both bands in one row, with the difference of their absolute correlations."""
    def pick(band: str, column: str) -> Column:
        return F.max(F.when(F.col("band") == band, F.col(column)))

    row = strata.agg(
        F.coalesce(pick("high", "n_companies"), F.lit(0)).alias("high_n_companies"),
        F.coalesce(pick("low", "n_companies"), F.lit(0)).alias("low_n_companies"),
        pick("high", "correlation").alias("high_correlation"),
        pick("low", "correlation").alias("low_correlation"),
        (pick("high", "abs_correlation") - pick("low", "abs_correlation")).alias("difference"),
    )
    return row.withColumn("high_more_sensitive", F.col("difference") > 0)


def stack_classifiers(companies: DataFrame, classifiers: Mapping[str, str]) -> DataFrame:
    """One row per company and classifier column; columns that do not exist are left out."""
    present = {c: n for c, n in classifiers.items() if c in companies.columns}
    if not present:
        raise ValueError(f"none of the columns exists: {list(classifiers)}")
    kept = [c for c in companies.columns if c not in classifiers]
    return companies.select(*kept, F.inline(F.array(*[
        F.struct(F.lit(name).alias("classifier"), F.col(c).alias("sector"))
        for c, name in present.items()
    ])))


def classifier_robustness(
    companies: DataFrame, index: DataFrame, classifiers: Mapping[str, str],
    column: str = "cpu_index", metric: str = "deal_count",
    start_date: str = fixed.RECENT_START, max_lag: int = fixed.MAX_LAG,
    exclude: Iterable[str] = fixed.EXCLUDED_SECTORS,
) -> DataFrame:
    """Sector sensitivity under every classifier, ranked within the classifier."""
    rows = stack_classifiers(companies, classifiers).where(keep_sector(F.col("sector"), exclude))
    result = sector_sensitivity(
        rows, index, ["classifier", "sector"], [column], metric, start_date, max_lag
    ).drop("index_column")
    order = [F.desc_nulls_last("abs_correlation"), F.col("sector")]
    return result.withColumn("rank", F.row_number().over(series_window(["classifier"], order)))


def classifier_agreement(ranked: DataFrame, top: int = 3) -> DataFrame:
    """Sectors among the top of all classifiers over sectors among the top of any.

    NULL with fewer than two classifiers. ``ranked`` has one row per classifier and sector.
    """
    best = ranked.select("classifier", "sector", "rank")
    n = best.agg(F.count_distinct("classifier")).scalar()
    shared = (
        best.where(F.col("rank") <= top)
        .groupBy("sector").agg(F.count_distinct("classifier").alias("votes"))
        .withColumn("n_classifiers", n)
    )
    return shared.agg(
        F.max("n_classifiers").alias("n_classifiers"),
        F.count_if(F.expr("votes = n_classifiers")).alias("shared_sectors"),
        F.count("*").alias("all_sectors"),
        F.when(
            F.max("n_classifiers") >= 2,
            F.try_divide(F.count_if(F.expr("votes = n_classifiers")), F.count("*")),
        ).alias("agreement_score"),
    )


def lag_matrix(ccf: DataFrame, max_lag: int = fixed.MAX_LAG) -> DataFrame:
    """Sectors in rows, lags in columns (lag_m12 .. lag_p12)."""
    lags = list(range(-max_lag, max_lag + 1))
    wide = ccf.groupBy("sector").pivot("lag", lags).agg(F.first("correlation"))
    return wide.select(
        "sector",
        *[F.col(f"`{k}`").alias(f"lag_{'m' if k < 0 else 'p'}{abs(k)}") for k in lags],
    )


def era_comparison(recent: DataFrame, full: DataFrame) -> DataFrame:
    """Two rankings side by side: change of correlation, and whether the direction flipped."""
    a = recent.select("sector", F.col("correlation").alias("corr_ira_era"),
                      F.col("optimal_lag").alias("lag_ira_era"))
    b = full.select("sector", F.col("correlation").alias("corr_full_sample"),
                    F.col("optimal_lag").alias("lag_full_sample"))
    return a.join(b, "sector").withColumns({
        "corr_change": F.col("corr_ira_era") - F.col("corr_full_sample"),
        "direction_flip": F.coalesce(F.col("corr_ira_era") > 0, F.lit(False))
        != F.coalesce(F.col("corr_full_sample") > 0, F.lit(False)),
    }).orderBy(F.desc("corr_change"))
