"""Transaction records: typing, filters, and monthly aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.calendar import fill_months, month_start
from newsgauge.functions.stats import exact_median


def parse_amount(text: Column) -> Column:
    """'10,000' to 10000.0; blank or unreadable to NULL."""
    return F.regexp_replace(text.cast("string"), ",", "").try_cast("double")


def deal_stage(deal_type: Column) -> Column:
    stage = F.lit(None).cast("string")
    for kind, name in fixed.DEAL_STAGES.items():
        stage = F.when(deal_type == kind, name).otherwise(stage)
    return stage


def filter_deals(
    deals: DataFrame, min_date: str = fixed.DEAL_MIN_DATE,
    deal_types: Sequence[str] | None = None, status: str = "Completed",
) -> DataFrame:
    """On or after the first date, of a wanted type, with the wanted status."""
    kinds = list(fixed.DEAL_STAGES) if deal_types is None else list(deal_types)
    return deals.where(
        (F.col("deal_date") >= F.lit(min_date).cast("date"))
        & F.col("deal_type").isin(kinds)
        & (F.col("deal_status") == status)
    )


def derive_deal_columns(deals: DataFrame) -> DataFrame:
    """Year, month number, month start and financing stage."""
    return deals.withColumns({
        "year": F.year("deal_date"),
        "month_number": F.month("deal_date"),
        "month": month_start(F.col("deal_date")),
        "stage": deal_stage(F.col("deal_type")),
    })


def aggregate_activity(
    deals: DataFrame, keys: Sequence[str], amount: str = "deal_size", record: str = "deal_id",
    mean: bool = True, median: bool = True,
) -> DataFrame:
    """Counts, amounts and stages per key; partial sums are merged, the median is exact.

    The median reads the records once more; leave it out where nobody looks at it.
    """
    size = F.col(amount)
    measures = [
        F.count(record).alias("deal_count"),
        F.coalesce(F.sum(size), F.lit(0.0)).alias("total_amount"),
        F.avg(size).alias("mean_amount"),
        F.count(size).alias("deals_with_size"),
    ]
    if "stage" in deals.columns:
        measures += [
            F.count_if(F.col("stage") == s).alias(f"{s.lower()}_count")
            for s in ("Seed", "Early", "Late")
        ]
    else:
        measures += [
            F.lit(0).cast("bigint").alias(f"{s}_count") for s in ("seed", "early", "late")
        ]
    if not mean:
        measures.pop(2)
    counted = deals.groupBy(*keys).agg(*measures)
    if median:
        medians = exact_median(deals, keys, amount, "median_amount")
        counted = counted.join(medians, list(keys), "left")
    coverage = F.when(
        F.col("deal_count") > 0,
        F.try_divide(100.0 * F.col("deals_with_size"), F.col("deal_count")),
    ).otherwise(F.lit(0.0))
    return counted.withColumn("size_coverage_pct", coverage)


def monthly_activity(deals: DataFrame, median: bool = True) -> DataFrame:
    """Monthly totals from the first to the last month; absent months are 0 in every column."""
    monthly = aggregate_activity(deals, ["month"], median=median)
    values = [c for c in monthly.columns if c != "month"]
    return fill_months(monthly, [], values)


def activity_by_sector(deals: DataFrame) -> DataFrame:
    return deals.where("sector is not null").groupBy("month", "sector").agg(
        F.count("deal_id").alias("deal_count"),
        F.coalesce(F.sum("deal_size"), F.lit(0.0)).alias("total_amount"),
    )


def activity_by_category(companies: DataFrame, category: str = "judge_category") -> DataFrame:
    """Full monthly statistics per category of judged companies, without calendar completion."""
    missing = [c for c in (category, "month") if c not in companies.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    rows = companies.where(F.col(category).isNotNull() & F.col("month").isNotNull())
    return aggregate_activity(
        rows, ["month", category], amount="total_raised", record="company_id", mean=False
    )


def deal_summary(deals: DataFrame) -> DataFrame:
    return deals.agg(
        F.count("*").alias("total_deals"),
        F.min("deal_date").alias("first_date"),
        F.max("deal_date").alias("last_date"),
        F.count("deal_size").alias("deals_with_size"),
        F.try_divide(100.0 * F.count("deal_size"), F.count("*")).alias("size_coverage_pct"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per known value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    )


def deals_by_year(deals: DataFrame) -> DataFrame:
    return deals.groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def top_sectors(deals: DataFrame, top: int = 10) -> DataFrame:
    return value_counts(deals, "sector").limit(top)


def exposure_band(
    score: Column, high: float = fixed.HIGH_EXPOSURE, low: float = fixed.LOW_EXPOSURE
) -> Column:
    """'high', 'low' or NULL in between."""
    return F.when(score >= high, "high").when(score <= low, "low")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark trims every partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
