"""From monthly counts to ratio indices with a base-period mean of 100."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.stats import pearson, series_window, stddev_or_zero
from newsgauge.operators.outlets import outlet_index

# Series name -> index type.
INDEX_TYPES = {
    "cpu": "CPU",
    "impl": "CPU_impl",
    "reversal": "CPU_reversal",
    "ira": "salience_ira",
    "obbba": "salience_obbba",
}


# Months before and after all data.
OPEN_BASE = ("1900-01", "2099-12")


def counts_to_raw(counts: DataFrame) -> DataFrame:
    """Pre-aggregated monthly counts in the layout of classification counts; no regime counts."""
    return counts.select(
        "month",
        F.col("denominator").alias("total_articles"),
        F.col("numerator_cpu").alias("uncertainty_count"),
        F.col("numerator_impl").alias("implementation_uncertainty_count"),
        F.col("numerator_reversal").alias("reversal_uncertainty_count"),
        F.lit(0).cast("bigint").alias("ira_count"),
        F.lit(0).cast("bigint").alias("obbba_count"),
    )


def raw_counts(monthly_counts: DataFrame | None, class_counts: DataFrame) -> DataFrame:
    """All rows from the pre-aggregated table unless it is empty, else from the articles."""
    if monthly_counts is not None and not monthly_counts.isEmpty():
        return counts_to_raw(monthly_counts)
    return class_counts.select(
        "month", "total_articles", "uncertainty_count", "implementation_uncertainty_count",
        "reversal_uncertainty_count", "ira_count", "obbba_count",
    )


def raw_index_values(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Five ratios and the direction balance per month; months without articles are dropped."""
    numerators = {
        "cpu": "uncertainty_count",
        "impl": "implementation_uncertainty_count",
        "reversal": "reversal_uncertainty_count",
        "ira": "ira_count",
        "obbba": "obbba_count",
    }
    value = {name: F.coalesce(F.col(source), F.lit(0)) for name, source in numerators.items()}
    both = value["impl"] + value["reversal"]
    return counts.where("total_articles > 0").select(
        *keys,
        "month",
        F.col("total_articles").alias("denominator"),
        *[v.alias(f"numerator_{n}") for n, v in value.items()],
        *[(v / F.col("total_articles")).alias(f"raw_ratio_{n}") for n, v in value.items()],
        F.when(both == 0, 0.0)
        .otherwise(F.try_divide(value["impl"] - value["reversal"], both))
        .alias("cpu_direction"),
    )


def raw_index_legacy(raw: DataFrame) -> DataFrame:
    """The older column names: reversal reads as down, implementation as up."""
    return raw.select(
        "month",
        "denominator",
        F.col("numerator_cpu").alias("numerator"),
        F.col("raw_ratio_cpu").alias("raw_ratio"),
        F.col("numerator_reversal").alias("numerator_down"),
        F.col("raw_ratio_reversal").alias("raw_ratio_down"),
        F.col("numerator_impl").alias("numerator_up"),
        F.col("raw_ratio_impl").alias("raw_ratio_up"),
    )


def mean_100(
    value: Column, keys: Sequence[str], base_start: str | None, base_end: str | None
) -> Column:
    """Scale a series to mean 100 over the base months.

    The whole series is the base when no (complete) base period is given, when no month falls
    into it, or when every base value is 0; a series with a non-positive mean becomes all 0.
    """
    window = series_window(keys)
    mean = F.avg(value).over(window)
    if base_start and base_end:
        in_base = F.when(F.col("month").between(base_start, base_end), value)
        usable = F.max(F.when(in_base != 0, True)).over(window)
        mean = F.when(usable, F.avg(in_base).over(window)).otherwise(mean)
    return F.when(mean > 0, value / mean * 100).otherwise(F.lit(0.0))


def normalize_index(
    raw: DataFrame,
    base_start: str | None = None,
    base_end: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add the five normalised series."""
    return raw.withColumns({
        f"normalized_{n}": mean_100(F.col(f"raw_ratio_{n}"), keys, base_start, base_end)
        for n in INDEX_TYPES
    })


def index_values(normalized: DataFrame) -> DataFrame:
    """Long form: one row per month and index type, ready for the index table."""
    cells = F.array(*[
        F.struct(
            F.lit(kind).alias("index_type"),
            F.col(f"numerator_{name}").alias("numerator"),
            F.col(f"normalized_{name}").alias("normalized"),
        )
        for name, kind in INDEX_TYPES.items()
    ])
    return fill_ratio(
        normalized.select("month", "denominator", F.inline(cells)).select(
            "month",
            "index_type",
            F.lit("").alias("outlet"),
            "denominator",
            "numerator",
            F.lit(None).cast("double").alias("raw_ratio"),
            "normalized",
            F.lit(False).alias("scaled"),
            F.lit("none").alias("dedup_strategy"),
        )
    )


def fill_ratio(values: DataFrame) -> DataFrame:
    """Missing raw ratio := numerator / denominator where the denominator is positive."""
    ratio = F.when(
        F.col("denominator") > 0, F.try_divide(F.col("numerator"), F.col("denominator"))
    )
    return values.withColumn("raw_ratio", F.coalesce(F.col("raw_ratio"), ratio))


def outlet_index_values(
    counts: DataFrame, base_start: str | None = None, base_end: str | None = None,
    outlets: Sequence[str] | None = None,
) -> DataFrame:
    """Every outlet's own main index as rows of the index table.

    ``counts``: (outlet, month, total_articles, uncertainty_count). A missing end of the base period is open; a list
    includes only its outlets, spelled as given; an outlet without a name is 'Unknown'.
    """
    panel = counts.select(
        F.coalesce("outlet", F.lit("Unknown")).alias("outlet"), "month",
        F.col("total_articles").alias("denominator"), F.col("uncertainty_count").alias("numerator"),
    )
    if outlets is not None:
        panel = panel.where(F.col("outlet").isin(list(outlets)))
    series = outlet_index(panel, base_start or OPEN_BASE[0], base_end or OPEN_BASE[1])
    return fill_ratio(series.select(
        "month", F.lit(INDEX_TYPES["cpu"]).alias("index_type"), "outlet", "denominator", "numerator",
        F.lit(None).cast("double").alias("raw_ratio"), F.col("value").alias("normalized"),
        F.lit(False).alias("scaled"), F.lit("none").alias("dedup_strategy"),
    ))


def build_index(
    counts: DataFrame, base_start: str | None = None, base_end: str | None = None
) -> DataFrame:
    """Raw counts to the long index table."""
    return index_values(normalize_index(raw_index_values(counts), base_start, base_end))


def index_stats(normalized: DataFrame) -> DataFrame:
    """Mean and sample deviation of every ratio and normalised series, plus the direction."""
    measures = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"raw_ratio_{n}").alias("raw"),
                 F.col(f"normalized_{n}").alias("norm"))
        for n in INDEX_TYPES
    ], F.struct(F.lit("direction").alias("name"), F.col("cpu_direction").alias("raw"),
                F.lit(None).cast("double").alias("norm")))
    return (
        normalized.select(F.inline(measures))
        .groupBy("name")
        .agg(
            F.avg("raw").alias("mean_raw"),
            stddev_or_zero(F.col("raw")).alias("std_raw"),
            F.min("raw").alias("min_raw"),
            F.max("raw").alias("max_raw"),
            F.avg("norm").alias("mean_norm"),
            F.when(F.count("norm") > 0, stddev_or_zero(F.col("norm"))).alias("std_norm"),
        )
    )


def aggregate_rows(values: DataFrame) -> DataFrame:
    """The pooled, unscaled rows without de-duplication."""
    return values.where("outlet = '' and not scaled and dedup_strategy = 'none'")


def index_scan(
    values: DataFrame, index_type: str, outlet: str = "", scaled: bool = False,
    dedup_strategy: str = "none",
) -> DataFrame:
    return values.where(
        (F.col("index_type") == index_type)
        & (F.col("outlet") == outlet)
        & (F.col("scaled") == scaled)
        & (F.col("dedup_strategy") == dedup_strategy)
    ).orderBy("month")


def index_types(values: DataFrame) -> DataFrame:
    return values.select("index_type").distinct()


def index_summary(values: DataFrame, keys: Sequence[str] = ("index_type",)) -> DataFrame:
    """Period, number of months, and moments over the non-zero normalised values."""
    norm = F.when(F.col("normalized") != 0, F.col("normalized"))
    return (
        values.groupBy(*keys)
        .agg(
            F.min("month").alias("first_month"),
            F.max("month").alias("last_month"),
            F.count("*").alias("num_months"),
            F.round(F.avg(norm), 1).alias("mean"),
            F.round(stddev_or_zero(norm), 1).alias("std"),
            F.round(F.min(norm), 1).alias("min"),
            F.round(F.max(norm), 1).alias("max"),
        )
        .where("mean is not null")
    )


def index_peaks(values: DataFrame, keys: Sequence[str] = ("index_type",), top: int = 3) -> DataFrame:
    """The highest and lowest months of every series, NULL counted as 0, earlier month first."""
    value = F.coalesce(F.col("normalized"), F.lit(0.0))
    ranked = values.select(
        *keys, "month", value.alias("value"),
        F.row_number().over(Window.partitionBy(*keys).orderBy(value.desc(), "month")).alias("_hi"),
        F.row_number().over(Window.partitionBy(*keys).orderBy(value.asc(), "month")).alias("_lo"),
    )
    sides = F.array(
        F.struct(F.lit("peak").alias("side"), F.col("_hi").alias("rank")),
        F.struct(F.lit("trough").alias("side"), F.col("_lo").alias("rank")),
    )
    return ranked.select(*keys, "month", F.round("value", 1).alias("value"), F.inline(sides)).where(
        F.col("rank") <= top
    )


def series_statistics(series: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, extremes with their first month, and length of each series."""
    v = F.col(value)
    return series.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        stddev_or_zero(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.min_by("month", F.struct(v, F.col("month"))).alias("min_month"),
        F.min_by("month", F.struct(-v, F.col("month"))).alias("max_month"),
        F.count("*").alias("n_months"),
    )


def full_index(values: DataFrame) -> DataFrame:
    """One row per month of the main index with all components side by side, 0 when missing.

    Salience columns carry counts, the others normalised values.
    """
    def pick(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("index_type") == kind, F.col(column)))

    anchored = aggregate_rows(values).groupBy("month").agg(
        F.count_if(F.col("index_type") == "CPU").alias("_cpu_rows"),
        pick("CPU", "normalized").alias("cpu"),
        F.coalesce(pick("CPU_impl", "normalized"), F.lit(0.0)).alias("cpu_impl"),
        F.coalesce(pick("CPU_reversal", "normalized"), F.lit(0.0)).alias("cpu_reversal"),
        F.coalesce(pick("salience_ira", "numerator"), F.lit(0)).alias("salience_ira"),
        F.coalesce(pick("salience_obbba", "numerator"), F.lit(0)).alias("salience_obbba"),
        F.coalesce(pick("CPU", "denominator"), F.lit(0)).alias("denominator"),
    )
    return anchored.where("_cpu_rows > 0").drop("_cpu_rows")


def index_type_correlations(values: DataFrame) -> DataFrame:
    """Correlations among the main index and its components; 0.0 for a constant side."""
    wide = full_index(values).withColumn("cpu", F.coalesce("cpu", F.lit(0.0)))
    pairs = [("cpu", "cpu_impl"), ("cpu", "cpu_reversal"), ("cpu_impl", "cpu_reversal")]
    names = ["cpu_impl", "cpu_reversal", "impl_reversal"]
    return wide.agg(
        F.count("*").alias("num_months"),
        *[
            F.coalesce(pearson(F.col(a), F.col(b)), F.lit(0.0)).alias(f"corr_{name}")
            for (a, b), name in zip(pairs, names)
        ],
        F.avg("cpu").alias("cpu_mean"),
        F.avg("cpu_impl").alias("impl_mean"),
        F.avg("cpu_reversal").alias("reversal_mean"),
    )


def counts_index(counts: DataFrame) -> DataFrame:
    """Counts file to three ratio series scaled to an overall mean of 100."""
    window = series_window(())
    ratios = counts.withColumns({
        f"ratio_{n}": F.try_divide(F.col(f"numerator_{n}"), F.col("denominator"))
        for n in ("cpu", "impl", "reversal")
    })
    names = {"cpu": "cpu_index", "impl": "cpu_impl", "reversal": "cpu_reversal"}
    return ratios.withColumns({
        target: F.try_divide(F.col(f"ratio_{n}"), F.avg(f"ratio_{n}").over(window)) * 100
        for n, target in names.items()
    })


def composition_share(series: DataFrame) -> DataFrame:
    """Implementation and reversal as percentages of their sum (a zero sum divides by 1)."""
    total = F.col("cpu_impl") + F.col("cpu_reversal")
    base = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return series.select(
        "month",
        (F.col("cpu_impl") / base * 100).alias("impl_pct"),
        (F.col("cpu_reversal") / base * 100).alias("reversal_pct"),
    )


def direction_balance(series: DataFrame) -> DataFrame:
    """(impl - reversal) / (impl + reversal) on normalised values, 0 unless the sum is positive."""
    impl = F.coalesce(F.col("cpu_impl"), F.lit(0.0))
    reversal = F.coalesce(F.col("cpu_reversal"), F.lit(0.0))
    total = impl + reversal
    return series.select(
        "month",
        F.when(total > 0, F.try_divide(impl - reversal, total)).otherwise(0.0).alias("balance"),
    )


def volume_outliers(volume: DataFrame, value: str = "denominator") -> DataFrame:
    """Months whose volume exceeds mean + 2 population standard deviations."""
    window = series_window(())
    v = F.col(value)
    return volume.select("month", v.alias("volume")).withColumns({
        "mean_volume": F.avg("volume").over(window),
        "threshold": F.avg("volume").over(window) + 2 * F.stddev_pop("volume").over(window),
    }).withColumn("is_outlier", F.col("volume") > F.col("threshold"))


def memo_stats(series: DataFrame, value: str = "cpu") -> DataFrame:
    """Latest month with its value, extremes and number of months."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return series.agg(
        F.max("month").alias("current_month"),
        F.max_by(v, F.col("month")).alias("current_value"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.count("*").alias("n_months"),
    )
