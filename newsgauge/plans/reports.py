"""Whole analyses: text to index, deals to lead-lag, sectors, exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.lexicon import DEFAULT_LEXICON, Lexicon
from newsgauge.operators import deals as dl
from newsgauge.operators import events as ev
from newsgauge.operators import index as ix
from newsgauge.operators import leadlag as ll
from newsgauge.operators import outlets as ou
from newsgauge.operators import panel as pn
from newsgauge.operators import sector as sc
from newsgauge.operators import tagging as tg
from newsgauge.sources import exports as ex
from newsgauge.sources.files import read_deals

LEADLAG_PAIRS = [
    ("cpu_index", "deal_count"), ("cpu_impl", "deal_count"),
    ("cpu_reversal", "deal_count"), ("cpu_index", "total_amount"),
]


def article_index(
    articles: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON,
    base_start: str | None = None, base_end: str | None = None,
) -> DataFrame:
    """Corpus to the long index table in one plan."""
    tagged = tg.classify_articles(articles, lexicon, include_matched_terms=False, keep=["month"])
    counts = tg.count_tagged(tagged)
    return ix.build_index(ix.raw_counts(None, counts), base_start, base_end)


def count_index(
    articles: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON,
    base_start: str | None = None, base_end: str | None = None,
) -> DataFrame:
    """Corpus to the index over boolean-query counts."""
    counts = ix.counts_to_raw(tg.monthly_counts(articles, lexicon))
    return ix.build_index(counts, base_start, base_end)


def outlet_indices(
    articles: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON,
    base: tuple[str, str] = fixed.OUTLET_BASE,
) -> DataFrame:
    """Every outlet's own index over the tagged corpus."""
    tagged = tg.classify_articles(
        articles, lexicon, include_matched_terms=False, keep=["source", "month"]
    ).withColumnRenamed("source", "outlet")
    panel = tg.count_tagged(tagged, ["outlet", "month"], by_outlet=True).select(
        "outlet", "month", F.col("uncertainty_count").alias("numerator"),
        F.col("total_articles").alias("denominator"),
    )
    return ou.outlet_index(panel, *base)


def monthly_metrics(
    spark: SparkSession, path: str, min_date: str = fixed.DEAL_MIN_DATE
) -> DataFrame:
    """Deals export to calendar-complete monthly activity."""
    return dl.monthly_activity(read_deals(spark, path, min_date))


def deals_panel(deals: DataFrame, index: DataFrame, median: bool = True) -> DataFrame:
    """Monthly activity next to the index components."""
    return pn.panel_overlap(dl.monthly_activity(deals, median), index)


def leadlag_run(deals: DataFrame, index: DataFrame, folder: str) -> dict[str, str]:
    """Merged panel, the four fixed lead-lag pairs and the summary table as files."""
    panel = deals_panel(deals, index).cache()
    try:
        summary = ["cpu_index", "cpu_impl", "cpu_reversal", "deal_count", "total_amount"]
        tables = {
            "merged_cpu_vc_monthly": panel.orderBy("month"),
            "correlation_results": ll.leadlag_pairs(panel, LEADLAG_PAIRS),
            "panel_summary": pn.panel_summary(panel, summary),
        }
        return {n: ex.write_csv(df, os.path.join(folder, n)) for n, df in tables.items()}
    finally:
        panel.unpersist()


def sector_run(
    companies: DataFrame, index: DataFrame, classifiers: dict[str, str], folder: str,
    start_date: str = fixed.RECENT_START, metric: str = "deal_count",
) -> dict[str, str]:
    """Sector rankings, decomposition, stratification and classifier robustness as files."""
    options = {"start_date": start_date, "metric": metric}
    robust = sc.classifier_robustness(companies, index, classifiers, **options)
    tables = {
        "sector_rankings": sc.sector_ranking(companies, index, **options),
        "decomposition": sc.decomposition(companies, index, **options),
        "ira_stratification": sc.exposure_strata(companies, index, **options),
        "classifier_robustness": robust,
        "classifier_agreement": sc.classifier_agreement(robust),
    }
    return {n: ex.write_csv(df, os.path.join(folder, n)) for n, df in tables.items()}


def full_report(
    values: DataFrame, outlet_series: DataFrame, outlets: list[str], folder: str
) -> list[str]:
    """The CSV package plus volume outliers and the event check."""
    index = ix.full_index(values).cache()
    try:
        paths = ex.export_all(index, outlet_series, outlets, os.path.join(folder, "csv"))
        series = index.select("month", index["cpu"].alias("value"))
        extra = {
            "volume_outliers": ix.volume_outliers(index),
            "event_validation": ev.check_window(series),
            "memo_stats": ix.memo_stats(index),
        }
        paths += [ex.write_csv(df, os.path.join(folder, n)) for n, df in extra.items()]
        return paths
    finally:
        index.unpersist()
