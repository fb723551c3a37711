"""Reproducible sampling by hashed order: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.session import cut_lineage

# Leading hexadecimal digits of the order that make the number of a row; they fit a double exactly.
DIGITS = 13
# Standard deviations by which a threshold exceeds the expected number of rows.
MARGIN = 6.0
# Strata whose thresholds are broadcast; beyond that number they are joined by a shuffle.
BROADCAST_STRATA = 100_000


def hashed_order(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_random(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` rows in hashed order (a top-n, not a sort of everything)."""
    return df.orderBy(hashed_order(seed, key), key).limit(n)


def unclassified_sample(
    articles: DataFrame, labels: DataFrame, n: int, seed: int = 0
) -> DataFrame:
    """Up to ``n`` articles that have no label yet."""
    done = labels.select(F.col("article_id").alias("id"))
    return sample_random(articles.join(done, "id", "left_anti"), n, seed)


def stratified_ids(
    articles: DataFrame, stratum: str, n: int = fixed.SAMPLE_SIZE, seed: int = 0
) -> DataFrame:
    """Ids of a proportional sample of ``n`` rows, everything when there are no more than ``n``.

    Each stratum gives floor(n * share) rows but at least 1; rows missing to ``n`` are topped up
    from the remainder in hashed order, and surplus from the minimum of 1 is cut at ``n``.

    The hashed order of a row is also a number from 0 to 1. Strata are counted, and a row passes when its number is below
    its stratum's quota over size, or below n over all rows, each with a margin; only rows that pass are ranked,
    about n and a few per stratum. If a stratum or the top-up got fewer than it needs, which the
    margin makes rare, the pass is repeated with a wider one, so the result is exact.
    """
    # a stratum may be dear to compute, so ids and strata are kept; the articles are not read again
    thin = cut_lineage(articles.select("id", F.coalesce(F.col(stratum), F.lit("unknown")).alias("_stratum")))
    number = F.conv(F.substring("_order", 1, DIGITS), 16, 10).cast("double") / 16**DIGITS
    rows = thin.withColumn("_order", hashed_order(seed)).withColumn("_number", number)
    sizes = cut_lineage(rows.groupBy("_stratum").agg(F.count("*").alias("_size")))
    strata, total = sizes.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    quota = F.least(
        F.col("_size"), F.greatest(F.lit(1), F.floor(F.lit(n) * (F.col("_size") / F.lit(total))))
    )
    quotas = sizes.withColumn("_quota", quota)
    margin = MARGIN
    while True:
        anywhere = (n + margin * n**0.5 + margin**2) / max(total, 1)
        own = (F.col("_quota") + margin * F.sqrt("_quota") + margin**2) / F.col("_size")
        bounds = quotas.withColumn("_bound", F.greatest(F.lit(anywhere), own))
        passed = rows.join(F.broadcast(bounds) if strata <= BROADCAST_STRATA else bounds, "_stratum")
        passed = cut_lineage(passed.where(F.col("_number") < F.col("_bound")))
        got = passed.groupBy("_stratum").agg(
            F.count("*").alias("_got"), F.count_if(F.col("_number") < anywhere).alias("_low"))
        short, low = quotas.join(got, "_stratum", "left").agg(
            F.count_if(F.coalesce("_got", F.lit(0)) < F.col("_quota")), F.coalesce(F.sum("_low"), F.lit(0))
        ).first()
        if not short and low >= min(n, total):
            break
        margin = 4 * margin + 4
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy("_order", "id"))
    tiers = passed.withColumn("_rank", rank).withColumn(
        "_tier", F.when(F.col("_rank") <= F.col("_quota"), 0).otherwise(1))
    # the top n are taken per task first, however many strata there are
    return tiers.orderBy(
        "_tier", F.when(F.col("_tier") == 0, F.col("_stratum")), "_order", "id"
    ).limit(n).select("id")


def sample_stratified(
    articles: DataFrame, stratum: str, n: int = fixed.SAMPLE_SIZE, seed: int = 0
) -> DataFrame:
    return articles.join(stratified_ids(articles, stratum, n, seed), "id", "left_semi")


def sample_expand(
    articles: DataFrame, current: DataFrame, additional: int = fixed.EXPANSION_SIZE, seed: int = 0
) -> DataFrame:
    """The current sample plus ``additional`` new rows; sample k is part of sample k + 1."""
    rest = articles.join(current.select("id"), "id", "left_anti")
    return current.unionByName(sample_random(rest, additional, seed))
