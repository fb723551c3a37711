"""Keyword tags against labels: prompts, parsing, agreement, adaptive validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.stats import series_window
from newsgauge.operators.sampling import hashed_order, sample_random, stratified_ids

PROMPT = (
    "Title: %s\nSource: %s\nDate: %s\nContent: %s\n\n"
    "Does this article discuss government climate policy, is its uncertainty about "
    "implementation, reversal or none, and how certain are you from 1 to 5? Answer as JSON with "
    "is_climate_policy, uncertainty_type, certainty_level and reasoning."
)


def prompt_column(template: str = PROMPT, limit: int | None = None) -> Column:
    """One labelling request per article; with a limit, content beyond it ends in '...'."""
    short = F.coalesce("snippet", F.lit("No content"))
    if limit is not None:
        short = F.when(
            F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("..."))
        ).otherwise(short)
    return F.format_string(
        template,
        F.coalesce("title", F.lit("No title")),
        F.coalesce("source", F.lit("Unknown")),
        F.coalesce(F.col("date").cast("string"), F.lit("Unknown")),
        short,
    )


def parse_labels(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Validated label fields of JSON answers.

    Missing fields get their defaults; a wrong type or certainty leaves the fields NULL and says
    why in ``error``.
    """
    answer = F.from_json(
        column,
        "is_climate_policy boolean, uncertainty_type string, certainty_level int, "
        "reasoning string, _bad string",
        {"columnNameOfCorruptRecord": "_bad"},
    )
    kind = F.coalesce("_a.uncertainty_type", F.lit("none"))
    level = F.coalesce("_a.certainty_level", F.lit(3))
    error = (
        F.when(F.col("_a").isNull() | F.col("_a._bad").isNotNull(), "unreadable answer")
        .when(~kind.isin(fixed.UNCERTAINTY_TYPES), F.concat(F.lit("invalid uncertainty_type: "), kind))
        .when(~level.between(1, 5),
              F.concat(F.lit("certainty_level must be 1-5, got: "), level.cast("string")))
    )
    parsed = answers.withColumn("_a", answer).withColumn("error", error)
    valid = F.col("error").isNull()
    return parsed.select(
        *answers.columns,
        F.when(valid, F.coalesce("_a.is_climate_policy", F.lit(False))).alias("is_climate_policy"),
        F.when(valid, kind).alias("uncertainty_type"),
        F.when(valid, level).alias("certainty_level"),
        F.when(valid, F.col("_a.reasoning")).alias("reasoning"),
        "error",
    )


def label_stats(labels: DataFrame) -> DataFrame:
    kinds = {"reversal": "reversal", "implementation": "implementation", "no_uncertainty": "none"}
    return labels.agg(
        F.count("*").alias("total_classified"),
        F.count_if("is_climate_policy").alias("climate_policy_count"),
        *[F.count_if(F.col("uncertainty_type") == v).alias(f"{k}_count") for k, v in kinds.items()],
        F.avg("certainty_level").alias("avg_certainty"),
    )


def keyword_labels(articles: DataFrame, category: str = "keyword_category") -> DataFrame:
    """Keyword side of the comparison: every row counts as climate policy; the type defaults to none."""
    return articles.select(
        "id",
        F.lit(True).alias("kw_policy"),
        F.coalesce(F.col(category), F.lit("none")).alias("kw_type"),
    )


def _agreement(keys: Sequence[str] = ()) -> list[Column]:
    same_policy = F.col("kw_policy") == F.col("is_climate_policy")
    same_type = F.col("kw_type").eqNullSafe(F.col("uncertainty_type"))

    def share(hit: Column, of: Column) -> Column:
        return F.try_divide(F.count_if(hit & of), F.count_if(of))

    everything = F.lit(True)
    policy = F.coalesce(share(same_policy, everything), F.lit(0.0))
    kind = F.coalesce(share(same_type, everything), F.lit(0.0))
    return [
        ((policy + kind) / 2).alias("overall"),
        policy.alias("climate_policy_accuracy"),
        kind.alias("uncertainty_type_accuracy"),
        F.count("*").alias("total_compared"),
        *[share(same_type, F.col("kw_type") == t).alias(f"{t}_accuracy")
          for t in fixed.UNCERTAINTY_TYPES],
    ]


def compared(keywords: DataFrame, labels: DataFrame) -> DataFrame:
    """Articles with a usable label; labels without a policy verdict are skipped."""
    usable = labels.where("is_climate_policy is not null").select(
        F.col("article_id").alias("id"), "is_climate_policy", "uncertainty_type"
    )
    return keywords.join(usable, "id")


def agreement_metrics(keywords: DataFrame, labels: DataFrame) -> DataFrame:
    """Policy accuracy, type accuracy, their mean, and accuracy per keyword type."""
    return compared(keywords, labels).agg(*_agreement())


def adaptive_validation(
    articles: DataFrame, labels: DataFrame, category: str = "keyword_category",
    n: int = fixed.SAMPLE_SIZE, expansion: int = fixed.EXPANSION_SIZE,
    max_expansions: int = fixed.MAX_EXPANSIONS, target: float = fixed.AGREEMENT_TARGET,
    seed: int = 0,
) -> DataFrame:
    """Agreement on the smallest nested sample that reaches the target, or on the largest one.

    All samples are evaluated in one pass: every sampled article carries the round in which it
    enters and counts for that round and all later ones.
    """
    first = articles.select("id").join(stratified_ids(articles, category, n, seed), "id", "left_semi")
    rest = articles.select("id").join(first, "id", "left_anti")
    later = sample_random(rest, expansion * max_expansions, seed + 1).withColumn(
        "_rank", F.row_number().over(series_window((), [hashed_order(seed + 1), "id"]))
    )
    rounds = first.select("id", F.lit(0).cast("bigint").alias("entered")).unionByName(
        later.select("id", F.ceil(F.col("_rank") / expansion).alias("entered"))
    )
    samples = rounds.select(
        "id", F.explode(F.sequence("entered", F.lit(max_expansions).cast("bigint"))).alias("round")
    )
    sizes = samples.groupBy("round").agg(F.count("*").alias("sample_size"))
    # Cut the articles to the sample first, so that their tags are computed for it alone.
    sampled = articles.join(rounds.select("id"), "id", "left_semi")
    rows = compared(keyword_labels(sampled, category), labels).join(samples, "id")
    by_round = sizes.join(rows.groupBy("round").agg(*_agreement()), "round", "left").fillna(
        0.0, ["overall", "climate_policy_accuracy", "uncertainty_type_accuracy"]
    ).fillna(0, ["total_compared"])
    last = F.lit(max_expansions)
    stop = F.when((F.col("overall") >= target) | (F.col("round") == last), F.col("round"))
    return by_round.withColumn("_stop", F.min(stop).over(series_window(()))).where(
        "round = _stop"
    ).drop("_stop").withColumnRenamed("round", "expansions")


def validation_report(result: DataFrame, target: float = fixed.AGREEMENT_TARGET) -> DataFrame:
    """Pass or fail with one recommendation per row."""
    passed = F.col("overall") >= target
    weak = F.array_compact(F.array(
        F.when(~passed, "overall agreement below target: review terms or enlarge the sample"),
        F.when(~passed & (F.col("climate_policy_accuracy") < target),
               "policy detection is low: refine the climate or policy terms"),
        F.when(~passed & (F.col("uncertainty_type_accuracy") < target),
               "type agreement is low: refine the implementation or reversal terms"),
        F.when(passed, "agreement reaches the target"),
    ))
    return result.select(
        passed.alias("passed"), "overall", "sample_size", "expansions",
        F.explode(weak).alias("recommendation"),
    )
