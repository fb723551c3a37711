"""Robustness variants of one index: catalogue, counts of all variants in one scan, comparison."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.stats import pearson, ratio_or_zero
from newsgauge.lexicon import DEFAULT_LEXICON, Lexicon
from newsgauge.operators.outlets import average_outlets, base_normalize, standardize
from newsgauge.operators.tagging import category_hit, category_matches, with_tokens

PHASES = {1: "REQUIRED", 2: "RECOMMENDED", 3: "OPTIONAL"}
DEFAULT_TYPES = ("CPU", "CPU_impl", "CPU_reversal", "salience_ira", "salience_obbba")
# Counts from which outlets are left out.
WHOLE = ""
# Categories whose matched terms decide a variant.
TERM_CATEGORIES = (
    "climate", "policy", "uncertainty", "implementation", "reversal", "regime_ira", "regime_obbba",
)


@dataclass(frozen=True)
class Variant:
    """One deviation from the baseline."""

    name: str
    phase: int
    exclude_keywords: tuple[str, ...] = ()
    exclude_outlets: tuple[str, ...] = ()
    exclude_sets: tuple[str, ...] = ()
    require_uncertainty: bool = True
    use_labels: bool = False
    confidence: float = 0.85
    base_start: str | None = None
    base_end: str | None = None
    skip_volume_scaling: bool = False
    skip_standardization: bool = False
    index_types: tuple[str, ...] = DEFAULT_TYPES
    placebo: str | None = None


def variant_list(
    lexicon: Lexicon = DEFAULT_LEXICON, outlets: Sequence[str] = fixed.NEWS_OUTLETS,
    phase: int = 3,
) -> list[Variant]:
    """Baseline, single-term and single-outlet drops, label, base, placebo, step and set variants."""
    def slug(text: str) -> str:
        return text.replace(" ", "_")

    salience = ("salience_ira", "salience_obbba")
    variants = [Variant("baseline", 1)]
    variants += [
        Variant(f"drop_{category}_{slug(term)}", 1, exclude_keywords=(term,))
        for category in ("uncertainty", "climate", "policy")
        for term in lexicon.terms(category)
    ]
    variants += [
        Variant(f"drop_outlet_{slug(o).lower()}", 1, exclude_outlets=(o,)) for o in outlets
    ]
    variants += [
        Variant("llm_validated", 1, use_labels=True),
        Variant("no_uncertainty_requirement", 1, require_uncertainty=False),
        Variant("base_2021", 2, base_start="2021-01", base_end="2021-12"),
        Variant("base_2022", 2, base_start="2022-01", base_end="2022-12"),
        Variant("base_pre_ira", 2, base_start="2021-01", base_end="2022-07"),
        Variant("base_post_ira", 2, base_start="2022-09", base_end="2024-10"),
        Variant("llm_threshold_50", 2, use_labels=True, confidence=0.50),
        Variant("llm_threshold_70", 2, use_labels=True, confidence=0.70),
        Variant("llm_threshold_95", 2, use_labels=True, confidence=0.95),
        Variant("placebo_trade_policy", 2, placebo="trade", index_types=("TPU",)),
        Variant("placebo_monetary_policy", 2, placebo="monetary", index_types=("MPU",)),
        Variant("decomposition_only", 2, index_types=("CPU_impl", "CPU_reversal")),
        Variant("skip_volume_scaling", 2, skip_volume_scaling=True),
        Variant("skip_standardization", 2, skip_standardization=True),
        Variant("exclude_implementation_terms", 3, exclude_sets=("implementation",),
                index_types=("CPU", "CPU_reversal", *salience)),
        Variant("exclude_reversal_terms", 3, exclude_sets=("reversal",),
                index_types=("CPU", "CPU_impl", *salience)),
        Variant("exclude_regime_terms", 3, exclude_sets=("regime_ira", "regime_obbba"),
                index_types=("CPU", "CPU_impl", "CPU_reversal")),
    ]
    return [v for v in variants if v.phase <= phase]


RECORD = (
    "array<struct<variant: string, phase: int, terms_out: array<string>, outlets_out: array<string>, "
    "sets_out: array<string>, require_uncertainty: boolean, use_labels: boolean, confidence: double, "
    "base_start: string, base_end: string, skip_volume_scaling: boolean, "
    "skip_standardization: boolean, index_types: array<string>, placebo: string>>"
)


def variant_structs(variants: Sequence[Variant]) -> Column:
    """The catalogue as one constant array of records, small by construction."""
    records = [
        {
            "variant": v.name, "phase": v.phase,
            "terms_out": [t.lower() for t in v.exclude_keywords],
            "outlets_out": [o.lower() for o in v.exclude_outlets], "sets_out": v.exclude_sets,
            "require_uncertainty": v.require_uncertainty, "use_labels": v.use_labels,
            "confidence": v.confidence, "base_start": v.base_start, "base_end": v.base_end,
            "skip_volume_scaling": v.skip_volume_scaling,
            "skip_standardization": v.skip_standardization,
            "index_types": v.index_types, "placebo": v.placebo,
        }
        for v in variants
    ]
    return F.from_json(F.lit(json.dumps(records)), RECORD)


def variant_catalog(spark: SparkSession, variants: Sequence[Variant]) -> DataFrame:
    return spark.range(1).select(F.inline(variant_structs(variants)))


def variant_phase_summary(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("phase").agg(
        F.count("*").alias("n_variants"), F.sort_array(F.collect_list("variant")).alias("names")
    )


def variant_monthly_counts(
    articles: DataFrame, variants: Sequence[Variant], lexicon: Lexicon = DEFAULT_LEXICON,
    labels: DataFrame | None = None, keys: Sequence[str] = ("month", "outlet"),
) -> DataFrame:
    """Counts of every variant from one scan of the corpus.

    Articles are tagged once and collapsed to (keys, terms found, label) combinations with a
    count; only the combinations meet the variants. A variant excludes terms from every category,
    an outlet, or a whole category. Variants that only leave out outlets cost no pass over combinations: they are the
    baseline's counts per outlet without the outlets' own part. Label variants keep an article only if a present label confirms
    it with enough certainty (certainty / 5). A placebo counts domain, policy and uncertainty.
    """
    categories = [*TERM_CATEGORIES, "trade", "monetary"]
    rows = with_tokens(
        articles.withColumn("outlet", F.col("source")), lexicon, categories
    ).select(
        "id", *keys,
        *[F.transform(category_matches(lexicon, c), F.lower).alias(f"m_{c}") for c in TERM_CATEGORIES],
        category_hit(lexicon, "trade").alias("trade"),
        category_hit(lexicon, "monetary").alias("monetary"),
    )
    if labels is not None:
        confirmed = F.when(
            F.col("is_climate_policy") & (F.col("uncertainty_type") != "none"),
            F.col("certainty_level") / 5.0,
        ).otherwise(F.lit(0.0))
        verdict = labels.select(F.col("article_id").alias("id"), confirmed.alias("certainty"))
        rows = rows.join(verdict, "id", "left")
    else:
        rows = rows.withColumn("certainty", F.lit(None).cast("double"))
    tags = [*[f"m_{c}" for c in TERM_CATEGORIES], "trade", "monetary", "certainty"]
    combos = rows.groupBy(*keys, *tags).agg(F.count("*").alias("_n"))
    drops = [v for v in variants if "outlet" in keys and v.exclude_outlets
             and v == replace(Variant(v.name, v.phase), exclude_outlets=v.exclude_outlets)]
    counted = [v for v in variants if v not in drops] + ([Variant(WHOLE, 1)] if drops else [])
    crossed = combos.select("*", F.inline(variant_structs(counted)))

    def left(category: str) -> Column:
        kept = F.size(F.array_except(f"m_{category}", "terms_out")) > 0
        return kept & ~F.array_contains("sets_out", category)

    flags = crossed.select(
        "variant", *keys, "_n", "placebo", "require_uncertainty",
        (~F.array_contains("outlets_out", F.lower("outlet"))).alias("_outlet"),
        *[left(c).alias(c) for c in TERM_CATEGORIES],
        F.when(F.col("placebo") == "trade", F.col("trade"))
        .otherwise(F.col("monetary")).alias("_domain"),
        (~F.col("use_labels") | F.col("certainty").isNull()
         | (F.col("certainty") >= F.col("confidence"))).alias("_confirmed"),
    ).where(F.coalesce("_outlet", F.lit(True)))
    is_placebo = F.col("placebo").isNotNull()
    corpus = is_placebo | (F.col("climate") & F.col("policy"))
    gate = F.col("_confirmed") & (F.col("uncertainty") | ~F.col("require_uncertainty"))
    any_sign = F.col("uncertainty") | F.col("reversal") | F.col("implementation")
    main = F.when(
        is_placebo, F.col("_domain") & F.col("policy") & F.col("uncertainty")
    ).otherwise(corpus & gate & any_sign)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(F.lit(0)))

    own = corpus & ~is_placebo
    counts = flags.groupBy("variant", *keys).agg(
        total(corpus).alias("denominator"),
        total(main).alias("numerator_cpu"),
        total(own & gate & F.col("implementation")).alias("numerator_impl"),
        total(own & gate & F.col("reversal")).alias("numerator_reversal"),
        total(own & F.col("regime_ira")).alias("numerator_ira"),
        total(own & F.col("regime_obbba")).alias("numerator_obbba"),
    )
    return _leave_out(counts, drops) if drops else counts


def _leave_out(counts: DataFrame, drops: Sequence[Variant]) -> DataFrame:
    """The rows of WHOLE repeated for every variant that keeps their outlet; other rows stay."""
    names = F.transform(
        F.filter(variant_structs(drops), lambda v: ~F.coalesce(
            F.array_contains(v["outlets_out"], F.lower("outlet")), F.lit(False))),
        lambda v: v["variant"],
    )
    repeated = F.when(F.col("variant") == WHOLE, names).otherwise(F.array("variant"))
    rest = [c for c in counts.columns if c != "variant"]
    return counts.select(F.explode(repeated).alias("variant"), *rest)


def variant_index(
    counts: DataFrame, variants: Sequence[Variant], base_start: str, base_end: str,
    numerator: str = "numerator_cpu",
) -> DataFrame:
    """Pooled outlet index of every variant with the variant's own base and steps.

    Series are divided by their deviation without centring, so that the base mean is a level.
    """
    def setting(get) -> Column:
        column = F.lit(None)
        for v in variants:
            if get(v) is not None:
                column = F.when(F.col("variant") == v.name, F.lit(get(v))).otherwise(column)
        return column

    raw = F.coalesce(setting(lambda v: v.skip_volume_scaling or None), F.lit(False))
    unscaled = F.coalesce(setting(lambda v: v.skip_standardization or None), F.lit(False))
    panel = counts.select(
        "variant", "month", "outlet",
        F.when(raw, F.col(numerator).cast("double"))
        .otherwise(ratio_or_zero(F.col(numerator), F.col("denominator"))).alias("value"),
    )
    keys = ["variant", "outlet"]
    scaled = standardize(panel.withColumn("_own", F.col("value")), keys, center=False)
    chosen = scaled.withColumn("value", F.when(unscaled, F.col("_own")).otherwise(F.col("value")))
    start = F.coalesce(setting(lambda v: v.base_start).cast("string"), F.lit(base_start))
    end = F.coalesce(setting(lambda v: v.base_end).cast("string"), F.lit(base_end))
    return base_normalize(average_outlets(chosen, ["variant"]), start, end, ["variant"])


def variant_correlation(series: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Correlation of every variant with the baseline over common months; NULL below 2."""
    base = series.where(F.col("variant") == baseline).select("month", F.col("value").alias("_base"))
    return (
        series.where(F.col("variant") != baseline)
        .join(base, "month")
        .groupBy("variant")
        .agg(F.count("*").alias("n_months"), pearson(F.col("value"), F.col("_base")).alias("correlation"))
        .withColumn("correlation", F.when(F.col("n_months") >= 2, F.col("correlation")))
    )


def variant_sensitivity(correlations: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Lowest correlations first, flagged when below the threshold."""
    return correlations.select(
        "variant", "correlation", (F.col("correlation") < threshold).alias("below_threshold")
    ).orderBy(F.asc_nulls_first("correlation"), "variant")


def low_correlations(correlations: DataFrame, threshold: float = 0.90) -> DataFrame:
    return correlations.where(F.col("correlation") < threshold).orderBy("correlation", "variant")


def criteria_check(measured: DataFrame, criteria: Sequence[tuple] = fixed.CRITERIA) -> DataFrame:
    """Judge measured values (criterion, value): lower bound, upper bound (exclusive alone), or band."""
    table = measured.sparkSession.createDataFrame(
        list(criteria), "criterion string, metric string, lower double, upper double"
    )
    value = F.col("value")
    passed = (
        F.when(value.isNull(), None)
        .when(F.col("lower").isNull(), value < F.col("upper"))
        .when(F.col("upper").isNull(), value >= F.col("lower"))
        .otherwise(value.between(F.col("lower"), F.col("upper")))
    )
    return measured.join(F.broadcast(table), "criterion").select(
        "criterion", "metric", "value", "lower", "upper", passed.alias("passed")
    )
