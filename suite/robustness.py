"""Queries over all robustness variants of one index."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.stats import pearson
from newsgauge.operators import events as ev
from newsgauge.operators import variants as va
from suite import inputs as i
from suite.registry import query, r, rounded

VARIANTS = va.variant_list(i.LEXICON, i.SOURCES)
BASE = ("2021-02", "2022-06")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _text(value) -> str:
    return "NULL" if value is None else f"'{value}'"


CATALOG = "variants(variant, phase, terms_out, outlets_out, sets_out, need, labelled, confidence, bs, be, " \
    "skip_volume, skip_std, placebo) AS (VALUES " + ",\n".join(
        f"('{v.name}', {v.phase}, {_list(t.lower() for t in v.exclude_keywords)}, "
        f"{_list(o.lower() for o in v.exclude_outlets)}, {_list(v.exclude_sets)}, {v.require_uncertainty}, "
        f"{v.use_labels}, {v.confidence}, {_text(v.base_start)}, {_text(v.base_end)}, "
        f"{v.skip_volume_scaling}, {v.skip_standardization}, {_text(v.placebo)})"
        for v in VARIANTS
    ) + ")"

MATCHED = "m AS (SELECT id, month, source AS outlet, certainty, " + ", ".join(
    f"list_transform({i.matched_sql(i.TERMS[c])}, lambda t: lower(t)) AS m_{c}" for c in va.TERM_CATEGORIES
) + f""", {i.any_sql(i.TERMS['trade'])} AS trade, {i.any_sql(i.TERMS['monetary'])} AS monetary
  FROM texts LEFT JOIN (SELECT article_id AS id, CASE WHEN is_climate_policy AND uncertainty_type <> 'none'
                        THEN certainty_level / 5.0 ELSE 0 END AS certainty FROM llm) USING (id))"""

FLAGS = "f AS (SELECT variant, phase, month, outlet, need, placebo, " + ", ".join(
    f"len(list_filter(m_{c}, lambda t: NOT list_contains(terms_out, t))) > 0 AND NOT list_contains(sets_out, '{c}') AS {c}"
    for c in va.TERM_CATEGORIES
) + """, CASE placebo WHEN 'trade' THEN trade ELSE monetary END AS domain,
  NOT labelled OR certainty IS NULL OR certainty >= confidence AS ok
  FROM m, variants WHERE NOT list_contains(outlets_out, lower(outlet)))"""

COUNTED = """vc AS (SELECT variant, any_value(phase) AS phase, month, outlet,
  count(*) FILTER (WHERE placebo IS NOT NULL OR (climate AND policy)) AS denominator,
  count(*) FILTER (WHERE CASE WHEN placebo IS NOT NULL THEN domain AND policy AND uncertainty
    WHEN need THEN climate AND policy AND ok AND uncertainty
    ELSE climate AND policy AND ok AND (uncertainty OR reversal OR implementation) END) AS numerator_cpu,
  count(*) FILTER (WHERE placebo IS NULL AND climate AND policy AND ok AND (uncertainty OR NOT need) AND implementation)
    AS numerator_impl,
  count(*) FILTER (WHERE placebo IS NULL AND climate AND policy AND ok AND (uncertainty OR NOT need) AND reversal)
    AS numerator_reversal,
  count(*) FILTER (WHERE placebo IS NULL AND climate AND policy AND regime_ira) AS numerator_ira,
  count(*) FILTER (WHERE placebo IS NULL AND climate AND policy AND regime_obbba) AS numerator_obbba
  FROM f GROUP BY variant, month, outlet)"""

COUNTS = i.with_(i.ARTICLES, i.TEXT, i.LABELS, CATALOG, MATCHED, FLAGS, COUNTED)

INDEX = f"""vz AS (
  SELECT variant, month, outlet, CASE WHEN skip_std THEN v WHEN stddev_pop(v) OVER w > 1e-10
         THEN v / stddev_pop(v) OVER w ELSE 0 END AS value, coalesce(bs, '{BASE[0]}') AS bs, coalesce(be, '{BASE[1]}') AS be
  FROM (SELECT vc.*, skip_std, bs, be, CASE WHEN skip_volume THEN numerator_cpu WHEN denominator > 0
        THEN numerator_cpu / denominator ELSE 0 END AS v FROM vc JOIN variants USING (variant))
  WINDOW w AS (PARTITION BY variant, outlet)),
va AS (SELECT variant, month, avg(value) AS value, any_value(bs) AS bs, any_value(be) AS be FROM vz GROUP BY 1, 2),
vm AS (SELECT *, avg(CASE WHEN month BETWEEN bs AND be THEN value END) OVER (PARTITION BY variant) AS mean FROM va),
vi AS (SELECT variant, month, CASE WHEN mean IS NULL THEN value WHEN mean <> 0 THEN value / mean * 100 ELSE 0 END AS value
       FROM vm),
vcor AS (SELECT a.variant, count(*) AS n_months, CASE WHEN count(*) >= 2 AND stddev_pop(a.value) > 0
         AND stddev_pop(b.value) > 0 THEN corr(a.value, b.value) END AS correlation
         FROM vi a JOIN vi b ON a.month = b.month AND b.variant = 'baseline' WHERE a.variant <> 'baseline' GROUP BY 1)"""
INDEXED = COUNTS.rstrip() + ",\n" + INDEX + "\n"


def _counts(spark, sf):
    return va.variant_monthly_counts(i.articles(spark, sf), VARIANTS, i.LEXICON, i.labels(spark, sf))


def _series(spark, sf):
    return va.variant_index(_counts(spark, sf), VARIANTS, *BASE)


@query("variant_monthly_counts", COUNTS + "SELECT * EXCLUDE (phase) FROM vc")
def _(spark, sf):
    return _counts(spark, sf)


@query("variant_catalog", COUNTS + """
SELECT variant, phase, CAST(sum(denominator) AS BIGINT) AS articles, CAST(sum(numerator_cpu) AS BIGINT) AS counted
FROM vc GROUP BY variant, phase""")
def _(spark, sf):
    totals = _counts(spark, sf).groupBy("variant").agg(
        F.sum("denominator").alias("articles"), F.sum("numerator_cpu").alias("counted")
    )
    catalog = va.variant_catalog(spark, VARIANTS).select("variant", "phase")
    return totals.join(catalog, "variant")


@query("variant_phase_summary", COUNTS + """
SELECT phase, count(*) AS n_variants, string_agg(variant, ',' ORDER BY variant) AS names
FROM (SELECT DISTINCT phase, variant FROM vc) GROUP BY phase""")
def _(spark, sf):
    used = _counts(spark, sf).select("variant").distinct()
    catalog = va.variant_catalog(spark, VARIANTS).join(used, "variant", "left_semi")
    return va.variant_phase_summary(catalog).withColumn("names", F.concat_ws(",", "names"))


@query("variant_index", INDEXED + f"SELECT variant, month, {r('value')} AS value FROM vi")
def _(spark, sf):
    return rounded(_series(spark, sf))


@query("variant_correlation", INDEXED + f"SELECT variant, n_months, {r('correlation')} AS correlation FROM vcor")
def _(spark, sf):
    return rounded(va.variant_correlation(_series(spark, sf)))


@query("variant_sensitivity", INDEXED + f"""
SELECT variant, {r('correlation')} AS correlation, correlation < 0.95 AS below_threshold FROM vcor""")
def _(spark, sf):
    return rounded(va.variant_sensitivity(va.variant_correlation(_series(spark, sf))))


@query("variant_low_corr", INDEXED + f"""
SELECT variant, n_months, {r('correlation')} AS correlation FROM vcor WHERE correlation < 0.90""")
def _(spark, sf):
    return rounded(va.low_correlations(va.variant_correlation(_series(spark, sf))))


GROUPS = """CASE WHEN variant LIKE 'drop\\_outlet%' ESCAPE '\\' THEN 'outlet_robustness'
  WHEN variant LIKE 'drop\\_%' ESCAPE '\\' THEN 'keyword_dropping' WHEN variant LIKE 'base\\_%' ESCAPE '\\' THEN 'base_period'
  WHEN variant LIKE 'placebo\\_%' ESCAPE '\\' THEN 'placebo' WHEN variant = 'llm_validated' THEN 'llm_validation' END"""


def _measured(spark, sf):
    """Worst value of each criterion over its variants, plus the event accuracy."""
    correlations = va.variant_correlation(_series(spark, sf))
    group = (
        F.when(F.col("variant").startswith("drop_outlet"), "outlet_robustness")
        .when(F.col("variant").startswith("drop_"), "keyword_dropping")
        .when(F.col("variant").startswith("base_"), "base_period")
        .when(F.col("variant").startswith("placebo_"), "placebo")
        .when(F.col("variant") == "llm_validated", "llm_validation")
    )
    return correlations.withColumn("criterion", group).where("criterion is not null").groupBy("criterion").agg(
        F.when(F.col("criterion") == "placebo", F.max("correlation")).otherwise(F.min("correlation")).alias("value")
    )


@query("criteria_check", INDEXED + f""",
crit(criterion, metric, lower, upper) AS (VALUES ('keyword_dropping', 'correlation_with_baseline', 0.95, NULL),
  ('outlet_robustness', 'correlation_with_baseline', 0.80, NULL), ('llm_validation', 'correlation_keyword_vs_llm', 0.90, NULL),
  ('base_period', 'correlation_across_periods', 0.99, NULL), ('placebo', 'correlation_with_placebo', NULL, 0.70)),
g AS (SELECT criterion, CASE WHEN criterion = 'placebo' THEN max(correlation) ELSE min(correlation) END AS value
      FROM (SELECT {GROUPS} AS criterion, correlation FROM vcor) WHERE criterion IS NOT NULL GROUP BY criterion)
SELECT criterion, metric, {r('value')} AS value, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper,
       CASE WHEN value IS NULL THEN NULL WHEN lower IS NULL THEN value < upper WHEN upper IS NULL THEN value >= lower
            ELSE value BETWEEN lower AND upper END AS passed FROM g JOIN crit USING (criterion)""")
def _(spark, sf):
    return rounded(va.criteria_check(_measured(spark, sf)))



@query("variant_decomposition", COUNTS.rstrip() + f""",
w AS (SELECT variant, month, sum(numerator_impl) / nullif(sum(denominator), 0) AS a,
      sum(numerator_reversal) / nullif(sum(denominator), 0) AS b FROM vc WHERE variant NOT LIKE 'placebo%' GROUP BY 1, 2)
SELECT variant, {r('CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END')} AS impl_reversal_correlation
FROM w WHERE a IS NOT NULL GROUP BY variant""")
def _(spark, sf):
    """Correlation of the two components under every variant."""
    monthly = _counts(spark, sf).where("variant not like 'placebo%'").groupBy("variant", "month").agg(
        F.try_divide(F.sum("numerator_impl"), F.sum("denominator")).alias("a"),
        F.try_divide(F.sum("numerator_reversal"), F.sum("denominator")).alias("b"),
    ).where("a is not null")
    return rounded(monthly.groupBy("variant").agg(
        pearson(F.col("a"), F.col("b")).alias("impl_reversal_correlation")
    ))


@query("variant_event_accuracy", INDEXED + f""",
e(month, event, expected) AS (VALUES {', '.join(f"('{m}', '{n}', '{x}')" for m, n, x in fixed.REGISTERED_EVENTS)}),
l AS (SELECT month, value, lag(value) OVER (ORDER BY month) AS pv FROM vi WHERE variant = 'baseline'),
s AS (SELECT l.month IS NOT NULL AS has, pv IS NOT NULL AND CASE
        WHEN expected IN ('spike', 'spike_then_drop') THEN CASE WHEN pv <> 0 THEN (value - pv) / pv * 100 ELSE 0 END >= 5
        WHEN expected = 'increase' THEN value > pv WHEN expected = 'decrease' THEN value < pv ELSE false END AS ok
      FROM e LEFT JOIN l ON e.month = l.month)
SELECT count(*) FILTER (WHERE has) AS events_checked, count(*) FILTER (WHERE has AND ok) AS events_passed,
       {r('count(*) FILTER (WHERE has AND ok) / nullif(count(*) FILTER (WHERE has), 0)')} AS accuracy FROM s""")
def _(spark, sf):
    """Event rule of the previous month on the baseline series of the variants run."""
    series = _series(spark, sf).where("variant = 'baseline'").select("month", "value")
    return rounded(ev.event_accuracy(ev.check_previous(series)))
