"""Queries over deals and judged companies: loading, monthly panels, rolling statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge.functions.calendar import fill_months
from newsgauge.operators import deals as dl
from newsgauge.operators import panel as pn
from newsgauge.sources import files
from suite import inputs as i
from suite.registry import query, r, rounded

W = i.with_
DEALS, MONTHLY, PANEL = "WITH " + i.DEALS, "WITH " + i.MONTHLY, "WITH " + i.PANEL

COLUMNS = "deal_id, company_id, deal_date, deal_size, deal_type, deal_status, year, month_number, month, stage"


# --- loading and filtering ----------------------------------------------------------------------------


def _export(spark, sf):
    """Write a deals export with preamble lines, quoted line breaks and amounts, some unreadable dates."""
    from newsgauge.session import scratch_path

    path = scratch_path(spark, "deals-csv")
    names = ["Deal ID", "Company ID", "Deal Date", "Deal Size", "Deal Type", "Unknown Column",
             "Deal Status", "Primary Industry Sector"]
    head = ["Export", "Search,deals", "", "Created,today", "Rows,all", "", ",".join(names)]
    amount = F.when(F.col("deal_type") == "Seed Round", "N/A").otherwise(
        F.format_number(F.floor("deal_size"), 0)
    )
    date = F.when(F.col("sector") == "MACHINERY", "soon").otherwise(F.col("deal_date").cast("string"))
    quoted = [F.concat(F.lit('"'), F.coalesce(c.cast("string"), F.lit("")), F.lit('"')) for c in (
        F.col("deal_id"), F.col("company_id"), date, amount, F.col("deal_type"),
        F.lit('a ""quoted"" word, comma\nand a line break'), F.col("deal_status"), F.col("sector"),
    )]
    lines = i.raw_deals(spark, sf).select(F.concat_ws(",", *quoted).alias("value"))
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.text(path)
    lines.write.mode("append").text(path)
    return path


@query("deals_load", DEALS + """
SELECT CAST(deal_id AS VARCHAR) AS deal_id, CAST(company_id AS VARCHAR) AS company_id, deal_date,
       CASE WHEN deal_type <> 'Seed Round' THEN floor(deal_size) END AS deal_size, deal_type, sector,
       year, month_number, month, stage FROM deals WHERE sector <> 'MACHINERY'""")
def _(spark, sf):
    return files.read_deals(spark, _export(spark, sf), "1995-02-10").drop("deal_status")


SIZED = "{}(CASE WHEN deal_type <> 'Seed Round' THEN floor(deal_size) END)"


@query("monthly_metrics", DEALS + f"""
SELECT month, count(*) AS deal_count, {r('coalesce(' + SIZED.format('sum') + ', 0)', 2)} AS total_amount,
       {r(SIZED.format('median'), 4)} AS median_amount,
       count(*) FILTER (WHERE deal_type <> 'Seed Round') AS deals_with_size FROM deals WHERE sector <> 'MACHINERY' GROUP BY month""")
def _(spark, sf):
    from newsgauge.plans.reports import monthly_metrics

    metrics = monthly_metrics(spark, _export(spark, sf), "1995-02-10").where("deal_count > 0")
    return rounded(metrics.select("month", "deal_count", "total_amount", "median_amount", "deals_with_size"), 4)


@query("judged_load", W(i.COMPANIES) + f"""
SELECT CAST(company_id AS VARCHAR) AS company_id, last_financing_date, month, judge_category, gemini_category,
       CASE WHEN semantic_subtopic <> '5-LOW' THEN {r('total_raised', 2)} END AS total_raised,
       CASE WHEN semantic_subtopic <> '1-URGENT' THEN ira_index END AS ira_index,
       'topic ' || semantic_subtopic AS further_notes FROM companies""")
def _(spark, sf):
    from newsgauge.session import scratch_path

    path = scratch_path(spark, "judged-csv")
    topic = F.col("semantic_subtopic")
    i.companies(spark, sf).select(
        F.col("company_id").alias("Company ID"), F.col("last_financing_date").alias("Last Financing Date"),
        F.when(topic == "5-LOW", "undisclosed").otherwise(F.col("total_raised").cast("string")).alias("Total Raised"),
        "judge_category", F.col("gemini_category").alias("Gemini_Category"),
        F.when(topic == "1-URGENT", "n/a").otherwise(F.col("ira_index").cast("string")).alias("IRA_Index"),
        F.concat(F.lit("topic "), topic).alias("Further Notes"),
    ).write.option("header", True).csv(path)
    return rounded(files.read_judged(spark, path), 2)


@query("deals_filtered", DEALS + f"SELECT {COLUMNS} FROM deals")
def _(spark, sf):
    return i.deals(spark, sf)


@query("deal_stage", "WITH " + i.RAW_DEALS + """
SELECT deal_type, CASE WHEN deal_type IN ('Seed Round', 'Angel (individual)') THEN 'Seed'
       WHEN deal_type = 'Early Stage VC' THEN 'Early' WHEN deal_type = 'Later Stage VC' THEN 'Late' END AS stage,
       count(*) AS n FROM raw_deals GROUP BY 1, 2""")
def _(spark, sf):
    raw = i.raw_deals(spark, sf, with_sector=False)
    return raw.groupBy("deal_type", dl.deal_stage(F.col("deal_type")).alias("stage")).agg(F.count("*").alias("n"))


@query("exposure_bands", W(i.COMPANIES) + """
SELECT CASE WHEN ira_index >= 6 THEN 'high' WHEN ira_index <= 3 THEN 'low' END AS band, count(*) AS n
FROM companies GROUP BY 1""")
def _(spark, sf):
    band = dl.exposure_band(F.col("ira_index")).alias("band")
    return i.companies(spark, sf).groupBy(band).agg(F.count("*").alias("n"))


# --- monthly activity -----------------------------------------------------------------------------------


AMOUNTS = ["total_amount", "median_amount", "mean_amount"]
VM = "month, deal_count, " + ", ".join(f"{r(c, 4)} AS {c}" for c in AMOUNTS) + """,
deals_with_size, seed_count, early_count, late_count, CAST(size_coverage_pct AS DOUBLE) AS size_coverage_pct"""


@query("vc_monthly", MONTHLY + f"SELECT {VM} FROM vm")
def _(spark, sf):
    return rounded(dl.monthly_activity(i.deals(spark, sf)), 4)


@query("vc_by_sector", DEALS + f"""
SELECT month, sector, count(deal_id) AS deal_count, {r('sum(deal_size)', 2)} AS total_amount
FROM deals WHERE sector IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(dl.activity_by_sector(i.deals(spark, sf, with_sector=True)), 2)


def _by_category(column: str) -> str:
    return W(i.COMPANIES) + f"""
SELECT month, {column}, count(company_id) AS deal_count, {r('coalesce(sum(total_raised), 0)', 4)} AS total_amount,
       {r('median(total_raised)', 4)} AS median_amount, count(total_raised) AS deals_with_size,
       CAST(0 AS BIGINT) AS seed_count, CAST(0 AS BIGINT) AS early_count, CAST(0 AS BIGINT) AS late_count,
       100.0 * count(total_raised) / count(company_id) AS size_coverage_pct
FROM companies WHERE {column} IS NOT NULL GROUP BY 1, 2"""


@query("vc_by_category", _by_category("gemini_category"))
def _(spark, sf):
    return rounded(dl.activity_by_category(i.companies(spark, sf), "gemini_category"), 4)


@query("vc_by_subtopic", _by_category("semantic_subtopic"))
def _(spark, sf):
    return rounded(dl.activity_by_category(i.companies(spark, sf), "semantic_subtopic"), 4)


@query("monthly_gapfill", DEALS + """,
s AS (SELECT sector, month, count(*) AS deal_count, sum(deal_size) AS total_amount FROM deals
      WHERE stage = 'Late' AND sector IS NOT NULL GROUP BY 1, 2),
k AS (SELECT sector, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
      FROM s GROUP BY sector)
SELECT sector, month, coalesce(deal_count, 0) AS deal_count, round(coalesce(total_amount, 0), 2) AS total_amount
FROM k LEFT JOIN s USING (sector, month)""")
def _(spark, sf):
    late = i.deals(spark, sf, with_sector=True).where("stage = 'Late'")
    return rounded(fill_months(dl.activity_by_sector(late), ["sector"], ["deal_count", "total_amount"]), 2)


@query("deal_summary", DEALS + f"""
SELECT count(*) AS total_deals, min(deal_date) AS first_date, max(deal_date) AS last_date,
       count(deal_size) AS deals_with_size, {r('100.0 * count(deal_size) / count(*)')} AS size_coverage_pct FROM deals""")
def _(spark, sf):
    return rounded(dl.deal_summary(i.deals(spark, sf)))


for _name, _column in (("deals_by_type", "deal_type"), ("deals_by_stage", "stage")):
    query(_name, DEALS + f"SELECT {_column}, count(*) AS n FROM deals GROUP BY 1")(
        lambda spark, sf, column=_column: dl.value_counts(i.deals(spark, sf), column)
    )


@query("deals_by_year", DEALS + "SELECT year, count(*) AS n FROM deals GROUP BY 1")
def _(spark, sf):
    return dl.deals_by_year(i.deals(spark, sf))


@query("top_sectors", DEALS + """
SELECT sector, count(*) AS n FROM deals WHERE sector IS NOT NULL GROUP BY 1 ORDER BY n DESC, sector LIMIT 3""")
def _(spark, sf):
    return dl.top_sectors(i.deals(spark, sf, with_sector=True), 3)


@query("sector_distribution", W(i.COMPANIES) + """
SELECT deepseek_category, count(*) AS n FROM companies WHERE deepseek_category IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return dl.value_counts(i.companies(spark, sf), "deepseek_category")


@query("top_deals_per_sector", DEALS + """
SELECT sector, deal_id, CAST(row_number() OVER (PARTITION BY sector ORDER BY deal_size DESC, deal_id) AS INTEGER) AS rank
FROM deals QUALIFY rank <= 3""")
def _(spark, sf):
    deals = i.deals(spark, sf, with_sector=True)
    return dl.top_per_group(deals, ["sector"], [F.desc("deal_size"), F.col("deal_id")], 3).select(
        "sector", "deal_id", "rank"
    )


# --- panels ------------------------------------------------------------------------------------------------


@query("panel_join", PANEL + f"SELECT {VM}, {r('cpu_index')} AS cpu_index FROM vm JOIN ser USING (month)")
def _(spark, sf):
    monthly = rounded(dl.monthly_activity(i.deals(spark, sf)), 4)
    index = rounded(i.index_series(spark, sf).withColumnRenamed("cpu_index", "normalized_index"))
    return pn.panel_join(monthly, index)


@query("panel_overlap", PANEL + f"""
SELECT month, deal_count, {r('total_amount', 2)} AS total_amount, {r('cpu_index', 2)} AS cpu_index,
       {r('cpu_impl', 2)} AS cpu_impl, {r('cpu_reversal', 2)} AS cpu_reversal FROM merged""")
def _(spark, sf):
    panel = i.panel(spark, sf)
    return rounded(panel.select("month", "deal_count", "total_amount", "cpu_index", "cpu_impl", "cpu_reversal"), 2)


ROLL = "OVER (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


def _roll(column: str, digits: int) -> str:
    return ", ".join(
        r(f"CASE WHEN count({column}) {ROLL} = 12 THEN {f}({column}) {ROLL} END", digits) + f" AS {column}_rolling_{n}"
        for f, n in (("avg", "mean"), ("stddev_samp", "std"))
    )


@query("rolling_stats", PANEL + f"""
SELECT month, deal_count, {r('total_amount', 2)} AS total_amount, {_roll('deal_count', 2)}, {_roll('total_amount', 2)} FROM vm""")
def _(spark, sf):
    monthly = dl.monthly_activity(i.deals(spark, sf), median=False).select("month", "deal_count", "total_amount")
    return rounded(pn.rolling_stats(monthly), 2)


@query("moving_average", PANEL + f"""
SELECT month, {r(f'CASE WHEN count(deal_count) {ROLL} = 12 THEN avg(deal_count) {ROLL} END')} AS moving_average FROM vm""")
def _(spark, sf):
    monthly = dl.monthly_activity(i.deals(spark, sf), median=False).select("month", "deal_count")
    rolled = pn.rolling_stats(monthly, 12, ["deal_count"])
    return rounded(rolled.select("month", F.col("deal_count_rolling_mean").alias("moving_average")))


@query("rolling_corr", PANEL + f""",
w AS (SELECT month, row_number() OVER (ORDER BY month) AS pos, cpu_reversal AS x, deal_count AS y FROM merged),
c AS (SELECT a.month, CASE WHEN count(*) = 24 THEN corr(b.x, b.y) END AS c
      FROM w a JOIN w b ON b.pos BETWEEN a.pos - 23 AND a.pos GROUP BY a.month)
SELECT month, {r('c')} AS correlation,
       {r('tanh(atanh(greatest(-0.999, least(0.999, c))) - 1.96 / sqrt(21))')} AS ci_lower,
       {r('tanh(atanh(greatest(-0.999, least(0.999, c))) + 1.96 / sqrt(21))')} AS ci_upper
FROM (SELECT month, c FROM c WHERE c IS NOT NULL UNION ALL SELECT month, NULL FROM c WHERE c IS NULL) WHERE c IS NOT NULL
UNION ALL SELECT month, NULL, NULL, NULL FROM c WHERE c IS NULL""")
def _(spark, sf):
    return rounded(pn.rolling_correlation(i.panel(spark, sf), "cpu_reversal", "deal_count"))


@query("difference", PANEL + f""",
d1 AS (SELECT month, deal_count - lag(deal_count) OVER (ORDER BY month) AS deal_count,
       cpu_index - lag(cpu_index) OVER (ORDER BY month) AS cpu_index FROM merged
       QUALIFY lag(month) OVER (ORDER BY month) IS NOT NULL),
d2 AS (SELECT month, deal_count - lag(deal_count) OVER (ORDER BY month) AS deal_count,
       cpu_index - lag(cpu_index) OVER (ORDER BY month) AS cpu_index FROM d1
       QUALIFY lag(month) OVER (ORDER BY month) IS NOT NULL)
SELECT month, deal_count, {r('cpu_index')} AS cpu_index FROM d2""")
def _(spark, sf):
    panel = i.panel(spark, sf).select("month", "deal_count", "cpu_index")
    return rounded(pn.difference(panel, ["deal_count", "cpu_index"], 2))


@query("ols_trend", PANEL + f""",
p AS (SELECT row_number() OVER (ORDER BY month) - 1 AS x, * FROM merged)
SELECT 'cpu_index' AS series, count(*) AS n, {r('regr_slope(cpu_index, x)')} AS slope,
       {r('regr_intercept(cpu_index, x)')} AS intercept FROM p
UNION ALL SELECT 'deal_count', count(*), {r('regr_slope(deal_count, x)')}, {r('regr_intercept(deal_count, x)')} FROM p""")
def _(spark, sf):
    return rounded(pn.ols_trend(i.panel(spark, sf), ["cpu_index", "deal_count"]))


SCATTER = [("cpu_reversal", "deal_count"), ("cpu_impl", "deal_count"), ("cpu_index", "deal_count")]


@query("ols_scatter", PANEL + " UNION ALL ".join(f"""
SELECT '{x}' AS x_name, '{y}' AS y_name, count(*) AS n, {r(f'regr_slope({y}, {x})')} AS slope,
       {r(f'regr_intercept({y}, {x})')} AS intercept, {r(f'corr({x}, {y})')} AS r FROM merged""" for x, y in SCATTER))
def _(spark, sf):
    return rounded(pn.ols_scatter(i.panel(spark, sf), SCATTER))


SUMMARY = ["cpu_index", "cpu_impl", "cpu_reversal", "deal_count", "total_amount"]


@query("panel_summary", PANEL + " UNION ALL ".join(f"""
SELECT '{c}' AS metric, {r(f'avg({c})', 2)} AS mean, {r(f'stddev_samp({c})', 2)} AS std,
       {r(f'CAST(min({c}) AS DOUBLE)', 2)} AS min, {r(f'CAST(max({c}) AS DOUBLE)', 2)} AS max FROM merged""" for c in SUMMARY))
def _(spark, sf):
    return rounded(pn.panel_summary(i.panel(spark, sf), SUMMARY), 2)


@query("stage_bands", MONTHLY + """
SELECT month, seed_count AS seed_top, seed_count + early_count AS early_top,
       seed_count + early_count + late_count AS late_top FROM vm""")
def _(spark, sf):
    return pn.stage_bands(dl.monthly_activity(i.deals(spark, sf), median=False))
