"""Queries from monthly counts to indices, outlet panels, events and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.operators import events as ev
from newsgauge.operators import index as ix
from newsgauge.operators import outlets as ou
from newsgauge.operators import panel as pn
from newsgauge.operators import tagging as tg
from newsgauge.sources import exports as ex
from newsgauge.sources import files
from suite import inputs as i
from suite.registry import query, r, rounded
from suite.text import _classified

W, MC, IDX = i.with_, i.COUNTS, i.INDEX_TABLE
NAMES = ["cpu", "impl", "reversal"]


# --- ratios and normalisation ---------------------------------------------------------------------


RAW = """raw AS (
  SELECT month, denominator, numerator_cpu, numerator_impl, numerator_reversal,
         numerator_cpu / denominator AS ratio_cpu, numerator_impl / denominator AS ratio_impl,
         numerator_reversal / denominator AS ratio_reversal,
         CASE WHEN numerator_impl + numerator_reversal = 0 THEN 0.0 ELSE
           (numerator_impl - numerator_reversal) / (numerator_impl + numerator_reversal) END AS direction
  FROM mc WHERE denominator > 0)"""


@query("raw_index_values", W(MC, RAW) + f"""
SELECT month, denominator, numerator_cpu, numerator_impl, numerator_reversal,
       CAST(0 AS BIGINT) AS numerator_ira, CAST(0 AS BIGINT) AS numerator_obbba,
       {', '.join(f"{r(f'ratio_{n}')} AS raw_ratio_{n}" for n in NAMES)},
       0.0::DOUBLE AS raw_ratio_ira, 0.0::DOUBLE AS raw_ratio_obbba, {r('direction')} AS cpu_direction FROM raw""")
def _(spark, sf):
    return rounded(ix.raw_index_values(ix.counts_to_raw(i.counts(spark, sf))))


@query("raw_index_legacy", W(MC, RAW) + f"""
SELECT month, denominator, numerator_cpu AS numerator, {r('ratio_cpu')} AS raw_ratio,
       numerator_reversal AS numerator_down, {r('ratio_reversal')} AS raw_ratio_down,
       numerator_impl AS numerator_up, {r('ratio_impl')} AS raw_ratio_up FROM raw""")
def _(spark, sf):
    return rounded(ix.raw_index_legacy(ix.raw_index_values(ix.counts_to_raw(i.counts(spark, sf)))))


def _norm_sql(base: str | None) -> str:
    mean = "avg(ratio_{n}) OVER ()" if base is None else (
        "coalesce(CASE WHEN max(CASE WHEN " + base + " THEN ratio_{n} END) OVER () <> 0 "
        "THEN avg(CASE WHEN " + base + " THEN ratio_{n} END) OVER () END, avg(ratio_{n}) OVER ())"
    )
    return ", ".join(
        r(f"CASE WHEN {mean.format(n=n)} > 0 THEN ratio_{n} / {mean.format(n=n)} * 100 ELSE 0 END")
        + f" AS normalized_{n}" for n in NAMES
    )


PICK = ["month", *[f"normalized_{n}" for n in NAMES]]


@query("normalized_index", W(MC, RAW) + f"SELECT month, {_norm_sql(None)} FROM raw")
def _(spark, sf):
    return rounded(i.normalized(spark, sf).select(*PICK))


@query("normalized_index_base",
       W(MC, RAW) + f"""SELECT month, {_norm_sql("month BETWEEN '1996-01' AND '1997-12'")} FROM raw""")
def _(spark, sf):
    raw = ix.raw_index_values(ix.counts_to_raw(i.counts(spark, sf)))
    return rounded(ix.normalize_index(raw, "1996-01", "1997-12").select(*PICK))


@query("normalized_index_empty_base",
       W(MC, RAW) + f"""SELECT month, {_norm_sql("month BETWEEN '2050-01' AND '2050-12'")} FROM raw""")
def _(spark, sf):
    raw = ix.raw_index_values(ix.counts_to_raw(i.counts(spark, sf)))
    return rounded(ix.normalize_index(raw, "2050-01", "2050-12").select(*PICK))


INDEX_ROWS = f"""
SELECT month, index_type, outlet, denominator, CAST(numerator AS BIGINT) AS numerator,
       {r('raw_ratio')} AS raw_ratio, {r('normalized')} AS normalized, scaled, dedup_strategy FROM idx"""


@query("build_index", W(MC, IDX) + INDEX_ROWS)
def _(spark, sf):
    return rounded(ix.build_index(ix.counts_to_raw(i.counts(spark, sf))))


@query("index_values_build", W(MC, IDX) + INDEX_ROWS + " WHERE index_type = 'CPU_impl'")
def _(spark, sf):
    from newsgauge.schemas import INDEX_KEY
    from newsgauge.sources.tables import upsert

    table = i.index_table(spark, sf)
    stale = table.withColumn("normalized", F.lit(0.0))
    merged = ix.fill_ratio(upsert(stale, table.withColumn("raw_ratio", F.lit(None).cast("double")), INDEX_KEY))
    return rounded(merged.where("index_type = 'CPU_impl'"))


@query("index_values_scan", W(MC, IDX) + INDEX_ROWS + " WHERE index_type = 'CPU' ORDER BY month")
def _(spark, sf):
    return rounded(ix.index_scan(i.index_table(spark, sf), "CPU"))


@query("index_types", W(MC, IDX) + "SELECT DISTINCT index_type FROM idx")
def _(spark, sf):
    return ix.index_types(i.index_table(spark, sf))


SERIES_LONG = """long AS (
  SELECT 'cpu' AS name, ratio_cpu AS raw, 100 * ratio_cpu / avg(ratio_cpu) OVER () AS norm FROM raw
  UNION ALL SELECT 'impl', ratio_impl, 100 * ratio_impl / avg(ratio_impl) OVER () FROM raw
  UNION ALL SELECT 'reversal', ratio_reversal, 100 * ratio_reversal / avg(ratio_reversal) OVER () FROM raw
  UNION ALL SELECT 'ira', 0, 0 FROM raw UNION ALL SELECT 'obbba', 0, 0 FROM raw
  UNION ALL SELECT 'direction', direction, NULL FROM raw)"""


@query("index_stats", W(MC, RAW, SERIES_LONG) + f"""
SELECT name, {r('avg(raw)')} AS mean_raw, {r('coalesce(stddev_samp(raw), 0)')} AS std_raw,
       {r('min(raw)')} AS min_raw, {r('max(raw)')} AS max_raw, {r('avg(norm)')} AS mean_norm,
       {r('stddev_samp(norm)')} AS std_norm FROM long GROUP BY name""")
def _(spark, sf):
    return rounded(ix.index_stats(i.normalized(spark, sf)))


@query("index_summary", W(MC, IDX) + """
SELECT index_type, min(month) AS first_month, max(month) AS last_month, count(*) AS num_months,
       round(avg(normalized) FILTER (WHERE normalized <> 0), 1) AS mean,
       round(coalesce(stddev_samp(normalized) FILTER (WHERE normalized <> 0), 0), 1) AS std,
       round(min(normalized) FILTER (WHERE normalized <> 0), 1) AS min,
       round(max(normalized) FILTER (WHERE normalized <> 0), 1) AS max
FROM idx GROUP BY index_type HAVING count(*) FILTER (WHERE normalized <> 0) > 0""")
def _(spark, sf):
    return ix.index_summary(i.index_table(spark, sf))


@query("index_peaks", W(MC, IDX) + """
SELECT index_type, month, round(normalized, 1) AS value, 'peak' AS side,
       CAST(row_number() OVER (PARTITION BY index_type ORDER BY round(normalized, 9) DESC, month) AS INTEGER) AS rank
FROM idx QUALIFY rank <= 3
UNION ALL
SELECT index_type, month, round(normalized, 1), 'trough',
       CAST(row_number() OVER (PARTITION BY index_type ORDER BY round(normalized, 9), month) AS INTEGER) AS rank
FROM idx QUALIFY rank <= 3""")
def _(spark, sf):
    table = i.index_table(spark, sf).withColumn("normalized", F.round("normalized", 9))
    return ix.index_peaks(table)


@query("series_statistics", W(MC, IDX) + f"""
SELECT index_type, {r('avg(normalized)')} AS mean, {r('stddev_samp(normalized)')} AS std,
       {r('min(normalized)')} AS min, {r('max(normalized)')} AS max,
       arg_min(month, round(normalized, 9) * 1e6 + CAST(replace(month, '-', '') AS INTEGER) / 1e9) AS min_month,
       arg_min(month, -round(normalized, 9) * 1e6 + CAST(replace(month, '-', '') AS INTEGER) / 1e9) AS max_month,
       count(*) AS n_months FROM idx WHERE index_type IN ('CPU', 'CPU_impl', 'CPU_reversal') GROUP BY index_type""")
def _(spark, sf):
    table = i.index_table(spark, sf).where("index_type in ('CPU', 'CPU_impl', 'CPU_reversal')")
    return rounded(ix.series_statistics(table, "normalized", ["index_type"]))


@query("full_index", W(MC, IDX, i.FULL_INDEX) + f"""
SELECT month, {r('cpu')} AS cpu, {r('cpu_impl')} AS cpu_impl, {r('cpu_reversal')} AS cpu_reversal,
       CAST(salience_ira AS BIGINT) AS salience_ira, CAST(salience_obbba AS BIGINT) AS salience_obbba,
       denominator FROM full_idx""")
def _(spark, sf):
    return rounded(ix.full_index(i.index_table(spark, sf)))


@query("index_type_corr", W(MC, IDX, i.FULL_INDEX) + f"""
SELECT count(*) AS num_months, {r('corr(cpu, cpu_impl)')} AS corr_cpu_impl,
       {r('corr(cpu, cpu_reversal)')} AS corr_cpu_reversal,
       {r('corr(cpu_impl, cpu_reversal)')} AS corr_impl_reversal, {r('avg(cpu)')} AS cpu_mean,
       {r('avg(cpu_impl)')} AS impl_mean, {r('avg(cpu_reversal)')} AS reversal_mean FROM full_idx""")
def _(spark, sf):
    return rounded(ix.index_type_correlations(i.index_table(spark, sf)))


@query("counts_index", W(MC) + f"""
SELECT *, {', '.join(f"{r(f'numerator_{n} / denominator')} AS ratio_{n}" for n in NAMES)},
       {', '.join(f"{r(f'(numerator_{n} / denominator) / avg(numerator_{n} / denominator) OVER () * 100')} AS {t}"
                  for n, t in zip(NAMES, ['cpu_index', 'cpu_impl', 'cpu_reversal']))} FROM mc""")
def _(spark, sf):
    return rounded(ix.counts_index(i.counts(spark, sf)))


SHARES = W(MC, IDX, i.FULL_INDEX)


@query("composition_share", SHARES + f"""
SELECT month, {r('cpu_impl / CASE WHEN cpu_impl + cpu_reversal = 0 THEN 1 ELSE cpu_impl + cpu_reversal END * 100')}
         AS impl_pct,
       {r('cpu_reversal / CASE WHEN cpu_impl + cpu_reversal = 0 THEN 1 ELSE cpu_impl + cpu_reversal END * 100')}
         AS reversal_pct FROM full_idx""")
def _(spark, sf):
    return rounded(ix.composition_share(ix.full_index(i.index_table(spark, sf))))


@query("direction_balance", SHARES + f"""
SELECT month, {r('CASE WHEN cpu_impl + cpu_reversal > 0 THEN (cpu_impl - cpu_reversal) / (cpu_impl + cpu_reversal) ELSE 0 END')}
         AS balance FROM full_idx""")
def _(spark, sf):
    return rounded(ix.direction_balance(ix.full_index(i.index_table(spark, sf))))


@query("volume_outliers", W(MC) + f"""
SELECT month, denominator AS volume, {r('avg(denominator) OVER ()')} AS mean_volume,
       {r('avg(denominator) OVER () + 2 * stddev_pop(denominator) OVER ()')} AS threshold,
       denominator > avg(denominator) OVER () + 2 * stddev_pop(denominator) OVER () AS is_outlier FROM mc""")
def _(spark, sf):
    return rounded(ix.volume_outliers(i.counts(spark, sf)))


@query("memo_stats", SHARES + f"""
SELECT max(month) AS current_month, {r('arg_max(cpu, month)')} AS current_value, {r('min(cpu)')} AS min_value,
       {r('max(cpu)')} AS max_value, count(*) AS n_months FROM full_idx""")
def _(spark, sf):
    return rounded(ix.memo_stats(ix.full_index(i.index_table(spark, sf))))


# --- outlets ----------------------------------------------------------------------------------------


OUT = W(i.OUTLETS)
RATIO = "CASE WHEN denominator > 0 THEN numerator / denominator ELSE 0 END"


@query("outlets_whitelist", OUT + "SELECT * FROM panel WHERE lower(outlet) IN ('nation_1', 'nation_3', 'nation_7')")
def _(spark, sf):
    return ou.keep_outlets(i.outlet_panel(spark, sf), ["Nation_1", "nation_3", "NATION_7"])


OUTLET_ROWS = """o AS (SELECT coalesce(source, 'Unknown') AS outlet, month, count(*) AS denominator,
                 count(*) FILTER (WHERE uncertainty) AS numerator FROM hits GROUP BY 1, 2),
b AS (SELECT *, numerator / denominator AS raw, avg(numerator / denominator) FILTER (WHERE month >= '2021-06')
      OVER (PARTITION BY outlet) AS base FROM o WHERE outlet IN ('src1', 'src3', 'src7'))"""


@query("outlet_index_rows", W(i.ARTICLES, i.TEXT, i.HITS, OUTLET_ROWS) + f"""
SELECT month, 'CPU' AS index_type, outlet, denominator, numerator, {r('raw')} AS raw_ratio,
       {r('CASE WHEN base IS NULL THEN raw WHEN base <> 0 THEN raw / base * 100 ELSE 0 END')} AS normalized,
       false AS scaled, 'none' AS dedup_strategy FROM b""")
def _(spark, sf):
    """Listed outlets with a base open at its end, over stale rows in the index table, read back by outlet."""
    from newsgauge.schemas import INDEX_KEY
    from newsgauge.session import scratch_path
    from newsgauge.sources.tables import read_latest, write_batch

    path = scratch_path(spark, "index-table")
    rows = i.articles(spark, sf).withColumnRenamed("source", "outlet")
    counts = tg.class_counts(rows, _classified(spark, sf, ["id"]), ["outlet", "month"], by_outlet=True)
    listed = ["src1", "src3", "src7"]
    write_batch(i.index_table(spark, sf).withColumn("normalized", F.lit(0.0)), path, 0)
    write_batch(ix.outlet_index_values(counts, outlets=listed), path, 1)
    write_batch(ix.outlet_index_values(counts, "2021-06", None, listed), path, 2)
    table = read_latest(spark, path, INDEX_KEY)
    found = [ix.index_scan(table, "CPU", outlet) for outlet in listed]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]))


@query("outlets_excluded", OUT + "SELECT * FROM panel WHERE lower(outlet) NOT IN ('nation_1', 'nation_3')")
def _(spark, sf):
    return ou.drop_outlets(i.outlet_panel(spark, sf), ["Nation_1", "nation_3"])


@query("outlet_ratio", OUT + f"SELECT outlet, month, numerator, denominator, {r(RATIO)} AS value FROM panel")
def _(spark, sf):
    return rounded(ou.outlet_ratio(i.outlet_panel(spark, sf)))


Z = f"""z AS (
  SELECT outlet, month, CASE WHEN stddev_pop(v) OVER w > 1e-10 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w
         ELSE 0 END AS value, CASE WHEN stddev_pop(v) OVER w > 1e-10 THEN v / stddev_pop(v) OVER w
         ELSE 0 END AS uncentred, v, numerator
  FROM (SELECT *, {RATIO} AS v FROM panel) WINDOW w AS (PARTITION BY outlet))"""


@query("outlet_zscore", W(i.OUTLETS, Z) + f"SELECT outlet, month, {r('value')} AS value FROM z")
def _(spark, sf):
    ratio = ou.outlet_ratio(i.outlet_panel(spark, sf))
    return rounded(ou.standardize(ratio).select("outlet", "month", "value"))


BASE = "month BETWEEN '1996-01' AND '1996-12'"


def _base(value: str, by: str = "") -> str:
    mean = f"avg(CASE WHEN {BASE} THEN {value} END) OVER ({by})"
    return r(f"CASE WHEN {mean} IS NULL THEN {value} WHEN {mean} <> 0 THEN {value} / {mean} * 100 ELSE 0 END")


@query("base_normalize", W(i.OUTLETS) + f"""
SELECT outlet, month, {_base('v', 'PARTITION BY outlet')} AS value FROM (
  SELECT outlet, month, CAST(numerator AS DOUBLE) AS v FROM panel)""")
def _(spark, sf):
    series = i.outlet_panel(spark, sf).select("outlet", "month", F.col("numerator").cast("double").alias("value"))
    return rounded(ou.base_normalize(series, "1996-01", "1996-12", ["outlet"]))


def _pooled(value: str, where: str = "true") -> str:
    return W(i.OUTLETS, Z) + f"""
SELECT month, {_base('value')} AS value FROM (SELECT month, avg({value}) AS value FROM z WHERE {where} GROUP BY month)"""


@query("bbd_index", _pooled("value"))
def _(spark, sf):
    return rounded(ou.pooled_index(i.outlet_panel(spark, sf), "1996-01", "1996-12"))


@query("bbd_uncentred", _pooled("uncentred"))
def _(spark, sf):
    return rounded(ou.pooled_index(i.outlet_panel(spark, sf), "1996-01", "1996-12", center=False))


@query("bbd_skip_standardize", _pooled("v"))
def _(spark, sf):
    return rounded(ou.pooled_index(i.outlet_panel(spark, sf), "1996-01", "1996-12", skip_standardization=True))


@query("bbd_skip_volume", W(i.OUTLETS) + f""",
z AS (SELECT outlet, month, CASE WHEN stddev_pop(numerator) OVER w > 1e-10
      THEN (numerator - avg(numerator) OVER w) / stddev_pop(numerator) OVER w ELSE 0 END AS value
      FROM panel WINDOW w AS (PARTITION BY outlet))
SELECT month, {_base('value')} AS value FROM (SELECT month, avg(value) AS value FROM z GROUP BY month)""")
def _(spark, sf):
    return rounded(ou.pooled_index(i.outlet_panel(spark, sf), "1996-01", "1996-12", skip_volume_scaling=True))


@query("bbd_exclude_outlet", _pooled("value", "lower(outlet) <> 'nation_3'"))
def _(spark, sf):
    return rounded(ou.pooled_index(i.outlet_panel(spark, sf), "1996-01", "1996-12", ["Nation_3"]))


@query("outlet_index", OUT + f"""
SELECT outlet, month, {_base('v', 'PARTITION BY outlet')} AS value FROM (
  SELECT outlet, month, {RATIO} AS v FROM panel)""")
def _(spark, sf):
    series = ou.outlet_index(i.outlet_panel(spark, sf), "1996-01", "1996-12")
    return rounded(series.select("outlet", "month", "value"))


@query("build_outlet_index", W(i.ARTICLES, i.TEXT, i.HITS) + f"""
SELECT outlet, month, {r('CASE WHEN m IS NULL THEN v WHEN m <> 0 THEN v / m * 100 ELSE 0 END')} AS value FROM (
  SELECT *, avg(CASE WHEN month BETWEEN '2021-01' AND '2024-10' THEN v END) OVER (PARTITION BY outlet) AS m FROM (
    SELECT source AS outlet, month, count(*) FILTER (WHERE uncertainty) / count(*) AS v FROM hits GROUP BY 1, 2))""")
def _(spark, sf):
    from newsgauge.plans.reports import outlet_indices

    series = outlet_indices(i.articles(spark, sf), i.LEXICON)
    return rounded(series.select("outlet", "month", "value"))


def _ratios(spark, sf):
    return ou.outlet_ratio(i.outlet_panel(spark, sf))


CORR = f"""v AS (SELECT outlet, month, {RATIO} AS v FROM panel),
pairs AS (SELECT a.outlet AS outlet1, b.outlet AS outlet2, count(*) AS n_months,
          CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN corr(a.v, b.v) END AS c
          FROM v a JOIN v b USING (month) GROUP BY 1, 2)"""


@query("outlet_corr_pairs", W(i.OUTLETS, CORR) + f"""
SELECT outlet1, outlet2, n_months, {r('c')} AS correlation FROM pairs WHERE outlet1 < outlet2 AND n_months >= 2""")
def _(spark, sf):
    return rounded(ou.outlet_correlations(_ratios(spark, sf)))


@query("outlet_corr_matrix", W(i.OUTLETS, CORR) + f"""
SELECT outlet1, outlet2, n_months, {r('CASE WHEN n_months >= 2 THEN c END')} AS correlation FROM pairs""")
def _(spark, sf):
    return rounded(ou.outlet_correlations(_ratios(spark, sf), full_matrix=True))


# --- exports ----------------------------------------------------------------------------------------


@query("export_index_rows", W(MC, IDX) + INDEX_ROWS + " WHERE index_type IN ('CPU', 'CPU_reversal')")
def _(spark, sf):
    return rounded(ex.export_index_rows(i.index_table(spark, sf), ["CPU", "CPU_reversal"]))


def _fmt(expression: str) -> str:
    return (f"CASE WHEN {expression} IS NULL THEN '' WHEN {expression} = floor({expression}) "
            f"THEN CAST(CAST({expression} AS BIGINT) AS VARCHAR) "
            f"ELSE regexp_replace(CAST(CAST(round({expression}, 2) AS DECIMAL(38,2)) AS VARCHAR), '0+$', '') END")


@query("format_value", """
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O'
           THEN floor(o_totalprice) ELSE o_totalprice END AS x FROM orders)
SELECT o_orderkey, """ + _fmt("x") + " AS text FROM v")
def _(spark, sf):
    from newsgauge.functions.stats import format_value

    x = F.when(F.col("o_orderstatus") == "O", F.floor("o_totalprice").cast("double")).when(
        F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return i.table(spark, sf, "orders").select("o_orderkey", x.alias("x")).select(
        "o_orderkey", format_value(F.col("x")).alias("text")
    )


def _full(spark, sf):
    return ix.full_index(i.index_table(spark, sf))


@query("export_monthly", SHARES + f"SELECT month AS date, {_fmt('cpu')} AS cpu, CAST(denominator AS VARCHAR) AS denominator FROM full_idx")
def _(spark, sf):
    return ex.monthly_export(_full(spark, sf))


@query("export_decomposition", SHARES + f"""
SELECT month AS date, {_fmt('cpu')} AS cpu, {_fmt('cpu_impl')} AS cpu_impl, {_fmt('cpu_reversal')} AS cpu_reversal,
       CAST(denominator AS VARCHAR) AS denominator FROM full_idx""")
def _(spark, sf):
    return ex.decomposition_export(_full(spark, sf))


@query("export_salience", SHARES + """
SELECT month AS date, CAST(salience_ira AS VARCHAR) AS salience_ira, CAST(salience_obbba AS VARCHAR) AS salience_obbba,
       CAST(denominator AS VARCHAR) AS denominator FROM full_idx""")
def _(spark, sf):
    return ex.salience_export(_full(spark, sf))


def _source_ratios(spark, sf):
    tagged = _classified(spark, sf, ["source", "month"]).withColumnRenamed("source", "outlet")
    counts = tg.count_tagged(tagged, ["outlet", "month"], by_outlet=True)
    return ou.outlet_ratio(counts.select(
        "outlet", "month", F.col("uncertainty_count").alias("numerator"),
        F.col("total_articles").alias("denominator"),
    ))


@query("export_outlet_wide", W(i.ARTICLES, i.TEXT, i.HITS) + f"""
, v AS (SELECT source AS outlet, month, count(*) FILTER (WHERE uncertainty) / count(*) AS v FROM hits GROUP BY 1, 2)
, cells AS (
  SELECT m.month AS date, o.outlet, coalesce({_fmt('v')}, '') AS cell
  FROM (SELECT DISTINCT month FROM v) m CROSS JOIN (SELECT DISTINCT outlet FROM v) o
    LEFT JOIN v ON v.month = m.month AND v.outlet = o.outlet)
PIVOT cells ON outlet USING max(cell) GROUP BY date""")
def _(spark, sf):
    return ex.outlet_export(_source_ratios(spark, sf))


@query("index_scan", W(MC, i.INDEX_SERIES) + f"""
SELECT month, {r('cpu_index')} AS cpu_index, {r('cpu_impl')} AS cpu_impl, {r('cpu_reversal')} AS cpu_reversal FROM ser""")
def _(spark, sf):
    from newsgauge.session import scratch_path

    path = scratch_path(spark, "index-csv")
    ex.write_csv(i.index_series(spark, sf), path)
    return rounded(files.read_index(spark, path))


@query("panel_scan", W(MC, i.INDEX_SERIES) + f"SELECT month, {r('cpu_index')} AS cpu_index FROM ser")
def _(spark, sf):
    from newsgauge.session import scratch_path

    path = scratch_path(spark, "panel-csv")
    ex.write_csv(i.index_series(spark, sf).select(F.col("month").alias("Unnamed: 0"), "cpu_index"), path)
    return rounded(files.read_panel(spark, path))


# --- events -----------------------------------------------------------------------------------------


ART_IDX = W(i.ARTICLES, i.TEXT, i.HITS, i.CLASS_COUNTS, i.ARTICLE_INDEX)


def _values(events):
    return ", ".join(f"('{m}', '{n}', '{x}')" for m, n, x in events)


# Prior values reach back one month or more, so every early month of the documents is an event.
EVENTS = [
    ("2021-01", "first month", "decrease"), ("2021-02", "second month", "stable"),
    ("2021-03", "spring", "spike"), ("2021-05", "early summer", "spike_then_drop"),
    ("2021-06", "midyear", "increase"), ("2021-07", "summer", "drop"),
    ("2021-08", "late summer", "decrease"), ("2021-10", "autumn", "increase"),
    ("2040-01", "beyond the data", "spike"),
]


def _calendar_events():
    return [(m, n, "drop" if x in ("drop", "decrease", "stable") else "spike") for m, n, x in EVENTS]


@query("event_check_calendar", ART_IDX + f""",
e(month, event, expected) AS (VALUES {_values(_calendar_events())}),
c AS (SELECT e.*, a.value, coalesce(p.value, a.value) AS prior, a.month IS NOT NULL AS has
      FROM e LEFT JOIN art_idx a ON e.month = a.month
      LEFT JOIN art_idx p ON p.month = strftime(CAST(e.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')),
d AS (SELECT *, CASE WHEN prior > 0 THEN (value - prior) / prior * 100 ELSE 0 END AS ch FROM c)
SELECT month, event, expected, round(value, 1) AS actual, CASE WHEN has THEN round(prior, 1) END AS prior,
       CASE WHEN has THEN round(ch, 1) + 0.0 END AS change_percent,
       CASE WHEN NOT has THEN 'NO DATA' WHEN CASE expected WHEN 'spike' THEN ch > 10 ELSE ch < -10 END
            THEN 'PASS' ELSE 'FAIL' END AS result FROM d""")
def _(spark, sf):
    return rounded(ev.check_calendar(i.article_index(spark, sf), _calendar_events()), 1)


PREV = ART_IDX + f""",
e(month, event, expected) AS (VALUES {_values(EVENTS)}),
l AS (SELECT month, value, lag(value) OVER (ORDER BY month) AS pv FROM art_idx),
c AS (SELECT e.*, value, pv, l.month IS NOT NULL AS has, value - pv AS ch,
      CASE WHEN pv <> 0 THEN (value - pv) / pv * 100 ELSE 0 END AS pct FROM e LEFT JOIN l ON e.month = l.month),
s AS (SELECT *, CASE WHEN NOT has THEN 'no_data' WHEN pv IS NULL THEN 'failed'
      WHEN CASE WHEN expected IN ('spike', 'spike_then_drop') THEN pct >= 5 WHEN expected = 'increase' THEN ch > 0
                WHEN expected = 'decrease' THEN ch < 0 WHEN expected = 'stable' THEN abs(pct) < 10 ELSE false END
      THEN 'passed' ELSE 'failed' END AS status FROM c)
"""


@query("event_check_prev", PREV + f"""
SELECT month, event, expected, CASE WHEN has THEN CASE WHEN pv IS NULL THEN 'unknown' WHEN ch > 0 THEN 'increase'
       WHEN ch < 0 THEN 'decrease' ELSE 'stable' END END AS actual, {r('value')} AS value, {r('pv')} AS prev_value,
       status FROM s""")
def _(spark, sf):
    return rounded(ev.check_previous(i.article_index(spark, sf), EVENTS))


@query("event_accuracy", PREV + f"""
SELECT count(*) FILTER (WHERE status <> 'no_data') AS events_checked,
       count(*) FILTER (WHERE status = 'passed') AS events_passed,
       {r("count(*) FILTER (WHERE status = 'passed') / nullif(count(*) FILTER (WHERE status <> 'no_data'), 0)")}
         AS accuracy FROM s""")
def _(spark, sf):
    return rounded(ev.event_accuracy(ev.check_previous(i.article_index(spark, sf), EVENTS)))


@query("event_check_window3", ART_IDX + f""",
e(month, event, expected) AS (VALUES {_values(fixed.REPORT_EVENTS)}),
l AS (SELECT month, value, coalesce(avg(value) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), value)
      AS prior FROM art_idx),
c AS (SELECT e.*, value, l.month IS NOT NULL AS has,
      CASE WHEN prior > 0 THEN (value - prior) / prior * 100 ELSE 0 END AS ch FROM e LEFT JOIN l ON e.month = l.month)
SELECT month, event, expected, round(value, 1) AS value, CASE WHEN has THEN round(ch, 1) + 0.0 END AS change_pct,
  CASE WHEN NOT has THEN 'No data' WHEN ch > 8 OR (value > 105 AND ch > 3) THEN CASE WHEN ch > 15 THEN 'spiked'
       ELSE 'increased' END WHEN ch < -8 OR (value < 95 AND ch < -3) THEN 'decreased' ELSE 'stable' END AS actual,
  CASE WHEN NOT has THEN 'unknown' WHEN CASE expected WHEN 'spike' THEN ch > 5 OR value > 105
       WHEN 'increase' THEN ch > 2 OR value > 100 WHEN 'decrease' THEN ch < -2 OR value < 98 ELSE false END
       THEN 'passed' ELSE 'failed' END AS status FROM c""")
def _(spark, sf):
    return rounded(ev.check_window(i.article_index(spark, sf)), 1)


REGIMES = [("1995-03-20", "1997-01-20", "first"), ("1997-01-20", "2000-06-01", "second"), ("2000-06-01", None, "third")]
TRANSITIONS = [("1990-01-20", "before_data"), ("1997-01-20", "to_second"), ("2000-06-01", "to_third")]


@query("regime_tag", W(MC, i.INDEX_SERIES) + f"""
SELECT month, {r('cpu_index')} AS cpu_index,
  CASE WHEN month >= DATE '1995-03-20' AND month < DATE '1997-01-20' THEN 'first'
       WHEN month >= DATE '1997-01-20' AND month < DATE '2000-06-01' THEN 'second'
       WHEN month >= DATE '2000-06-01' THEN 'third' END AS regime,
  CASE WHEN month >= DATE '1997-01-20' AND month < DATE '1997-07-20' THEN 'to_second'
       WHEN month >= DATE '2000-06-01' AND month < DATE '2000-12-01' THEN 'to_third' END AS transition FROM ser""")
def _(spark, sf):
    series = i.index_series(spark, sf).select("month", "cpu_index")
    return rounded(pn.regime_tag(series, REGIMES, TRANSITIONS))
