"""Queries on the relation of index and activity: lags, sectors, stationarity, causality."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from newsgauge.functions import inference as inf
from newsgauge.operators import causality as ca
from newsgauge.operators import leadlag as ll
from newsgauge.operators import sector as sc
from newsgauge.operators import stationarity as st
from newsgauge.plans.reports import LEADLAG_PAIRS
from suite import inputs as i
from suite.registry import query, r, rounded

PANEL = "WITH " + i.PANEL


def ccf_sql(source: str, keys: str, lags: int = 12) -> str:
    """CTEs ccf(keys, lag, correlation, n_observations) and best(keys, ...) of source(keys, month, s1, s2)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""al AS (
  SELECT {keys}, s1, s2, row_number() OVER (PARTITION BY {keys} ORDER BY month) AS pos,
         count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE s1 IS NOT NULL AND s2 IS NOT NULL),
lag_list AS (SELECT CAST(unnest(range({-lags}, {lags + 1})) AS INTEGER) AS lag),
ccf AS (
  SELECT {picked}, lag, count(*) AS n_observations,
         CASE WHEN count(*) >= 3 AND stddev_pop(a.s1) > 0 AND stddev_pop(b.s2) > 0 THEN corr(a.s1, b.s2) END
           AS correlation
  FROM al a, lag_list, al b WHERE {on} AND b.pos = a.pos + lag AND a.n >= 24 GROUP BY {picked}, lag),
best AS (
  SELECT {keys}, lag AS optimal_lag, correlation AS max_correlation FROM ccf WHERE correlation IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(abs(correlation), 12) DESC, lag) = 1)"""


LABEL = """CASE WHEN correlation IS NULL THEN 'insufficient_data'
  WHEN lag > 0 THEN 'series1_leads_by_' || lag || '_periods'
  WHEN lag < 0 THEN 'series2_leads_by_' || -lag || '_periods' ELSE 'contemporaneous' END AS interpretation"""
ONE = """one AS (SELECT 'all' AS grp, month, cpu_index AS s1, deal_count AS s2 FROM merged)"""


@query("ccf", PANEL + f",\n{ONE},\n{ccf_sql('one', 'grp')}" + f"""
SELECT lag, {r('correlation')} AS correlation, n_observations, {LABEL} FROM ccf""")
def _(spark, sf):
    return rounded(ll.cross_correlation(i.panel(spark, sf), (), "cpu_index", "deal_count"))


@query("optimal_lag", PANEL + f",\n{ONE},\n{ccf_sql('one', 'grp')}" + f"""
SELECT optimal_lag, {r('max_correlation')} AS max_correlation, abs(max_correlation) >= 0.1 AS is_significant,
       CASE WHEN max_correlation > 0 THEN 'positive' ELSE 'negative' END AS direction,
       CASE WHEN optimal_lag > 0 THEN 'series1' WHEN optimal_lag < 0 THEN 'series2' ELSE 'contemporaneous' END
         AS lead_series, n_observations, {r('correlation')} AS contemporaneous
FROM best JOIN ccf ON lag = 0""")
def _(spark, sf):
    ccf = ll.cross_correlation(i.panel(spark, sf), (), "cpu_index", "deal_count")
    return rounded(ll.optimal_lag(ccf, (), 0.1))


@query("ccf_significance", PANEL + f",\n{ONE},\n{ccf_sql('one', 'grp')}" + f""",
b AS (SELECT *, 1.959963984540054 / sqrt(first(n_observations) OVER (ORDER BY lag)) AS bound FROM ccf)
SELECT lag, {r('correlation')} AS correlation, n_observations, {LABEL}, {r('bound')} AS bound,
       coalesce(abs(correlation) > bound, false) AS significant FROM b""")
def _(spark, sf):
    ccf = ll.cross_correlation(i.panel(spark, sf), (), "cpu_index", "deal_count")
    return rounded(ll.ccf_significance(ccf))


PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}_vs_{b}' AS pair, month, {a} AS s1, CAST({b} AS DOUBLE) AS s2 FROM merged" for a, b in LEADLAG_PAIRS
) + ")"


@query("leadlag_pairs", PANEL + f",\n{PAIRS},\n{ccf_sql('pairs', 'pair')}" + f"""
SELECT best.pair, optimal_lag, {r('max_correlation')} AS max_correlation, true AS is_significant,
       CASE WHEN max_correlation > 0 THEN 'positive' ELSE 'negative' END AS direction,
       CASE WHEN optimal_lag > 0 THEN 'series1' WHEN optimal_lag < 0 THEN 'series2' ELSE 'contemporaneous' END
         AS lead_series, n_observations, {r('correlation')} AS contemporaneous
FROM best JOIN ccf ON best.pair = ccf.pair AND lag = 0""")
def _(spark, sf):
    return rounded(ll.leadlag_pairs(i.panel(spark, sf), LEADLAG_PAIRS))


# --- sectors ------------------------------------------------------------------------------------------------


def sector_sql(keys: str, source: str, metric: str = "count(company_id)", start: str = i.SECTOR_START,
               columns: str = "'cpu_index' AS index_column, cpu_index AS s1") -> str:
    """CTEs up to sens(index_column, keys, ...) over companies-like rows with the given key columns."""
    first = f"CASE WHEN DATE '{start}' = date_trunc('month', DATE '{start}') THEN DATE '{start}' " \
            f"ELSE date_trunc('month', DATE '{start}') + INTERVAL 1 MONTH END"
    on = " AND ".join(f"k.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"k.{k.strip()}" for k in keys.split(","))
    return f"""era AS (SELECT month, unnest([{{columns}}], recursive := true) FROM ser WHERE month >= DATE '{start}'),
cnt AS (SELECT {keys}, month, CAST({metric} AS DOUBLE) AS v FROM {source}
        WHERE last_financing_date >= DATE '{start}' GROUP BY {keys}, month),
calendar AS (SELECT CAST(unnest(generate_series({first}, (SELECT max(month) FROM era), INTERVAL 1 MONTH)) AS DATE) AS month),
aligned AS (
  SELECT index_column, {picked}, calendar.month, s1, coalesce(v, 0) AS s2
  FROM (SELECT DISTINCT {keys} FROM cnt) k CROSS JOIN calendar
  LEFT JOIN cnt c ON {on} AND c.month = calendar.month JOIN era ON era.month = calendar.month),
{ccf_sql('aligned', 'index_column, ' + keys)},
sizes AS (SELECT index_column, {keys}, count(s1) AS n_observations FROM aligned GROUP BY ALL),
sens AS (
  SELECT index_column, {keys}, optimal_lag, max_correlation AS correlation,
         CASE WHEN max_correlation <> 0 THEN abs(max_correlation) END AS abs_correlation,
         CASE WHEN max_correlation > 0 THEN 'positive' WHEN max_correlation IS NOT NULL THEN 'negative' END AS direction,
         n_observations FROM sizes LEFT JOIN best USING (index_column, {keys}))""".replace("{columns}", columns)


ONE_INDEX = "{index_column: 'cpu_index', s1: cpu_index}"
TWO_INDEX = "{index_column: 'cpu_impl', s1: cpu_impl}, {index_column: 'cpu_reversal', s1: cpu_reversal}"
BASE = i.with_(i.COUNTS, i.INDEX_SERIES, i.COMPANIES)
JUDGED = "judged AS (SELECT *, deepseek_category AS sector FROM companies WHERE deepseek_category IS NOT NULL AND deepseek_category <> 'Others')"
INTERPRET = """CASE WHEN optimal_lag IS NOT NULL THEN printf('%s: %s by %d months, r=%.3f (%s)', sector,
  CASE WHEN optimal_lag > 0 THEN 'CPU leads VC' WHEN optimal_lag < 0 THEN 'VC leads CPU' ELSE 'Contemporaneous' END,
  abs(optimal_lag), correlation, direction) END AS interpretation"""
STATS = f"optimal_lag, {r('correlation')} AS correlation, {r('abs_correlation')} AS abs_correlation, direction, n_observations"


def _sector(keys: str, source: str, columns: str = ONE_INDEX, **options) -> str:
    return sector_sql(keys, source, columns=columns, **options)


SECTOR = BASE + ",\n" + JUDGED + ",\n"


@query("sector_ranking", SECTOR + _sector("sector", "judged") + f"SELECT sector, {STATS}, {INTERPRET} FROM sens")
def _(spark, sf):
    ranked = sc.sector_ranking(
        i.companies(spark, sf), i.index_series(spark, sf), category="deepseek_category", start_date=i.SECTOR_START
    )
    return rounded(ranked)


@query("sector_ranking_amount", SECTOR + _sector("sector", "judged", metric="coalesce(sum(total_raised), 0)")
       + f"SELECT sector, {STATS}, {INTERPRET} FROM sens")
def _(spark, sf):
    ranked = sc.sector_ranking(
        i.companies(spark, sf), i.index_series(spark, sf), metric="total_amount",
        category="deepseek_category", start_date=i.SECTOR_START,
    )
    return rounded(ranked)


@query("ccf_by_sector", SECTOR + _sector("sector", "judged") + f"""
SELECT index_column, sector, lag, {r('correlation')} AS correlation, n_observations, {LABEL} FROM ccf""")
def _(spark, sf):
    return rounded(_sector_ccf(spark, sf))


def _sector_ccf(spark, sf):
    rows = i.companies(spark, sf).withColumnRenamed("deepseek_category", "sector").where(
        "sector is not null and sector != 'Others'"
    )
    panel = sc.aligned_panel(
        rows, i.index_series(spark, sf), ["sector"], ["cpu_index"], "deal_count", i.SECTOR_START
    )
    return ll.cross_correlation(panel, ["index_column", "sector"])


@query("sector_lag_matrix", SECTOR + _sector("sector", "judged") + "SELECT sector, " + ", ".join(
    r(f"max(correlation) FILTER (WHERE lag = {k})") + f" AS lag_{'m' if k < 0 else 'p'}{abs(k)}" for k in range(-12, 13)
) + " FROM ccf GROUP BY sector")
def _(spark, sf):
    return rounded(sc.lag_matrix(_sector_ccf(spark, sf)))


@query("sector_monthly", SECTOR + f"""
k AS (SELECT DISTINCT sector FROM judged WHERE last_financing_date BETWEEN DATE '1996-01-01' AND DATE '1998-05-20'),
cal AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1998-05-20', INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT k.sector, cal.month, count(company_id) AS deal_count FROM k CROSS JOIN cal
LEFT JOIN judged j ON j.sector = k.sector AND j.month = cal.month AND j.last_financing_date <= DATE '1998-05-20'
GROUP BY 1, 2""")
def _(spark, sf):
    return sc.sector_monthly(i.companies(spark, sf), "1996-01-01", "1998-05-20", "deepseek_category")


DECOMPOSED = SECTOR + _sector("sector", "judged", TWO_INDEX) + """,
wide AS (SELECT sector,
  max(correlation) FILTER (WHERE index_column = 'cpu_impl') AS ic, max(optimal_lag) FILTER (WHERE index_column = 'cpu_impl') AS il,
  max(abs_correlation) FILTER (WHERE index_column = 'cpu_impl') AS ia,
  max(correlation) FILTER (WHERE index_column = 'cpu_reversal') AS rc,
  max(optimal_lag) FILTER (WHERE index_column = 'cpu_reversal') AS rl,
  max(abs_correlation) FILTER (WHERE index_column = 'cpu_reversal') AS ra FROM sens GROUP BY sector),
dec AS (SELECT *, CASE WHEN ia + ra > 0 THEN (ia - ra) / (ia + ra) END AS asym FROM wide)
"""
DECOMPOSITION = f"""SELECT sector, {r('ic')} AS impl_correlation, il AS impl_lag, {r('ia')} AS impl_abs,
  {r('rc')} AS reversal_correlation, rl AS reversal_lag, {r('ra')} AS reversal_abs, {r('asym')} AS asymmetry_ratio,
  CASE WHEN asym > 0.1 THEN 'implementation' WHEN asym < -0.1 THEN 'reversal' ELSE 'balanced' END AS dominant_type FROM dec"""


def _decomposition(spark, sf):
    return sc.decomposition(
        i.companies(spark, sf), i.index_series(spark, sf), "deepseek_category", start_date=i.SECTOR_START
    )


@query("decomposition", DECOMPOSED + DECOMPOSITION)
def _(spark, sf):
    return rounded(_decomposition(spark, sf))


@query("decomposition_known", DECOMPOSED + DECOMPOSITION + " WHERE ic IS NOT NULL AND rc IS NOT NULL")
def _(spark, sf):
    return rounded(sc.both_components_known(_decomposition(spark, sf)))


BANDED = """banded AS (SELECT *, CASE WHEN ira_index >= 6 THEN 'high' ELSE 'low' END AS band FROM companies
  WHERE ira_index >= 6 OR ira_index <= 3)"""
STRATA = BASE + ",\n" + BANDED + ",\n" + _sector("band", "banded") + f""",
firms AS (SELECT band, count(DISTINCT company_id) AS n_companies FROM banded
          WHERE last_financing_date >= DATE '{i.SECTOR_START}' GROUP BY band),
strata AS (SELECT * FROM sens JOIN firms USING (band))
"""


def _strata(spark, sf):
    return sc.exposure_strata(i.companies(spark, sf), i.index_series(spark, sf), start_date=i.SECTOR_START)


@query("exposure_strata", STRATA + f"SELECT band, {STATS}, n_companies FROM strata")
def _(spark, sf):
    return rounded(_strata(spark, sf))


@query("exposure_comparison", STRATA + f"""
SELECT h.n_companies AS high_n_companies, l.n_companies AS low_n_companies, {r('h.correlation')} AS high_correlation,
       {r('l.correlation')} AS low_correlation, {r('h.abs_correlation - l.abs_correlation')} AS difference,
       h.abs_correlation - l.abs_correlation > 0 AS high_more_sensitive
FROM strata h, strata l WHERE h.band = 'high' AND l.band = 'low'""")
def _(spark, sf):
    return rounded(sc.exposure_comparison(_strata(spark, sf)))


STACKED = "stacked AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS classifier, {c} AS sector, company_id, last_financing_date, month, total_raised FROM companies "
    f"WHERE {c} IS NOT NULL AND {c} <> 'Others'" for c, name in i.CLASSIFIERS.items()
) + ")"
ROBUST = BASE + ",\n" + STACKED + ",\n" + _sector("classifier, sector", "stacked") + """,
robust AS (SELECT *, CAST(row_number() OVER (PARTITION BY classifier ORDER BY abs_correlation DESC NULLS LAST, sector)
           AS INTEGER) AS rank FROM sens)
"""


def _robust(spark, sf):
    return sc.classifier_robustness(
        i.companies(spark, sf), i.index_series(spark, sf), i.CLASSIFIERS, start_date=i.SECTOR_START
    )


@query("classifier_robustness", ROBUST + f"SELECT classifier, sector, {STATS}, {INTERPRET}, rank FROM robust")
def _(spark, sf):
    return rounded(_robust(spark, sf))


@query("classifier_agreement", ROBUST + f"""
SELECT CAST(4 AS BIGINT) AS n_classifiers, count(*) FILTER (WHERE votes = 4) AS shared_sectors, count(*) AS all_sectors,
       {r('count(*) FILTER (WHERE votes = 4) / count(*)')} AS agreement_score
FROM (SELECT sector, count(DISTINCT classifier) AS votes FROM robust WHERE rank <= 3 GROUP BY sector)""")
def _(spark, sf):
    return rounded(sc.classifier_agreement(_robust(spark, sf)))


def _era_ctes(prefix: str, start: str) -> str:
    """The sector CTEs once more under other names."""
    import re

    text = _sector("sector", "judged", start=start)
    names = ["era", "cnt", "calendar", "aligned", "al", "lag_list", "ccf", "best", "sizes", "sens"]
    for name in names:
        text = re.sub(rf"\b{name}\b", f"{prefix}_{name}", text)
    return text


@query("era_comparison", SECTOR + _era_ctes("r", i.ERA_START) + ",\n" + _era_ctes("f", i.SECTOR_START) + f"""
SELECT sector, {r('r.correlation')} AS corr_ira_era, r.optimal_lag AS lag_ira_era,
       {r('f.correlation')} AS corr_full_sample, f.optimal_lag AS lag_full_sample,
       {r('r.correlation - f.correlation')} AS corr_change,
       coalesce(r.correlation > 0, false) <> coalesce(f.correlation > 0, false) AS direction_flip
FROM r_sens r JOIN f_sens f USING (sector)""")
def _(spark, sf):
    companies, index = i.companies(spark, sf), i.index_series(spark, sf)
    recent, full = (
        sc.sector_ranking(companies, index, category="deepseek_category", start_date=start)
        for start in (i.ERA_START, i.SECTOR_START)
    )
    return rounded(sc.era_comparison(recent, full))


# --- stationarity and causality --------------------------------------------------------------------------------


def _outlet_series(spark, sf):
    """Ratio series of every outlet, as one panel of many keys."""
    from newsgauge.operators.outlets import outlet_ratio

    return outlet_ratio(i.outlet_panel(spark, sf)).select(
        "outlet", F.to_date(F.concat("month", F.lit("-01"))).alias("month"), "value"
    )


OUTLET_SERIES = i.OUTLETS + """,
s AS (SELECT outlet, month, numerator / denominator AS v FROM panel)"""
KPSS_CTES = """d AS (SELECT outlet, month, v - avg(v) OVER (PARTITION BY outlet) AS e, count(*) OVER (PARTITION BY outlet) AS n,
      row_number() OVER (PARTITION BY outlet ORDER BY month) AS pos FROM s),
wk AS (SELECT *, sum(e) OVER (PARTITION BY outlet ORDER BY pos) AS walk FROM d WHERE n >= 24),
g AS (SELECT outlet, any_value(n) AS n, sum(walk * walk) AS w2, sum(e * e) AS e2 FROM wk GROUP BY outlet),
cv AS (SELECT a.outlet, b.pos - a.pos AS k, sum(a.e * b.e) AS c FROM wk a JOIN wk b ON a.outlet = b.outlet AND b.pos > a.pos
       GROUP BY 1, 2),
s01 AS (SELECT g.outlet, any_value(g.n) AS n, any_value(w2) AS w2, any_value(e2) AS e2,
        any_value(e2) / any_value(g.n) + sum(CASE WHEN k <= floor(g.n ^ (2 / 9)) THEN c / (g.n / 2) ELSE 0 END) AS s0,
        sum(CASE WHEN k <= floor(g.n ^ (2 / 9)) THEN k * c / (g.n / 2) ELSE 0 END) AS s1
        FROM g JOIN cv ON g.outlet = cv.outlet GROUP BY g.outlet),
bw AS (SELECT *, least(floor(1.1447 * ((s1 / s0) ^ 2) ^ (1 / 3) * n ^ (1 / 3)), n - 1) AS l FROM s01),
var AS (SELECT bw.outlet, any_value(bw.n) AS n, any_value(l) AS l, any_value(w2) AS w2,
        (any_value(e2) + 2 * sum(CASE WHEN k <= l THEN c * (1 - k / (l + 1)) ELSE 0 END)) / any_value(bw.n) AS s2
        FROM bw JOIN cv ON bw.outlet = cv.outlet GROUP BY bw.outlet),
res AS (SELECT outlet, n, l, w2 / (n * n) / s2 AS stat FROM var)"""


@query("kpss_panel", "WITH " + OUTLET_SERIES + f""",
{KPSS_CTES}
SELECT outlet, n, CAST(l AS INTEGER) AS kpss_lags, {r('stat')} AS kpss_statistic,
  {r('''CASE WHEN stat <= 0.347 THEN 0.10 WHEN stat <= 0.463 THEN 0.10 - (stat - 0.347) * 0.05 / 0.116
        WHEN stat <= 0.574 THEN 0.05 - (stat - 0.463) * 0.025 / 0.111
        WHEN stat <= 0.739 THEN 0.025 - (stat - 0.574) * 0.015 / 0.165 ELSE 0.01 END''')} AS kpss_pvalue FROM res""")
def _(spark, sf):
    return rounded(st.kpss_panel(_outlet_series(spark, sf), ["outlet"]))


def eliminated(steps: str, size: str) -> str:
    """Recursive CTE el(id, p, k, m): matrices of gram(id, p, m) after k pivots."""
    return f"""el AS (
  SELECT id, p, 0 AS k, m FROM gram
  UNION ALL
  SELECT id, p, k + 1, list_transform(range(1, {size} + 1), lambda i: CASE WHEN i = k + 1
    THEN list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1])
    ELSE list_transform(range(1, {size} + 1), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
  FROM el WHERE k < {steps})"""


def gram_sql(rows: str) -> str:
    """CTEs up to gram(id, p, m) from rows(id, p, v): v is the list of a row's regressors and targets."""
    return f"""cells AS (
  SELECT id, p, a.i, b.i AS j, sum(v[a.i] * v[b.i]) AS s FROM {rows}, (SELECT unnest(range(1, 40)) AS i) a,
    (SELECT unnest(range(1, 40)) AS i) b WHERE a.i <= len(v) AND b.i <= len(v) GROUP BY id, p, a.i, b.i),
lines AS (SELECT id, p, i, list(s ORDER BY j) AS line FROM cells GROUP BY id, p, i),
gram AS (SELECT id, p, list(line ORDER BY i) AS m FROM lines GROUP BY id, p)"""


def series_sql(columns: dict[str, str], source: str, key: str) -> str:
    """CTE packed(id, n, <columns as sorted lists, centred>) of complete rows of source(key, month, ..)."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns.values())
    centred = ", ".join(f"list({c} - mean_{name} ORDER BY month) AS {name}" for name, c in columns.items())
    means = ", ".join(f"avg({c}) OVER (PARTITION BY {key}) AS mean_{name}" for name, c in columns.items())
    return f"""complete AS (SELECT *, {means} FROM {source} WHERE {known}),
packed AS (SELECT {key} AS id, count(*) AS n, {centred} FROM complete GROUP BY {key})"""


# the steps d, their lags and the level before: orders 0 to most on a common sample, then the chosen one on its own
ADF_CTES = f"""{series_sql({"y": "v"}, "s", "outlet")},
st AS (SELECT *, least(n // 2 - 2, CAST(ceil(12 * (n / 100) ^ 0.25) AS INTEGER)) AS most,
  list_transform(range(1, n), lambda t: y[t + 1] - y[t]) AS d FROM packed WHERE n >= 24 AND list_max(y) > list_min(y)),
smp AS (SELECT id, most AS p, list_concat([1.0, y[t]], list_transform(range(1, most + 1), lambda k: d[t - k]), [d[t]]) AS v
  FROM (SELECT *, unnest(range(most + 1, n)) AS t FROM st)),
{gram_sql("smp")},
{eliminated("p + 2", "(p + 3)")},
crit AS (SELECT el.id, el.k - 2 AS lag, n - 1 - p AS c, (n - 1 - p) * ln(m[p + 3][p + 3] / (n - 1 - p)) + 2 * el.k AS aic
  FROM el JOIN st ON st.id = el.id WHERE el.k >= 2),
best AS (SELECT id, arg_min(lag, (aic, lag)) AS lag FROM crit GROUP BY id),
smp2 AS (SELECT id, lag AS p, list_concat([1.0], list_transform(range(1, lag + 1), lambda k: d[t - k]), [y[t], d[t]]) AS v
  FROM (SELECT st.*, lag, unnest(range(lag + 1, n)) AS t FROM st JOIN best ON best.id = st.id)),
{gram_sql("smp2").replace("cells", "cells2").replace("lines", "lines2").replace("gram", "gram2")},
{eliminated("p + 1", "(p + 3)").replace("el ", "el2 ").replace("gram", "gram2")},
fin AS (SELECT el2.id, p AS lag, n - 1 - p AS nobs, m[p + 2][p + 2] AS ll, m[p + 2][p + 3] AS ly, m[p + 3][p + 3] AS yy
  FROM el2 JOIN st ON st.id = el2.id WHERE k = p + 1),
adf AS (SELECT *, (ly / ll) / sqrt((yy - ly * ly / ll) / (nobs - lag - 2) / ll) AS tau FROM fin)"""
ADF_SQL = "WITH RECURSIVE " + OUTLET_SERIES + f""",
{ADF_CTES}
SELECT id AS outlet, CAST(lag AS INTEGER) AS adf_lags, CAST(nobs AS INTEGER) AS adf_nobs,
  {r("tau")} AS adf_statistic,
  {r("-3.43035 - 6.5393 / nobs - 16.786 / nobs ** 2 - 79.433 / nobs ** 3")} AS adf_crit_1,
  {r("-2.86154 - 2.8903 / nobs - 4.234 / nobs ** 2 - 40.040 / nobs ** 3")} AS adf_crit_5,
  {r("-2.56677 - 1.5384 / nobs - 2.809 / nobs ** 2")} AS adf_crit_10 FROM adf"""


@query("adf_panel", ADF_SQL)
def _(spark, sf):
    """Without the p-value, which is a function of the statistic that SQL lacks; tests hold it."""
    return rounded(st.adf_panel(_outlet_series(spark, sf), ["outlet"]).drop("adf_pvalue"))


def unit_root_limit(alpha: float = 0.05) -> float:
    """The statistic whose p-value is alpha; the p-value rises with it."""
    low, high = inf.TAU_MIN, inf.TAU_MAX
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if inf.unit_root_p(middle) < alpha else (low, middle)
    return high


# a level test's p-value is at least 0.05 up to its statistic's critical value
VERDICT_CTES = f"""verdict AS (SELECT res.outlet, res.n, stat, CAST(l AS INTEGER) AS l, lag, nobs, tau,
  tau < {unit_root_limit()!r} AS adf_ok, stat <= 0.463 AS kpss_ok
  FROM res LEFT JOIN adf ON adf.id = res.outlet)"""


@query("stationarity_verdict", "WITH RECURSIVE " + OUTLET_SERIES + f""",
{KPSS_CTES},
{ADF_CTES},
{VERDICT_CTES}
SELECT outlet, n, {r('stat')} AS kpss_statistic, l AS kpss_lags, {r('tau')} AS adf_statistic, CAST(lag AS INTEGER) AS adf_lags,
  CAST(nobs AS INTEGER) AS adf_nobs, adf_ok AS adf_stationary, kpss_ok AS kpss_stationary,
  CASE WHEN adf_ok AND kpss_ok THEN 'stationary' WHEN NOT adf_ok AND NOT kpss_ok THEN 'non_stationary'
       WHEN adf_ok AND NOT kpss_ok THEN 'trend_stationary' WHEN NOT adf_ok AND kpss_ok THEN 'inconclusive' END AS conclusion,
  NOT kpss_ok AS differencing_needed FROM verdict""")
def _(spark, sf):
    found = st.stationarity(_outlet_series(spark, sf), ["outlet"])
    return rounded(found.drop("adf_pvalue", "kpss_pvalue", "adf_crit_1", "adf_crit_5", "adf_crit_10"))


# all orders of all series as series of their own, then the first order that the tests accept, else the last
LADDER = "WITH RECURSIVE " + OUTLET_SERIES.replace("s AS (", "raw AS (") + f""",
d1 AS (SELECT outlet, month, v - lag(v) OVER (PARTITION BY outlet ORDER BY month) AS v FROM raw QUALIFY row_number() OVER (PARTITION BY outlet ORDER BY month) > 1),
d2 AS (SELECT outlet, month, v - lag(v) OVER (PARTITION BY outlet ORDER BY month) AS v FROM d1 QUALIFY row_number() OVER (PARTITION BY outlet ORDER BY month) > 1),
s AS (SELECT outlet || '/0' AS outlet, month, v FROM raw UNION ALL SELECT outlet || '/1', month, v FROM d1
      UNION ALL SELECT outlet || '/2', month, v FROM d2),
{KPSS_CTES},
{ADF_CTES},
{VERDICT_CTES},
sizes AS (SELECT split_part(outlet, '/', 1) AS name, CAST(split_part(outlet, '/', 2) AS INTEGER) AS ord, outlet, count(*) AS length FROM s GROUP BY outlet),
stops AS (SELECT sizes.*, coalesce(adf_ok IS NOT NULL AND kpss_ok, false) AS ok FROM sizes LEFT JOIN verdict ON verdict.outlet = sizes.outlet
          WHERE coalesce(adf_ok IS NOT NULL AND kpss_ok, false) OR ord = 2 OR (ord > 0 AND (adf_ok IS NULL OR kpss_ok IS NULL))),
picked AS (SELECT name, min(ord) AS ord FROM stops GROUP BY name)
"""


@query("make_stationary", LADDER + """
SELECT picked.name AS outlet, o.length AS original_length, stops.length AS final_length, picked.ord AS differences_applied,
  ok AS is_stationary FROM picked JOIN stops ON stops.name = picked.name AND stops.ord = picked.ord
  JOIN sizes o ON o.name = picked.name AND o.ord = 0""")
def _(spark, sf):
    return rounded(st.make_stationary(_outlet_series(spark, sf), ["outlet"]))


@query("stationary_series", LADDER + f"""
SELECT name AS outlet, CAST(month || '-01' AS DATE) AS month, ord AS differences, {r('v')} AS value
FROM picked JOIN s ON s.outlet = picked.name || '/' || picked.ord""")
def _(spark, sf):
    return rounded(st.stationary_series(_outlet_series(spark, sf), ["outlet"]))


def _pairs(spark, sf):
    return ll.stack_pairs(i.panel(spark, sf), LEADLAG_PAIRS)


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    """P(F > f) for d1 = 1 to 4: the incomplete beta function I(d2 / 2, d1 / 2) by its finite recurrences."""
    x, a = f"({d2} / ({d2} + {d1} * {f}))", f"({d2} / 2.0)"
    base = f"(CASE WHEN {d2} % 2 = 0 THEN 1.0 ELSE 0.5 END)"
    beta = lambda u, v: f"exp(lgamma({u}) + lgamma({v}) - lgamma({u} + {v}))"
    first = f"(CASE WHEN {d2} % 2 = 0 THEN 1 - sqrt(1 - {x}) ELSE 2 / pi() * asin(sqrt({x})) END)"
    half = f"({first} - coalesce(list_sum(list_transform(range(0, CAST({a} - {base} AS INTEGER)), lambda s: " \
           f"{x} ** ({base} + s) * sqrt(1 - {x}) / (({base} + s) * {beta(f'({base} + s)', '0.5')}))), 0))"
    return f"""(CASE {d1} WHEN 1 THEN {half} WHEN 2 THEN {x} ** {a} WHEN 4 THEN {x} ** {a} * (1 + {a} * (1 - {x}))
      ELSE {half} + {x} ** {a} * sqrt(1 - {x}) / (0.5 * {beta(a, '0.5')}) END)"""


def granger_sql(own: str, other: str) -> str:
    """CTEs up to tst(id, n, fs, ps): F and p-value per lag order that ``other`` helps to predict ``own``."""
    return f"""{PAIRS},
{series_sql({"a": own, "b": other}, "pairs", "pair")},
smp AS (SELECT id, p, list_concat([1.0], list_transform(range(1, p + 1), lambda k: a[t - k]),
    list_transform(range(1, p + 1), lambda k: b[t - k]), [a[t]]) AS v
  FROM (SELECT *, unnest(range(p + 1, n + 1)) AS t FROM packed, (SELECT unnest(range(1, 5)) AS p) WHERE n >= 32)),
{gram_sql("smp")},
{eliminated("2 * p + 1", "(2 * p + 2)")},
rss AS (SELECT id, p, max(m[2 * p + 2][2 * p + 2]) FILTER (k = p + 1) AS r0, max(m[2 * p + 2][2 * p + 2]) FILTER (k = 2 * p + 1) AS r1
  FROM el GROUP BY id, p),
fval AS (SELECT rss.id, p, n, n - 3 * p - 1 AS free, (r0 - r1) * (n - 3 * p - 1) / (r1 * p) AS f FROM rss JOIN packed ON packed.id = rss.id),
tst AS (SELECT id, n, p, f, {f_tail_sql("f", "p", "free")} AS pv FROM fval)"""


GRANGER_ROWS = "WITH RECURSIVE " + i.PANEL + f",\n{granger_sql('s2', 's1')}\n"


@query("granger_panel", GRANGER_ROWS + f"""
SELECT id AS pair, n AS n_observations, {r('min(pv)')} AS min_pvalue, CAST(arg_min(p, (pv, p)) AS INTEGER) AS optimal_lag,
  min(pv) < 0.05 AS granger_causes FROM tst GROUP BY id, n""")
def _(spark, sf):
    return rounded(ca.granger_panel(_pairs(spark, sf), ["pair"]).drop("pvalues", "f_statistics"))


@query("granger_by_lag", GRANGER_ROWS + f"""
SELECT id AS pair, CAST(p AS INTEGER) AS lag, {r('f')} AS f_statistic, {r('pv')} AS pvalue FROM tst""")
def _(spark, sf):
    found = ca.granger_panel(_pairs(spark, sf), ["pair"])
    return rounded(found.select("pair", F.posexplode(F.arrays_zip("f_statistics", "pvalues")).alias("at", "t")).select(
        "pair", (F.col("at") + 1).alias("lag"), F.col("t.f_statistics").alias("f_statistic"),
        F.col("t.pvalues").alias("pvalue")))


def renamed(ctes: str, suffix: str) -> str:
    """The same CTEs once more under other names."""
    return re.sub(r"\b(complete|packed|smp|cells|lines|gram|el|rss|fval|tst)\b(?! ==)", rf"\1{suffix}", ctes)


BACKWARD = renamed(granger_sql("s1", "s2").split(",\n", 1)[1], "_b")


@query("granger_bidirectional", GRANGER_ROWS.rstrip() + f""",
{BACKWARD},
fw AS (SELECT id, min(pv) AS pv, arg_min(p, (pv, p)) AS lag FROM tst GROUP BY id),
bw AS (SELECT id, min(pv) AS pv, arg_min(p, (pv, p)) AS lag FROM tst_b GROUP BY id)
SELECT fw.id AS pair, fw.pv < 0.05 AS forward_causes, {r('fw.pv')} AS forward_pvalue, CAST(fw.lag AS INTEGER) AS forward_lag,
  bw.pv < 0.05 AS backward_causes, {r('bw.pv')} AS backward_pvalue, CAST(bw.lag AS INTEGER) AS backward_lag,
  CASE WHEN fw.pv < 0.05 AND bw.pv < 0.05 THEN 'bidirectional' WHEN fw.pv < 0.05 THEN 's1_causes_s2'
       WHEN bw.pv < 0.05 THEN 's2_causes_s1' ELSE 'no_granger_causality' END AS relationship
FROM fw JOIN bw ON fw.id = bw.id""")
def _(spark, sf):
    return rounded(ca.granger_bidirectional(_pairs(spark, sf), ["pair"]))


# orders 0 to 4 on the common sample for the choice (negative p), each on its own sample for the fit (p)
def var_sql(source: str, table: str, key: str, one: str, two: str) -> str:
    return f"""WITH RECURSIVE {source},
{series_sql({"a": one, "b": two}, table, key)},
smp AS (SELECT id, p, list_concat([1.0], flatten(list_transform(range(1, o + 1), lambda k: [a[t - k], b[t - k]])), [a[t], b[t]]) AS v
  FROM (SELECT *, CASE WHEN p < 0 THEN -p - 1 ELSE p END AS o, unnest(range(CASE WHEN p < 0 THEN 5 ELSE p + 1 END, n + 1)) AS t
        FROM packed, (SELECT unnest(range(-5, 5)) AS p) WHERE n >= 32)),
{gram_sql("smp")},
{eliminated("len(m)", "len(m)")},
pv AS (SELECT id, p, sum(ln(m[k + 1][k + 1])) AS logs FROM el WHERE k >= len(m) - 2 AND k < len(m) GROUP BY id, p),
crit AS (SELECT pv.id, p, CASE WHEN p < 0 THEN -p - 1 ELSE p END AS o, logs, n - CASE WHEN p < 0 THEN 4 ELSE p END AS rows
  FROM pv JOIN packed ON packed.id = pv.id),
ic AS (SELECT *, logs - 2 * ln(rows) AS logdet, 4 * o + 2 AS free FROM crit),
best AS (SELECT id, arg_min(o, (logdet + 2 * free / rows, o)) AS o FROM ic WHERE p < 0 GROUP BY id)
"""


VAR_ROWS = var_sql(i.PANEL + f",\n{PAIRS}", "pairs", "pair", "s1", "s2")


@query("var_panel", VAR_ROWS + f"""
SELECT ic.id AS pair, n AS n_observations, true AS fitted, CAST(ic.o AS INTEGER) AS optimal_lag,
  {r('logdet + 2 * free / rows')} AS aic, {r('logdet + ln(rows) * free / rows')} AS bic
FROM ic JOIN best ON best.id = ic.id AND best.o = ic.p JOIN packed ON packed.id = ic.id""")
def _(spark, sf):
    return rounded(ca.var_panel(_pairs(spark, sf), ["pair"], ["s1", "s2"]).drop("coefficients"))


@query("var_coefficients", var_sql(i.OUTLETS, "panel", "outlet", "numerator", "denominator") + f"""
SELECT el.id AS outlet, CAST(lag AS INTEGER) AS lag, CAST(eq AS INTEGER) AS equation, CAST(var AS INTEGER) AS variable,
  {r('m[2 * lag + var - 1][len(m) - 2 + eq]')} AS coefficient
FROM el JOIN best ON best.id = el.id AND best.o = el.p, (SELECT unnest([1, 2]) AS eq), (SELECT unnest([1, 2]) AS var),
  (SELECT unnest(range(1, 5)) AS lag) WHERE lag <= o AND el.k = len(m) - 2""")
def _(spark, sf):
    found = ca.var_panel(i.outlet_panel(spark, sf), ["outlet"], ["numerator", "denominator"])
    rows = found.select("outlet", F.posexplode(F.from_json("coefficients", "array<array<array<double>>>")).alias("lag", "m"))
    rows = rows.select("outlet", "lag", F.posexplode("m").alias("equation", "line"))
    rows = rows.select("outlet", "lag", "equation", F.posexplode("line").alias("variable", "coefficient"))
    return rounded(rows.select("outlet", *[(F.col(c) + 1).alias(c) for c in ("lag", "equation", "variable")], "coefficient"))


@query("leadlag_report")
def _(spark, sf):
    return rounded(ca.leadlag_report(_pairs(spark, sf), ["pair"]))
