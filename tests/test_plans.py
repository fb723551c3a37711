"""Physical plans, and the composed analyses as files."""

import os

import __spark_entry__ as entry
from newsgauge.plans import reports
from suite import inputs

SF = "/root/testdata/sf0.001"


def scans(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_scans_read_needed_columns_only(spark):
    (scan,) = scans(spark, "build_index")
    schema = scan.split("ReadSchema: ")[1]
    assert "l_shipdate" in schema and "l_extendedprice" not in schema and "l_tax" not in schema
    (scan,) = scans(spark, "count_by_source")
    assert "text" not in scan.split("ReadSchema: ")[1]


def test_filters_reach_the_scan(spark):
    (scan,) = scans(spark, "articles_by_source")
    assert "EqualTo(source,src3)" in scan
    (scan,) = scans(spark, "deals_filtered")
    assert "EqualTo(o_orderstatus,F)" in scan or "o_orderstatus" in scan.split("PushedFilters")[1]


def test_lead_lag_shuffles_the_panel_once(spark):
    """All lags and their moments share one exchange of the aligned panel."""
    from newsgauge.operators.leadlag import cross_correlation, optimal_lag

    panel = spark.range(5000).selectExpr(
        "id % 7 as k", "date_add(date'2000-01-01', cast(id div 7 as int)) as month",
        "sin(id) as s1", "cos(id) as s2",
    )
    best = optimal_lag(cross_correlation(panel, ["k"]), ["k"])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_reports_write_all_tables(spark, tmp_path):
    index = inputs.index_series(spark, SF)
    files = reports.leadlag_run(inputs.deals(spark, SF), index, str(tmp_path / "lead"))
    files |= reports.sector_run(
        inputs.companies(spark, SF), index, inputs.CLASSIFIERS, str(tmp_path / "sector"), inputs.SECTOR_START
    )
    assert len(files) == 8
    for path in files.values():
        assert spark.read.option("header", True).csv(path).count() > 0, path
    from newsgauge.operators.outlets import outlet_index

    series = outlet_index(inputs.outlet_panel(spark, SF), "1996-01", "1996-12")
    outlets = sorted(r["outlet"] for r in series.select("outlet").distinct().collect())
    paths = reports.full_report(inputs.index_table(spark, SF), series, outlets, str(tmp_path / "report"))
    assert len(paths) == 7 and all(os.path.isdir(p) for p in paths)


def test_article_and_count_index(spark):
    articles = inputs.articles(spark, SF)
    for plan in (reports.article_index, reports.count_index):
        types = {r["index_type"] for r in plan(articles, inputs.LEXICON).select("index_type").distinct().collect()}
        assert types == {"CPU", "CPU_impl", "CPU_reversal", "salience_ira", "salience_obbba"}
