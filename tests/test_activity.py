import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgauge.functions.calendar import calendar_of, fill_months
from newsgauge.functions.stats import exact_median
from newsgauge.operators import deals as dl
from newsgauge.operators import panel as pn
from newsgauge.sources import files
from newsgauge.sources import tables as tb

D = dt.date
CSV = """Downloaded today
Search: deals

x,y
Created for,someone

Deal ID,Companies,Company ID,Deal Date,Deal Size,Deal Type,Deal Status,Primary Industry Sector,Odd
1,Acme,c1,2008-01-01,"10,000",Seed Round,Completed,Energy,z
2,Beta,c2,2007-12-31,5,Seed Round,Completed,Energy,z
3,"Gam,ma",c3,2020-02-15,,Early Stage VC,Completed,Energy,z
4,Delta,c4,2020-02-16,N/A,Later Stage VC,Completed,Industry,z
5,Eps,c5,2020-03-01,7.5,Grant,Completed,Energy,z
6,Zeta,c6,2020-03-01,7.5,Later Stage VC,Pending,Energy,z
7,Eta,c7,soon,7.5,Later Stage VC,Completed,Energy,z
8,Theta,c8,2020-04-30,0,Angel (individual),Completed,Energy,z
"""


def test_read_deals(spark, tmp_path):
    path = tmp_path / "deals.csv"
    path.write_text(CSV)
    rows = {r["deal_id"]: r for r in files.read_deals(spark, str(path)).collect()}
    assert set(rows) == {"1", "3", "4", "8"}
    assert rows["1"]["deal_size"] == 10000.0 and rows["8"]["deal_size"] == 0.0
    assert rows["3"]["deal_size"] is None and rows["4"]["deal_size"] is None
    assert rows["3"]["company"] == "Gam,ma"
    assert [rows[k]["stage"] for k in "1348"] == ["Seed", "Early", "Late", "Seed"]
    assert rows["4"]["month"] == D(2020, 2, 1) and rows["4"]["year"] == 2020


def test_read_deals_without_header(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_deals(spark, str(path))


DEALS = "deal_id string, deal_date date, deal_size double, stage string, month date"


def deals(frame):
    return frame([
        ("1", D(2020, 1, 5), 10.0, "Seed", D(2020, 1, 1)), ("2", D(2020, 1, 9), 30.0, "Late", D(2020, 1, 1)),
        ("3", D(2020, 1, 9), None, "Early", D(2020, 1, 1)), ("4", D(2020, 4, 2), None, "Seed", D(2020, 4, 1)),
    ], DEALS)


def test_monthly_gap_and_null_rules(frame):
    rows = {r["month"].month: r for r in dl.monthly_activity(deals(frame)).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[1]["deal_count"], rows[1]["total_amount"], rows[1]["median_amount"]) == (3, 40.0, 20.0)
    assert rows[1]["size_coverage_pct"] == pytest.approx(66.6667, abs=1e-3)
    assert (rows[2]["deal_count"], rows[2]["median_amount"], rows[2]["mean_amount"]) == (0, 0.0, 0.0)
    assert (rows[4]["total_amount"], rows[4]["median_amount"], rows[4]["size_coverage_pct"]) == (0.0, None, 0.0)


def test_exact_median_against_builtin(spark):
    import random
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.gauss(0, 1), float(rng.randint(0, 5))])) for k in ("a", "b") for _ in range(30_001)]
    rows += [("c", 1.0), ("c", 2.0), ("d", 5.0), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in exact_median(df, ["k"], "v", "m").collect()}
    want = {r["k"]: r["m"] for r in df.where("v is not null").groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_category_needs_its_columns(frame):
    with pytest.raises(ValueError):
        dl.activity_by_category(deals(frame), "judge_category")


def test_fill_months_rounds_start_up(frame):
    df = frame([("x", D(2020, 2, 1), 5)], "k string, month date, n bigint")
    filled = fill_months(df, ["k"], ["n"], F.lit(D(2020, 1, 15)), F.lit(D(2020, 4, 2)))
    assert {r["month"].month: r["n"] for r in filled.collect()} == {2: 5, 3: 0, 4: 0}


def test_calendar(frame):
    df = frame([(D(2020, 11, 30),), (D(2021, 2, 1),)], "d date")
    assert [r["month"] for r in calendar_of(df, "d").collect()] == ["2020-11", "2020-12", "2021-01", "2021-02"]


def months(n):
    return [D(2015 + k // 12, k % 12 + 1, 1) for k in range(n)]


def test_rolling_needs_full_window(frame):
    df = frame([(m, float(k)) for k, m in enumerate(months(5))], "month date, deal_count double")
    rows = pn.rolling_stats(df, 3, ["deal_count", "absent"]).orderBy("month").collect()
    assert [r["deal_count_rolling_mean"] for r in rows] == [None, None, 1.0, 2.0, 3.0]
    assert rows[2]["deal_count_rolling_std"] == 1.0


def test_rolling_correlation_band(frame):
    df = frame([(m, float(k), float(k % 3)) for k, m in enumerate(months(10))], "month date, x double, y double")
    rows = pn.rolling_correlation(df, "x", "y", 6).orderBy("month").collect()
    assert rows[4]["correlation"] is None and rows[4]["ci_lower"] is None
    assert all(r["ci_lower"] < r["correlation"] < r["ci_upper"] for r in rows[5:])
    exact = frame([(m, float(k), 2.0 * k) for k, m in enumerate(months(5))], "month date, x double, y double")
    last = pn.rolling_correlation(exact, "x", "y", 3).orderBy("month").collect()[-1]
    assert last["correlation"] == last["ci_lower"] == last["ci_upper"]


def test_difference(frame):
    df = frame([(m, float(k * k)) for k, m in enumerate(months(4))], "month date, v double")
    assert [r["v"] for r in pn.difference(df, ["v"], 2).orderBy("month").collect()] == [2.0, 2.0]


def test_panel_join_needs_column(frame):
    df = frame([(D(2020, 1, 1), 1)], "month date, v int")
    with pytest.raises(ValueError):
        pn.panel_join(df, df, "normalized_index")


def test_upsert_and_merge(frame):
    schema = "month string, n int"
    old, new = frame([("a", 1), ("b", 2)], schema), frame([("b", 9), ("c", 3)], schema)
    assert {r["month"]: r["n"] for r in tb.upsert(old, new, ["month"]).collect()} == {"a": 1, "b": 9, "c": 3}
    assert [tuple(r) for r in tb.merge_counts(old, new).collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_batches_are_replaceable(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    schema = "id int, month string, v string"
    tb.write_batch(frame([(1, "m1", "old"), (2, "m1", "keep")], schema), path, 0, ["month"])
    for _ in range(2):
        tb.write_batch(frame([(1, "m2", "new")], schema), path, 1, ["month"])
    assert {r["id"]: (r["month"], r["v"]) for r in tb.read_latest(spark, path, ["id"]).collect()} == {
        1: ("m2", "new"), 2: ("m1", "keep")}


def test_raw_response_log(spark, frame, tmp_path):
    path = str(tmp_path / "log")
    rows = frame([("2024-01", "q", '{"value":[{"ResultId":"1"}]}')], "month string, query string, response_json string")
    tb.append_raw_response(rows, path)
    tb.append_raw_response(rows, path)
    log = spark.read.parquet(path)
    assert log.count() == 2
    row = files.flatten_pages(log).first()
    assert (row["id"], row["title"], row["source"]) == ("1", "", "")


def test_read_index_and_panel(spark, tmp_path):
    path = tmp_path / "index.csv"
    path.write_text("month,cpu_index,cpu_impl\n2024-01,1.5,2\n2024-02-01,2.5,3\n")
    rows = files.read_index(spark, str(path)).orderBy("month").collect()
    assert [r["month"] for r in rows] == [D(2024, 1, 1), D(2024, 2, 1)] and rows[1]["cpu_index"] == 2.5
    panel = tmp_path / "panel.csv"
    panel.write_text(",v\n2024-01-01,1\n")
    assert files.read_panel(spark, str(panel)).first()["month"] == D(2024, 1, 1)
