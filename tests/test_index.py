import pytest
from pyspark.sql import functions as F

from newsgauge.functions.stats import format_value, pearson
from newsgauge.operators import index as ix
from newsgauge.operators import outlets as ou
from newsgauge.sources import exports as ex

COUNTS = ("month string, total_articles bigint, uncertainty_count bigint, "
          "implementation_uncertainty_count bigint, reversal_uncertainty_count bigint, "
          "ira_count bigint, obbba_count bigint")


def series(df, column="value", key="month"):
    return {r[key]: r[column] for r in df.collect()}


def test_zero_denominator_is_dropped(frame):
    raw = ix.raw_index_values(frame([("2024-01", 0, 1, 0, 0, 0, 0), ("2024-02", 10, 5, 3, 1, 0, 0)], COUNTS))
    rows = raw.collect()
    assert [r["month"] for r in rows] == ["2024-02"]
    assert rows[0]["raw_ratio_cpu"] == 0.5 and rows[0]["cpu_direction"] == 0.5


@pytest.mark.parametrize("base, expected", [
    ((None, None), {"a": 50.0, "b": 150.0}),
    (("2024-01", None), {"a": 50.0, "b": 150.0}),
    (("2024-01", "2024-01"), {"a": 100.0, "b": 300.0}),
    (("2030-01", "2030-02"), {"a": 50.0, "b": 150.0}),
])
def test_base_period(frame, base, expected):
    raw = ix.raw_index_values(frame([("2024-01", 10, 1, 0, 0, 0, 0), ("2024-02", 10, 3, 0, 0, 0, 0)], COUNTS))
    got = series(ix.normalize_index(raw, *base), "normalized_cpu")
    assert got == pytest.approx({"2024-01": expected["a"], "2024-02": expected["b"]})


def test_all_zero_base_falls_back_and_zero_series_is_zero(frame):
    raw = ix.raw_index_values(frame([("2024-01", 10, 0, 0, 0, 0, 0), ("2024-02", 10, 4, 0, 0, 0, 0)], COUNTS))
    got = ix.normalize_index(raw, "2024-01", "2024-01")
    assert series(got, "normalized_cpu") == {"2024-01": 0.0, "2024-02": 200.0}
    assert series(got, "normalized_impl") == {"2024-01": 0.0, "2024-02": 0.0}


def test_outlet_steps(frame):
    panel = frame([
        ("A", "2024-01", 1, 2), ("A", "2024-02", 2, 2), ("A", "2024-03", 3, 0),
        ("B", "2024-01", 1, 4),
    ], "outlet string, month string, numerator bigint, denominator bigint")
    ratio = ou.outlet_ratio(panel)
    assert {(r["outlet"], r["month"]): r["value"] for r in ratio.collect()} == {
        ("A", "2024-01"): 0.5, ("A", "2024-02"): 1.0, ("A", "2024-03"): 0.0, ("B", "2024-01"): 0.25}
    averaged = series(ou.average_outlets(ratio))
    assert averaged == {"2024-01": 0.375, "2024-02": 1.0, "2024-03": 0.0}
    constant = ou.standardize(ou.outlet_ratio(panel.where("outlet = 'B'")))
    assert constant.first()["value"] == 0.0


def test_base_normalize_rules(frame):
    values = frame([("2024-01", 0.5), ("2024-02", 1.0), ("2024-03", 1.5), ("2024-04", 2.0)],
                   "month string, value double")
    got = series(ou.base_normalize(values, "2024-01", "2024-02"))
    assert got == pytest.approx({"2024-01": 66.6667, "2024-02": 133.3333, "2024-03": 200, "2024-04": 266.6667}, abs=1e-3)
    assert series(ou.base_normalize(values, "2030-01", "2030-02")) == {
        "2024-01": 0.5, "2024-02": 1.0, "2024-03": 1.5, "2024-04": 2.0}
    balanced = frame([("2024-01", -1.0), ("2024-02", 1.0), ("2024-03", 3.0)], "month string, value double")
    assert set(series(ou.base_normalize(balanced, "2024-01", "2024-02")).values()) == {0.0}


def test_outlet_exclusion_ignores_case(frame):
    panel = frame([("New York Times", "m", 1, 2), ("X", "m", 1, 2), (None, "m", 1, 2)],
                  "outlet string, month string, numerator bigint, denominator bigint")
    assert {r["outlet"] for r in ou.drop_outlets(panel, ["new york TIMES"]).collect()} == {"X", None}
    assert {r["outlet"] for r in ou.keep_outlets(panel).collect()} == {"New York Times"}


def test_correlation_pairs_and_matrix(frame):
    rows = [(o, f"2024-0{m}", float(v)) for o, vs in {
        "A": [1, 2, 3], "B": [2, 4, 6], "C": [5, 5, 5], "D": [1]}.items() for m, v in enumerate(vs, 1)]
    values = frame(rows, "outlet string, month string, value double")
    pairs = {(r["outlet1"], r["outlet2"]): r["correlation"] for r in ou.outlet_correlations(values).collect()}
    assert pairs[("A", "B")] == pytest.approx(1.0)
    assert pairs[("A", "C")] is None and ("A", "D") not in pairs
    matrix = {(r["outlet1"], r["outlet2"]): r["correlation"] for r in ou.outlet_correlations(values, True).collect()}
    assert len(matrix) == 16 and matrix[("A", "D")] is None


def test_pearson_ignores_half_known_rows(frame):
    df = frame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (9.0, None), (None, 7.0)], "x double, y double")
    assert df.agg(pearson(F.col("x"), F.col("y"))).first()[0] == pytest.approx(0.5)


def test_full_index_anchors_on_main_type(frame):
    values = ix.build_index(frame([("2024-01", 10, 2, 1, 1, 3, 0), ("2024-02", 10, 4, 1, 2, 0, 5)], COUNTS))
    extra = values.where("index_type = 'CPU_impl'").withColumn("month", F.lit("2024-09"))
    rows = {r["month"]: r for r in ix.full_index(values.unionByName(extra.limit(1))).collect()}
    assert set(rows) == {"2024-01", "2024-02"}
    assert rows["2024-01"]["salience_ira"] == 3 and rows["2024-02"]["salience_obbba"] == 5


def test_peaks_and_summary(frame):
    values = frame([("CPU", f"2024-0{m}", v) for m, v in enumerate([10.0, None, 30.0, 30.0, 0.0], 1)],
                   "index_type string, month string, normalized double")
    peaks = {(r["side"], r["rank"]): r["month"] for r in ix.index_peaks(values).collect()}
    assert [peaks[("peak", k)] for k in (1, 2, 3)] == ["2024-03", "2024-04", "2024-01"]
    assert [peaks[("trough", k)] for k in (1, 2, 3)] == ["2024-02", "2024-05", "2024-01"]
    row = ix.index_summary(values).first()
    assert (row["num_months"], row["mean"], row["min"], row["max"]) == (5, 23.3, 10.0, 30.0)


@pytest.mark.parametrize("value, text", [
    (None, ""), (float("nan"), ""), (100.0, "100"), (98.5, "98.5"), (98.456, "98.46"), (-0.25, "-0.25"),
    (12345678.9, "12345678.9"), (0.0, "0"),
])
def test_format_value(frame, value, text):
    assert frame([(value,)], "v double").select(format_value(F.col("v"))).first()[0] == text


def test_exports(spark, frame, tmp_path):
    values = ix.build_index(frame([("2024-01", 10, 2, 1, 1, 3, 0), ("2024-02", 10, 4, 1, 2, 0, 5)], COUNTS))
    outlet = frame([("A", "2024-01", 98.5), ("B", "2024-02", 100.0)], "outlet string, month string, value double")
    paths = ex.export_all(ix.full_index(values), outlet, ["A", "B"], str(tmp_path / "csv"))
    assert len(paths) == 4
    wide = spark.read.option("header", True).csv(paths[3]).orderBy("date").collect()
    assert [tuple(r) for r in wide] == [("2024-01", "98.5", None), ("2024-02", None, "100")]
    assert ex.export_index(values, str(tmp_path / "all"), index_types=["CPU"]) == 2
    with pytest.raises(ValueError):
        ex.export_index(values.limit(0), str(tmp_path / "none"))


def test_raw_counts_prefers_counts_table(frame):
    table = frame([("2024-01", 5, 1, 1, 0)],
                  "month string, denominator bigint, numerator_cpu bigint, numerator_impl bigint, numerator_reversal bigint")
    articles = frame([("2024-02", 10, 4, 1, 2, 3, 5)], COUNTS)
    assert ix.raw_counts(table, articles).first()["month"] == "2024-01"
    row = ix.raw_counts(table.limit(0), articles).first()
    assert (row["month"], row["ira_count"]) == ("2024-02", 3)
