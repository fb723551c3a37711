import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest

from newsgauge.functions import inference as inf
from newsgauge.operators import causality as ca
from newsgauge.operators import leadlag as ll
from newsgauge.operators import sector as sc
from newsgauge.operators import stationarity as st
import plain_series as ps


def month(k):
    return dt.date(2010 + k // 12, k % 12 + 1, 1)


def pairs(frame, groups):
    rows = [(g, month(k), float(a) if a is not None else None, float(b) if b is not None else None)
            for g, (x, y) in groups.items() for k, (a, b) in enumerate(zip(x, y))]
    return frame(rows, "g string, month date, s1 double, s2 double")


def noise(seed, n):
    return np.random.default_rng(seed).normal(size=n)


def test_ccf_against_pandas(frame):
    x, y = noise(1, 60), noise(2, 60)
    x[7] = np.nan
    df = pairs(frame, {"a": ([None if math.isnan(v) else v for v in x], y), "short": (x[:20], y[:20]),
                       "flat": ([1.0] * 30, y[:30])})
    got = ll.cross_correlation(df, ["g"]).collect()
    keep = ~np.isnan(x)
    sx, sy = pd.Series(x[keep]), pd.Series(y[keep])
    mine = {r["lag"]: r for r in got if r["g"] == "a"}
    assert sorted(mine) == list(range(-12, 13))
    for lag, row in mine.items():
        left = sx.iloc[:len(sx) - lag] if lag >= 0 else sx.iloc[-lag:]
        right = sy.iloc[lag:] if lag >= 0 else sy.iloc[:lag]
        assert row["n_observations"] == len(left)
        assert row["correlation"] == pytest.approx(left.reset_index(drop=True).corr(right.reset_index(drop=True)))
    assert mine[3]["interpretation"] == "series1_leads_by_3_periods"
    assert mine[-2]["interpretation"] == "series2_leads_by_2_periods"
    assert not [r for r in got if r["g"] == "short"]
    flat = [r for r in got if r["g"] == "flat"]
    assert len(flat) == 25 and all(r["interpretation"] == "insufficient_data" for r in flat)


def test_lag_beyond_the_series(frame):
    df = pairs(frame, {"a": (noise(1, 24), noise(2, 24))})
    rows = {r["lag"]: r["n_observations"] for r in ll.cross_correlation(df, ["g"], max_lag=30).collect()}
    assert len(rows) == 61 and rows[30] == 0 and rows[-24] == 0 and rows[23] == 1


def test_optimal_lag_finds_the_shift(frame):
    base = noise(3, 80)
    df = pairs(frame, {"lead": (base[2:], base[:-2]), "trail": (-base[:-3], base[3:])})
    best = {r["g"]: r for r in ll.optimal_lag(ll.cross_correlation(df, ["g"]), ["g"]).collect()}
    assert best["lead"]["optimal_lag"] == 2 and best["lead"]["lead_series"] == "series1"
    assert best["lead"]["direction"] == "positive"
    assert best["trail"]["optimal_lag"] == -3 and best["trail"]["direction"] == "negative"


def test_ties_take_the_smallest_lag(frame):
    ccf = frame([("a", -1, 0.5, 30), ("a", 2, -0.5, 30), ("a", 3, None, 30)],
                "g string, lag int, correlation double, n_observations bigint")
    row = ll.optimal_lag(ccf, ["g"], 0.6).first()
    assert (row["optimal_lag"], row["is_significant"]) == (-1, False)
    none = ll.optimal_lag(ccf.where("lag = 3"), ["g"]).first()
    assert (none["optimal_lag"], none["is_significant"], none["direction"]) == (None, False, None)


def test_significance_uses_first_lag(frame):
    ccf = frame([(-1, 0.4, 25), (0, 0.38, 100)], "lag int, correlation double, n_observations bigint")
    rows = {r["lag"]: r for r in ll.ccf_significance(ccf).collect()}
    assert rows[0]["bound"] == pytest.approx(1.959964 / 5) and rows[-1]["significant"] and not rows[0]["significant"]


# --- distributions: published table values ---------------------------------------------------------------


@pytest.mark.parametrize("value, df1, df2, p", [
    (4.9646, 1, 10, 0.05), (2.5252, 4, 60, 0.05), (3.6491, 4, 60, 0.01), (161.4476, 1, 1, 0.05), (0.0, 2, 9, 1.0),
])
def test_f_tail(value, df1, df2, p):
    assert inf.f_tail(value, df1, df2) == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize("tau, p", [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (5.0, 1.0), (-30.0, 0.0)])
def test_unit_root_p(tau, p):
    assert inf.unit_root_p(tau) == pytest.approx(p, abs=1.5e-3)


def test_critical_values():
    assert inf.unit_root_critical("5%", 100) == pytest.approx(-2.8909, abs=1e-3)


def test_unit_root_regression_without_lags():
    """With no lag terms the statistic is the t value of a simple regression of steps on levels."""
    y = noise(4, 400)
    tau, p, order, n = ps.unit_root_test(y)
    step, level = np.diff(y)[order:], y[order:-1]
    if order == 0:
        slope, intercept = np.polyfit(level, step, 1)
        residual = step - intercept - slope * level
        error = math.sqrt(residual @ residual / (n - 2) / ((level - level.mean()) ** 2).sum())
        assert tau == pytest.approx(slope / error)
    assert p < 0.01
    assert ps.unit_root_test(np.ones(50)) is None


def test_verdicts(frame):
    walk = np.cumsum(noise(5, 300))
    df = pairs(frame, {"noise": (noise(6, 300), noise(6, 300)), "walk": (walk, walk), "short": (walk[:10], walk[:10]),
                       "flat": ([2.0] * 40, [2.0] * 40)})
    rows = {r["g"]: r for r in st.stationarity(df, ["g"], "s1").collect()}
    assert rows["noise"]["conclusion"] == "stationary" and rows["noise"]["differencing_needed"] is False
    assert rows["walk"]["conclusion"] == "non_stationary" and rows["walk"]["differencing_needed"] is True
    assert "short" not in rows and rows["flat"]["conclusion"] is None
    ends = {r["g"]: r for r in st.make_stationary(df, ["g"], "s1").collect()}
    assert (ends["noise"]["differences_applied"], ends["noise"]["is_stationary"]) == (0, True)
    assert (ends["walk"]["differences_applied"], ends["walk"]["final_length"]) == (1, 299)
    assert (ends["short"]["differences_applied"], ends["short"]["is_stationary"]) == (1, False)


def test_series_come_back_differenced(frame):
    walk, steps = np.cumsum(noise(5, 300)), noise(6, 300)
    df = pairs(frame, {"noise": (steps, steps), "walk": (walk, walk), "short": (walk[:10], walk[:10]), "one": ([1.0], [1.0])})
    got = {}
    for r in st.stationary_series(df, ["g"], "s1").orderBy("month").collect():
        got.setdefault((r["g"], r["differences"]), []).append(r["value"])
    assert set(got) == {("noise", 0), ("walk", 1), ("short", 1)}
    assert np.allclose(got["noise", 0], steps) and np.allclose(got["walk", 1], np.diff(walk))
    assert np.allclose(got["short", 1], np.diff(walk[:10]))
    ladder = st.differencing_ladder(df.where("g = 'walk'"), ["g"], "s1", 3).orderBy("month").collect()
    assert [len(r["ladder"]) for r in ladder[:5]] == [1, 2, 3, 4, 4]
    assert np.allclose([r["ladder"][3] for r in ladder[3:]], np.diff(walk, 3))


def test_granger_direction(frame):
    x = noise(7, 200)
    y = np.r_[0.0, 0.9 * x[:-1]] + 0.3 * noise(8, 200)
    df = pairs(frame, {"xy": (x, y), "yx": (y, x), "none": (noise(9, 200), noise(10, 200)), "short": (x[:31], y[:31]),
                       "flat": ([1.0] * 60, y[:60])})
    rows = {r["g"]: r for r in ca.granger_panel(df, ["g"]).collect()}
    assert rows["xy"]["granger_causes"] and rows["xy"]["min_pvalue"] < 1e-6 and len(rows["xy"]["pvalues"]) == 4
    assert not rows["none"]["granger_causes"]
    assert rows["short"]["pvalues"] is None and not rows["flat"]["granger_causes"]
    both = {r["g"]: r["relationship"] for r in ca.granger_bidirectional(df, ["g"]).collect()}
    assert both["xy"] == "s1_causes_s2" and both["yx"] == "s2_causes_s1" and both["none"] == "no_granger_causality"


def test_granger_f_by_hand():
    rng = random.Random(2)
    x = np.array([rng.gauss(0, 1) for _ in range(40)])
    y = np.array([rng.gauss(0, 1) for _ in range(40)])
    target, own = y[1:], np.c_[np.ones(39), y[:-1]]
    joint = np.c_[own, x[:-1]]
    rss = [np.linalg.lstsq(m, target, rcond=None)[1][0] for m in (own, joint)]
    f = (rss[0] - rss[1]) / (rss[1] / 36)
    assert ps.granger_p_values(x, y, 1)[0] == pytest.approx(inf.f_tail(f, 1, 36))


def test_var_recovers_coefficients(frame):
    a = np.array([[0.5, 0.2], [-0.3, 0.4]])
    rng, data = np.random.default_rng(11), [np.zeros(2)]
    for _ in range(1500):
        data.append(a @ data[-1] + rng.normal(size=2))
    data = np.array(data)
    found = ps.fit_var(data, 4)
    # AIC may keep a superfluous lag, but never drops the true one
    assert found["order"] >= 1
    assert np.allclose(found["coefficients"][0], a, atol=0.08)
    df = pairs(frame, {"a": (data[:200, 0], data[:200, 1]), "short": (data[:20, 0], data[:20, 1])})
    rows = {r["g"]: r for r in ca.var_panel(df, ["g"], ["s1", "s2"]).collect()}
    assert rows["a"]["fitted"] and not rows["short"]["fitted"] and rows["short"]["aic"] is None
    with pytest.raises(ValueError):
        ca.var_panel(df, ["g"], ["s1", "nope"])


def test_panels_equal_direct_computations(frame):
    rng = np.random.default_rng(21)
    sets = {}
    for k in range(12):
        x = rng.normal(size=60 + 7 * k).cumsum() if k % 3 == 0 else rng.normal(size=60 + 7 * k)
        y = np.r_[0.0, 0.5 * x[:-1]] + rng.normal(size=len(x)) + (1e4 if k % 4 == 1 else 0)
        sets[f"k{k}"] = (x, y)
    df = pairs(frame, sets)
    granger = {r["g"]: r for r in ca.granger_panel(df, ["g"]).collect()}
    adf = {r["g"]: r for r in st.adf_panel(df, ["g"], "s2").collect()}
    var = {r["g"]: r for r in ca.var_panel(df, ["g"], ["s1", "s2"]).collect()}
    for g, (x, y) in sets.items():
        assert granger[g]["pvalues"] == pytest.approx(ps.granger_p_values(x, y, 4), abs=1e-9)
        # the direct computation needs a centred series where the level is far from zero
        tau, p, order, n = ps.unit_root_test(y - y.mean())
        assert (adf[g]["adf_lags"], adf[g]["adf_nobs"]) == (order, n)
        assert (adf[g]["adf_statistic"], adf[g]["adf_pvalue"]) == pytest.approx((tau, p), abs=1e-8)
        assert adf[g]["adf_crit_5"] == pytest.approx(inf.unit_root_critical("5%", n))
        found = ps.fit_var(np.c_[x, y], 4)
        assert (var[g]["optimal_lag"], var[g]["fitted"]) == (found["order"], True)
        assert (var[g]["aic"], var[g]["bic"]) == pytest.approx((found["aic"], found["bic"]), abs=1e-8)
        assert np.allclose(json.loads(var[g]["coefficients"]), found["coefficients"], atol=1e-7)


def test_series_that_explain_each_other(frame):
    """Redundant columns are skipped: a doubled series, a straight line, a periodic series."""
    x = noise(30, 80)
    df = pairs(frame, {"double": (x, 2 * x), "line": (np.arange(80.0), x), "wave": (np.arange(80) % 2 * 1.0, x)})
    granger = {r["g"]: r for r in ca.granger_panel(df, ["g"]).collect()}
    assert granger["double"]["pvalues"] is not None and not granger["double"]["granger_causes"]
    assert all(0 <= p <= 1 for r in granger.values() for p in r["pvalues"])
    assert not {r["g"]: r["fitted"] for r in ca.var_panel(df, ["g"], ["s1", "s2"]).collect()}["double"]
    assert st.adf_panel(df, ["g"], "s1").count() == 3


def test_report(frame):
    x = noise(12, 120)
    df = pairs(frame, {"a": (x, np.r_[0.0, x[:-1]] + 0.2 * noise(13, 120)), "short": (x[:10], x[:10]),
                       "walk": (np.cumsum(x), np.cumsum(noise(14, 120)))})
    rows = {r["g"]: r for r in ca.leadlag_report(df, ["g"]).collect()}
    assert rows["a"]["status"] == "success" and rows["a"]["optimal_lag"] == 1
    assert rows["a"]["granger_relationship"] == "s1_causes_s2" and rows["a"]["differenced"] is False
    assert rows["walk"]["differenced"] is True
    assert rows["short"]["status"] == "error" and rows["short"]["optimal_lag"] is None


# --- sectors ------------------------------------------------------------------------------------------------


COMPANY = "company_id string, last_financing_date date, total_raised double, judge_category string, ira_index double"


def companies(frame, n=40, short=False):
    rng, rows = random.Random(4), []
    for k in range(n):
        for sector, size in (("Energy", 3 + k % 5), ("Industry", 2 + (k * k) % 7), ("Others", 1), (None, 1)):
            rows += [(f"c{rng.randrange(50)}", month(k).replace(day=15), 1.0, sector, float(1 + rng.randrange(7)))] * size
    rows.append(("late", month(2).replace(day=1), None, "Rare", None))
    return frame(rows, COMPANY)


def index(frame, n=40):
    return frame([(month(k), 100.0 + 10 * (k % 5), 100.0 + (k * k) % 7, 100.0 + k % 3) for k in range(n)],
                 "month date, cpu_index double, cpu_impl double, cpu_reversal double")


def test_sector_ranking(frame):
    rows = sc.sector_ranking(companies(frame), index(frame), start_date="2010-01-01").collect()
    assert [r["sector"] for r in rows][0] == "Energy" and {r["sector"] for r in rows} == {"Energy", "Industry", "Rare"}
    first = rows[0]
    assert first["correlation"] == pytest.approx(1.0) and first["n_observations"] == 40
    assert first["interpretation"].startswith("Energy: ") and "r=1.000 (positive)" in first["interpretation"]
    with pytest.raises(ValueError):
        sc.sector_ranking(companies(frame), index(frame), metric="nonsense")


def test_sector_with_too_few_months(frame):
    rows = sc.sector_ranking(companies(frame, 12), index(frame, 12), start_date="2010-01-01").collect()
    assert all(r["correlation"] is None and r["n_observations"] == 12 for r in rows)


def test_decomposition_and_strata(frame):
    rows = {r["sector"]: r for r in sc.decomposition(companies(frame), index(frame), start_date="2010-01-01").collect()}
    assert rows["Industry"]["impl_correlation"] == pytest.approx(1.0)
    assert rows["Industry"]["dominant_type"] == "implementation"
    strata = sc.exposure_strata(companies(frame), index(frame), start_date="2010-01-01")
    assert {r["band"] for r in strata.collect()} == {"high", "low"}
    row = sc.exposure_comparison(strata).first()
    assert row["high_n_companies"] > 0 and row["difference"] is not None
    with pytest.raises(ValueError):
        sc.exposure_strata(companies(frame).drop("ira_index"), index(frame))


def test_agreement(frame):
    ranked = frame([(c, s, k) for c, order in {"A": "xyzw", "B": "xzyv", "C": "xwvy"}.items()
                    for k, s in enumerate(order, 1)], "classifier string, sector string, rank int")
    row = sc.classifier_agreement(ranked).first()
    assert (row["shared_sectors"], row["all_sectors"], row["agreement_score"]) == (1, 5, 0.2)
    assert sc.classifier_agreement(ranked.where("classifier = 'A'")).first()["agreement_score"] is None


def test_missing_classifier_is_left_out(frame):
    stacked = sc.stack_classifiers(companies(frame, 2), {"judge_category": "J", "absent": "A"})
    assert {r["classifier"] for r in stacked.collect()} == {"J"}
    with pytest.raises(ValueError):
        sc.stack_classifiers(companies(frame, 2), {"absent": "A"})
