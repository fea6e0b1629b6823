import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import features, hydrograph, models, regression

SCHEMA = "code string, date date, issue_date boolean, issue_period int, target_period int, predictor double, discharge_avg double"


def sample(seed=4, years=12):
    rng = random.Random(seed)
    rows = []
    for code in ("A", "B"):
        for period in (1, 2):
            for year in range(2000, 2000 + years):
                x = round(rng.uniform(10, 90), 2)
                y = None if rng.random() < 0.2 else round(0.3 * x + rng.uniform(0, 5), 3)
                rows.append((code, dt.date(year, 1, 5 * period), True, period, period + 1, x, y))
    return rows


def test_exact_line(frame):
    rows = [(c, dt.date(y, 1, 5), True, 1, 2, 100.0 * (y - 1999) + k, (100.0 * (y - 1999) + k) / 10) for k, c in enumerate("ABC") for y in (2000, 2001, 2002)]
    for r in regression.fit_period_regression(frame(rows, SCHEMA)).collect():
        assert r.slope == pytest.approx(0.1) and r.intercept == pytest.approx(0, abs=1e-9) and r.rsquared == pytest.approx(1)


def test_two_points_are_not_enough(frame):
    rows = [("A", dt.date(y, 1, 5), True, 1, 2, float(y), float(y)) for y in (2000, 2001)]
    r = regression.fit_period_regression(frame(rows, SCHEMA)).first()
    assert (r.slope, r.intercept, r.q_mean, r.delta, r.rsquared) == (None,) * 5


@pytest.mark.parametrize("parity", [False, True])
def test_hindcast_equals_a_loop_over_issue_dates(frame, parity):
    rows = sample()
    out = regression.hindcast_regression(frame(rows, SCHEMA), parity=parity).collect()
    assert len(out) == len(rows)
    for r in out:
        past = [(x, y) for c, d, _, p, _, x, y in rows if c == r.code and p == r.issue_period and y is not None and (d < r.date or parity and d == r.date)]
        if len(past) <= 2:
            assert r.slope is None and r.forecasted_discharge is None
            continue
        x, y = np.array(past).T
        slope, intercept = np.polyfit(x, y, 1)
        assert r.slope == pytest.approx(slope) and r.intercept == pytest.approx(intercept)
        assert r.forecasted_discharge == pytest.approx(slope * r.predictor + intercept)
        assert r.delta == pytest.approx(0.674 * y.std())


def test_hidden_years_leave_the_fit(frame):
    rows = sample()
    marks = [("A", 1, y, y % 2 == 0) for y in range(2000, 2012)]
    selection = frame(marks, "code string, issue_period int, year int, visible boolean")
    fits = {(r.code, r.issue_period): r for r in regression.point_selected_regression(frame(rows, SCHEMA), selection).collect()}
    kept = [(x, y) for c, d, _, p, _, x, y in rows if c == "A" and p == 1 and y is not None and d.year % 2 == 0]
    x, y = np.array(kept).T
    assert fits["A", 1].slope == pytest.approx(np.polyfit(x, y, 1)[0])
    whole = {(r.code, r.issue_period): r for r in regression.fit_period_regression(frame(rows, SCHEMA)).collect()}
    assert fits["B", 1].slope == pytest.approx(whole["B", 1].slope)


def test_predictor_looks_back_when_days_are_missing(frame):
    daily = frame([("1", dt.date(2024, 5, 3), 10.0), ("1", dt.date(2024, 5, 4), 12.0), ("2", dt.date(2024, 4, 28), 7.0), ("3", dt.date(2024, 4, 1), 9.0)], "code string, date date, discharge double")
    morning = frame([("1", dt.datetime(2024, 5, 5, 8), 14.0)], "code string, ts timestamp, value double")
    out = {r.code: r.predictor for r in regression.predictor_from_readings(daily, morning, "2024-05-05").collect()}
    assert out["1"] == 36.0
    assert out["2"] == 7.0 * 2 + 7.0
    assert "3" not in out
    mean = {r.code: r.predictor for r in regression.predictor_from_readings(daily, morning, "2024-05-05", mean=True).collect()}
    assert mean["1"] == 12.0


def test_period_hydrograph_excludes_the_current_year(frame):
    rows = [("A", dt.date(y, 1, 5), True, 1, 2, 1.0, float(v)) for y, v in ((2019, 1), (2020, 2), (2021, 3), (2022, 4), (2023, 100))]
    norms = frame([("A", [float(i) for i in range(72)])], "code string, norms array<double>")
    r = hydrograph.period_hydrograph(frame(rows, SCHEMA), "pentad", 2023, norms).first()
    values = np.array([1, 2, 3, 4.0])
    assert (r["mean"], r["min"], r["max"], r.last_year, r.current_year, r.norm) == (2.5, 1.0, 4.0, 4.0, 100.0, 1.0)
    assert [r.q05, r.q25, r.q75, r.q95] == pytest.approx(list(np.quantile(values, [0.05, 0.25, 0.75, 0.95])))
    assert r.date == dt.date(2023, 1, 5) and r.pentad_in_month == 2 and r.day_of_year == 5


def test_shown_date_is_last_years_moved_on(frame):
    # 2024 is a leap year: period 13 was issued on 2023-02-28, period 14 on 2023-03-05
    rows = [("A", d, True, p - 1, p, 1.0, 1.0) for d, p in (
        (dt.date(2023, 2, 28), 13), (dt.date(2023, 3, 5), 14), (dt.date(2023, 12, 31), 1), (dt.date(2022, 1, 5), 2))]
    out = {r.pentad_in_year: (r.date, r.day_of_year) for r in hydrograph.period_hydrograph(frame(rows, SCHEMA), "pentad", 2024).collect()}
    assert out == {13: (dt.date(2024, 2, 28), 59), 14: (dt.date(2024, 3, 5), 65), 1: (dt.date(2024, 12, 31), 366), 2: (dt.date(2024, 1, 5), 5)}


def test_norms_of_the_wrong_length_are_unknown(frame):
    norms = frame([("A", [1.0] * 71)], "code string, norms array<double>")
    assert hydrograph.explode_norms(norms, "pentad").count() == 0


def test_daily_hydrograph_of_a_leap_year(spark):
    span = F.sequence(F.lit("2019-01-01").cast("date"), F.lit("2020-12-31").cast("date"))
    days = spark.range(1).select(F.lit("A").alias("code"), F.explode(span).alias("date"))
    df = days.withColumn("discharge", F.dayofyear("date").cast("double"))
    out = {r.day_of_year: r for r in hydrograph.daily_hydrograph(df, 2020).collect()}
    assert sorted(out) == list(range(1, 367))
    assert out[59].date == dt.date(2020, 2, 28) and out[60].date == dt.date(2020, 2, 29)
    assert out[60]["mean"] == out[59]["mean"] and out[59]["count"] == 3
    assert out[366]["count"] == 2
    assert all(r["min"] <= r.q05 <= r.q25 <= r.q50 <= r.q75 <= r.q95 <= r["max"] for r in out.values())


def test_fourier_climatology_equals_least_squares(spark, frame):
    rng = np.random.default_rng(0)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=int(i)) for i in range(0, 700, 3)]
    y = 10 + rng.normal(size=len(days))
    df = frame([("A", d, float(v)) for d, v in zip(days, y)], "code string, date date, discharge double")
    out = features.fourier_climatology(df, "discharge", 2).orderBy("date").toPandas()
    doy = np.array([d.timetuple().tm_yday for d in days])
    angle = 2 * np.pi / 365.25 * doy
    x = np.column_stack([np.ones(len(days))] + [f(i * angle) for i in (1, 2) for f in (np.cos, np.sin)])
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    np.testing.assert_allclose(out["discharge_climatology"], fitted, rtol=1e-6)
    np.testing.assert_allclose(out["discharge_anomaly"], y - fitted, atol=1e-6)


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso"])
def test_monthly_regression(frame, kind):
    rng = np.random.default_rng(3)
    rows = []
    for code in ("A", "B"):
        for year in range(2000, 2021):
            a, b = (float(v) for v in rng.uniform(0, 10, 2))
            rows.append((code, dt.date(year, 6, 15), 3 * a - b + 20, a, b))
            rows.append((code, dt.date(year, 6, 16), 999.0, a, b))
    df = frame(rows, "code string, date date, target double, P_1 double, T_1 double")
    out = models.monthly_regression(df, ["P_1", "T_1"], "2020-06-15", 2, kind, alpha=1e-6).collect()
    expected = {r[0]: r[2] for r in rows if r[1] == dt.date(2020, 6, 15)}
    for r in out:
        assert r.Q == pytest.approx(max(expected[r.code], 0), abs=0.02) and r.r2 > 0.999


def test_feature_selection(frame):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 200))
    rows = [("A", float(x), float(2 * x), float(z), float(3 * x + 0.01 * z)) for x, z in zip(a, b)]
    df = frame(rows, "code string, P_1 double, P_2 double, T_1 double, target double")
    assert features.correlated_features(df, ["P_1", "P_2", "T_1"]) == ["P_2"]
    assert features.select_k_best(df, ["T_1", "P_1"], "target", 1) == ["P_1"]
    assert features.pca_groups(df, {"P": ["P_1", "P_2"]}).columns.count("P_pc1") == 1
    top = features.top_features(features.feature_correlation(df, ["P_1", "P_2", "T_1"], "target", ["code"]), ["code"], 2)
    assert [r.feature.split("_")[0] for r in top.orderBy("rank").collect()] == ["P", "T"]
