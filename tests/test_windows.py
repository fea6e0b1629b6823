import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import windows as win

D = dt.date

START = dt.date(2022, 1, 1)


def series(values, code="1", start=START, step=1):
    return [(code, start + dt.timedelta(days=i * step), v) for i, v in enumerate(values)]


SCHEMA = "code string, date date, discharge double"


@pytest.fixture(scope="module")
def ramp(frame):
    """One year in which the value is the day of the month."""
    days = [START + dt.timedelta(days=i) for i in range(365)]
    return frame([("1", d, float(d.day)) for d in days], SCHEMA)


def value_on(df, column, month, day):
    return df.where(F.col("date") == dt.date(2022, month, day)).first()[column]


def test_next_pentad_average_of_the_ramp(ramp):
    out = win.next_period_avg(win.add_issue_date(ramp, "pentad"), "pentad").cache()
    assert value_on(out, "discharge_avg", 1, 5) == 8.0
    assert value_on(out, "discharge_avg", 1, 10) == 13.0
    assert value_on(out, "discharge_avg", 12, 25) == 28.5
    assert value_on(out, "discharge_avg", 2, 25) == 27.0
    assert value_on(out, "discharge_avg", 1, 6) is None


def test_next_decad_average_and_predictor(ramp):
    out = win.next_period_avg(win.add_issue_date(ramp, "decad"), "decad")
    out = win.previous_issue_value(out).cache()
    assert value_on(out, "discharge_avg", 1, 10) == 15.5
    assert value_on(out, "discharge_avg", 1, 20) == 26.0
    assert value_on(out, "predictor", 1, 20) == 15.5
    assert value_on(out, "predictor", 1, 10) is None


def test_three_day_sum_skips_missing_days(frame):
    rows = [("1", dt.date(2022, 1, d), float(d)) for d in (1, 3, 5)]
    out = win.three_day_sum(win.add_issue_date(frame(rows, SCHEMA), "pentad"))
    assert [r.discharge_sum for r in out.orderBy("date").collect()] == [None, None, 8.0]


def gappy(seed, n=80):
    rng = random.Random(seed)
    values = [None if rng.random() < 0.45 else round(rng.uniform(1, 50), 2) for _ in range(n)]
    return values


def fetch(df):
    return [r.discharge for r in df.orderBy("date").collect()]


def same(got, expected):
    np.testing.assert_allclose(
        [np.nan if v is None else v for v in got], np.asarray(expected, dtype=float), rtol=1e-9
    )


@pytest.mark.parametrize("seed", range(4))
def test_interpolation_agrees_with_pandas(frame, seed):
    values = gappy(seed)
    df = frame(series(values), SCHEMA)
    s = pd.Series([np.nan if v is None else v for v in values])
    same(fetch(win.interpolate(df, "discharge", limit=3, both=True)), s.interpolate(method="linear", limit=3, limit_direction="both"))
    same(fetch(win.interpolate(df, "discharge")), s.interpolate(method="linear"))
    timed = pd.Series(s.values, index=pd.date_range("2022-01-01", periods=len(s)))
    same(fetch(win.interpolate(df, "discharge", limit=2, by_time=True)), timed.interpolate(method="time", limit=2))


def test_interpolation_over_time_uses_day_distances(frame):
    rows = [("1", dt.date(2022, 1, 1), 0.0), ("1", dt.date(2022, 1, 2), None), ("1", dt.date(2022, 1, 11), 10.0)]
    assert fetch(win.interpolate(frame(rows, SCHEMA), "discharge", by_time=True)) == [0.0, 1.0, 10.0]
    assert fetch(win.interpolate(frame(rows, SCHEMA), "discharge")) == [0.0, 5.0, 10.0]


def test_daily_reindex_fills_every_day_once(frame):
    rows = series([1.0, 2.0, 3.0], step=4) + series([7.0], code="2")
    out = win.daily_reindex(frame(rows, SCHEMA)).orderBy("code", "date").collect()
    assert [r.discharge for r in out] == [1.0, None, None, None, 2.0, None, None, None, 3.0, 7.0]
    assert [r.date for r in out[:9]] == [START + dt.timedelta(days=i) for i in range(9)]


def test_seasonal_filter_keeps_seasons_and_drops_spikes(frame):
    rows = []
    for year in (2020, 2021):
        for i in range(365):
            day = dt.date(year, 1, 1) + dt.timedelta(days=i)
            rows.append(("1", day, (200.0 if day.month in (6, 7, 8) else 5.0) + i % 7))
    rows[10] = ("1", rows[10][1], 900.0)
    out = win.seasonal_iqr_filter(frame(rows, SCHEMA))
    dropped = out.where("discharge is null").collect()
    assert [r.date for r in dropped] == [rows[10][1]]


def test_rough_filter_bridges_short_gaps_only(frame):
    days = [0, 1, 4, 5, 12, 13]
    rows = [("1", START + dt.timedelta(days=d), 10.0 + d / 100) for d in days]
    out = win.rough_outlier_filter(frame(rows, SCHEMA)).orderBy("date").collect()
    known = {i for i, r in enumerate(out) if r.discharge is not None}
    # two days per pass from the left edge: the seven-day gap 6..11 keeps its last two days
    assert known == set(range(14)) - {10, 11}


def test_gaps_cover_exactly_the_missing_days(frame):
    rng = random.Random(3)
    rows, missing = [], 0
    for code in ("a", "b", "c"):
        present = sorted(rng.sample(range(200), 120))
        missing += present[-1] - present[0] + 1 - len(present)
        rows += [(code, START + dt.timedelta(days=d), 1.0) for d in present]
    gaps = win.detect_gaps(frame(rows, SCHEMA), "2022-12-31", 5000)
    total = gaps.agg(F.sum(F.datediff("gap_end", "gap_start") + 1)).first()[0]
    assert total == missing


def brute_islands(gaps):
    out, end = [], None
    for start, stop, code in sorted(gaps):
        if end is None or start > end + dt.timedelta(days=1):
            out.append([start, stop, set()])
        out[-1][1] = max(out[-1][1], stop)
        out[-1][2].add(code)
        end = out[-1][1]
    return out


def test_gap_batches_match_a_sequential_merge(frame):
    rng = random.Random(5)
    gaps = []
    for code in range(300):
        start = START + dt.timedelta(days=rng.choice([3, 3, 3, rng.randrange(400)]))
        gaps.append((str(10000 + code), start, start + dt.timedelta(days=rng.randrange(4))))
    df = frame(gaps, "code string, gap_start date, gap_end date")
    batches = win.group_gaps(df, batch_size=30).collect()
    assert all(1 <= len(b.sites) <= 30 for b in batches)
    islands = brute_islands([(a, b, c) for c, a, b in gaps])
    found = {}
    for b in batches:
        found.setdefault(b.island, []).append(b)
    assert len(found) == len(islands)
    for parts, (start, stop, codes) in zip([found[k] for k in sorted(found)], islands):
        assert min(p.start_date for p in parts) == start and max(p.end_date for p in parts) == stop
        listed = [s for p in sorted(parts, key=lambda p: p.batch) for s in p.sites]
        assert listed == sorted(codes)
        assert len(parts) == -(-len(codes) // 30)


def test_rolling_statistics_agree_with_pandas(frame):
    values = gappy(9)
    s = pd.Series([np.nan if v is None else v for v in values])
    df = frame(series(values), SCHEMA)
    specs = {"discharge": [(op, [7]) for op in ("mean", "sum", "min", "max", "std")]}
    out = win.rolling_features(df, specs).orderBy("date").toPandas()
    rolled = s.rolling(7, min_periods=3)
    for op in ("mean", "sum", "min", "max", "std"):
        np.testing.assert_allclose(out[f"discharge_roll_{op}_7"].to_numpy(float), getattr(rolled, op)().to_numpy(), rtol=1e-9)


def test_rolling_shapes(frame):
    values = [1.0, 5.0, 2.0, 5.0, 4.0, 3.0, 9.0, 1.0]
    s = pd.Series(values)
    df = frame(series(values), SCHEMA)
    ops = ("slope", "peak_to_peak", "median_abs_deviation", "time_distance_from_peak")
    out = win.rolling_features(df, {"discharge": [(o, [4]) for o in ops]}).orderBy("date").toPandas()
    roll = s.rolling(4, min_periods=2)
    expected = {
        "slope": roll.apply(lambda x: np.polyfit(np.arange(len(x)), x, 1)[0], raw=True),
        "peak_to_peak": roll.apply(lambda x: x.max() - x.min(), raw=True),
        "median_abs_deviation": roll.apply(lambda x: np.median(np.abs(x - np.median(x))), raw=True),
        "time_distance_from_peak": roll.apply(lambda x: len(x) - np.argmax(x), raw=True),
    }
    for op, e in expected.items():
        np.testing.assert_allclose(out[f"discharge_roll_{op}_4"].to_numpy(float), e.to_numpy(), atol=1e-9)


def test_target_is_a_shifted_rolling_mean(frame):
    values = [float(i) for i in range(30)]
    df = frame(series(values), SCHEMA)
    out = win.target_future_mean(df, "discharge", 5, 8).orderBy("date").toPandas()["target"].to_numpy(float)
    expected = pd.Series(values).rolling(5, min_periods=3).mean().shift(-8).to_numpy()
    np.testing.assert_allclose(out, expected)


def test_forward_fill_does_not_cross_stations(frame):
    rows = series([1.0, None, None]) + series([None, 2.0, None], code="2")
    df = frame(rows, SCHEMA)
    got = [r.discharge for r in win.ffill(df, "discharge").orderBy("code", "date").collect()]
    assert got == [1.0, 1.0, 1.0, None, 2.0, 2.0]
    inner = series([1.0, None, 3.0, None])
    tail = win.ffill(frame(inner, SCHEMA), "discharge", trailing_only=True)
    assert fetch(tail) == [1.0, None, 3.0, 3.0]


def test_second_earliest_start(frame):
    last = frame([("a", dt.date(2020, 1, 1)), ("b", dt.date(2024, 1, 1)), ("c", dt.date(2024, 2, 1))], "code string, last_date date")
    assert win.hindcast_start(last).first().start_date == dt.date(2024, 1, 2)
    sites = frame([("z",)], "code string")
    assert win.hindcast_start(last, sites, "2019-01-01").first().start_date == dt.date(2020, 1, 2)
    two = frame([("y",), ("z",)], "code string")
    assert win.hindcast_start(last, two, "2019-01-01").first().start_date == dt.date(2020, 1, 2)
    assert win.hindcast_start(last, two).first().start_date is None
    assert win.hindcast_start(last.limit(0), None, "2019-01-01").first().start_date == dt.date(2019, 1, 1)


def test_repeated_days_with_nulls_and_zero_divisors(frame):
    from freshet.operators import aggregates, features

    rows = [("1", "P", D(2024, 1, 1), 1.0, 0), ("1", "P", D(2024, 1, 2), 2.0, 0), ("1", "P", D(2024, 1, 2), None, 1), ("1", "P", D(2024, 1, 2), 3.0, 2)]
    df = frame(rows, "code string, variable string, date date, value double, arrival int")
    got = {r.date: r.value for r in win.station_iqr_filter(df, order="arrival").collect()}
    assert got == {D(2024, 1, 1): 1.0, D(2024, 1, 2): 3.0}
    flat = frame([("1", D(2024, 1, i), 5.0, float(i)) for i in (1, 2, 3)], "code string, date date, x double, target double")
    assert features.feature_correlation(flat, ["x"], "target", ["code"]).count() == 0
    assert features.feature_correlation(flat, ["target"], "target", ["code"]).first().abs_corr == 1.0
    scalers = frame([("1", "x", 5.0, 0.0)], "code string, feature string, mean double, std double")
    assert [r.x for r in features.scale_with(flat, scalers, ["x"]).collect()] == [None] * 3
    bands = frame([("1", 1, 0.0), ("1", 2, 0.0)], "code string, band int, area double")
    assert [r.percentile_band for r in aggregates.elevation_bands(bands).collect()] == [None] * 2
