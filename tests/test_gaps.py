"""Interval joins, nearest neighbours and model inputs against plain versions."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import features, joins

D = dt.date


def test_rows_in_spans_equal_every_pair_tested(frame):
    rng = random.Random(4)
    day = lambda: D(1969, 11, 1) + dt.timedelta(days=rng.randint(0, 400))
    rows = [(rng.choice("abc"), day(), i) for i in range(300)] + [("a", None, 900), (None, D(1970, 1, 1), 901)]
    spans = [(rng.choice("abcd"), day(), day()) for _ in range(25)] + [("b", None, D(1970, 5, 1)), ("c", D(1970, 2, 1), D(1970, 2, 1))]
    df, sp = frame(rows, "code string, day date, id int"), frame(spans, "code string, gap_start date, gap_end date")
    expected = sorted(i for c, d, i in rows if d and any(c == k and a and z and a <= d <= z for k, a, z in spans))
    for width in (1, 7, 32, 1000):
        got = joins.in_spans(df, "day", sp, "gap_start", "gap_end", ["code"], width)
        assert sorted(r.id for r in got.collect()) == expected and got.columns == df.columns


def test_a_long_span_is_a_few_bins(frame):
    df = frame([("a", D(2000, 1, 1), 1)], "code string, day date, id int")
    span = frame([("a", D(1900, 1, 1), D(2100, 1, 1))], "code string, s date, e date")
    found = joins.in_spans(df, "day", span, "s", "e", ["code"])
    assert found.count() == 1
    # 73,050 days
    width = F.floor(F.date_diff(F.col("e"), F.col("s")) / 32)
    assert span.select(width).first()[0] < 2300


def plain_neighbours(pdf, columns, k):
    out = pdf.copy().reset_index(drop=True)
    for i, r in out.iterrows():
        for c in columns:
            if np.isnan(pdf[c].iloc[i]):
                season = pdf[(pdf["code"] == r["code"]) & (pdf["month"] == r["month"])]
                found = []
                for _, o in season.sort_values("date").iterrows():
                    both = [x for x in columns if not np.isnan(pdf[x].iloc[i]) and not np.isnan(o[x])]
                    if not np.isnan(o[c]) and both:
                        found.append((sum((pdf[x].iloc[i] - o[x]) ** 2 for x in both) / len(both), o["date"], o[c]))
                found = sorted(found, key=lambda f: f[:2])[:k]
                donors = season[c].dropna()
                out.loc[i, c] = np.mean([f[2] for f in found]) if found else donors.mean() if len(donors) else np.nan
    return out


def test_nearest_neighbours_equal_a_plain_search(spark):
    rng = np.random.default_rng(3)
    rows = []
    for code in ("a", "b"):
        for y in range(4):
            for m in (1, 2):
                for d in range(1, 8):
                    x = [None if rng.random() < 0.3 else float(np.round(v, 1)) for v in rng.normal(5, 2, 3)]
                    rows.append((code, D(2000 + y, m, d), *x, "kept"))
    # a season without a donor, and a row that shares nothing
    rows += [("c", D(2000, 1, 1), None, 1.0, 2.0, "kept"), ("c", D(2001, 1, 1), None, 2.0, None, "kept"), ("a", D(2009, 1, 1), None, None, None, "kept")]
    df = spark.createDataFrame(rows, "code string, date date, p double, q double, r double, note string")
    got = features.impute_knn(df, ["p", "q", "r"], neighbours=3)
    assert got.columns == df.columns
    pdf = pd.DataFrame(rows, columns=df.columns).astype(dict.fromkeys("pqr", float))
    pdf["month"] = [d.month for d in pdf["date"]]
    expected = {(r.code, r.date): (r.p, r.q, r.r) for r in plain_neighbours(pdf, ["p", "q", "r"], 3).itertuples()}
    for r in got.collect():
        for a, b in zip((r.p, r.q, r.r), expected[r.code, r.date], strict=True):
            assert (a is None and np.isnan(b)) or a == pytest.approx(b)


def test_model_window_flags_and_plan(frame):
    end = D(2001, 6, 15)
    days = [end - dt.timedelta(days=k) for k in range(30)]
    rows = [("whole", d, 1.0) for d in days] + [("tail", d, 2.0) for d in days[4:]] + [("inner", d, float(i)) for i, d in enumerate(days) if i not in (5, 6)]
    rows += [("saved", d, 3.0) for d in days[2:]] + [("old", D(1990, 1, 1), 1.0)]
    daily = frame(rows, "code string, date date, discharge double")
    made = frame([("saved", days[0], days[3], 9.0), ("saved", days[0], days[2], 8.0), ("new", days[0], days[2], 1.0)], "code string, date date, forecast_date date, Q50 double")
    out = features.model_input_window(daily, made, end, 20, 5, 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.code, {})[r.date] = (r.discharge, r.flag)
    assert set(got) == {"whole", "tail", "inner", "saved", "old"} and all(len(v) == 22 for v in got.values())
    assert {c: v[end][1] for c, v in got.items()} == {"whole": 0, "tail": 1, "inner": 0, "saved": 0, "old": 1}
    # the newest forecast fills its day, the day after the last known one is carried forward
    assert got["saved"][end][0] == 8.0 and got["saved"][days[1]][0] == 5.5 and got["inner"][days[5]][0] == pytest.approx(5.0)
    assert got["tail"][end][0] is None
    # adaptive execution shows the final plan before the first one
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan
    asked = frame([("whole",), ("unknown",)], "code string")
    some = features.model_input_window(daily, made, end, 20, 5, 3, stations=asked)
    assert {(r.code, r.flag) for r in some.collect()} == {("whole", 0), ("unknown", 1)}


def test_flags_of_forecasts_and_hindcasts(frame):
    made = frame([("a", D(2024, 1, 2), 1.0, 2.0), ("b", D(2024, 1, 2), None, 2.0), ("b", D(2024, 1, 3), 1.0, 2.0)], "code string, date date, Q5 double, Q95 double")
    stations = frame([("a",), ("b",), ("c",)], "code string")
    got = sorted((r.code, r.date, r.Q5, r.flag) for r in features.forecast_flags(stations, made, ["Q5", "Q95"], "2024-01-01").collect() if r.code != "b")
    assert got == [("a", D(2024, 1, 2), 1.0, 0), ("c", D(2024, 1, 1), None, 2)]
    assert {r.flag for r in features.forecast_flags(stations, made, ["Q5", "Q95"], "2024-01-01").where("code = 'b'").collect()} == {1}
    assert sorted(r.flag for r in features.hindcast_flags(made, ["Q5", "Q95"]).collect()) == [3, 4, 4]
