"""Folds from yearly sums against fits on each fold's own rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from freshet.operators import folds, models

FEATURES = ["a", "b", "c", "d"]


def record(seed=1, stations=4, years=5, holes=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stations):
        for y in range(years):
            for k in range(12):
                a, b = rng.normal(10 * s, 1 + s), rng.normal(5, 2)
                c, d = 2 * a + rng.normal(0, 0.3), rng.normal(0, 1)
                target = 3 * a - b + 0.5 * d + rng.normal(0, 0.2) + 40 * s
                x = [None if rng.random() < holes else v for v in (a, b, c, d)]
                rows.append((f"s{s}", dt.date(2000 + y, k + 1, 3), *x, None if rng.random() < 0.05 else target))
    # a station of one year and one with a single row
    rows += [("lone", dt.date(2002, m, 1), 1.0, 2.0, 3.0, float(m), 4.0 + m) for m in range(1, 5)]
    rows.append(("one", dt.date(2003, 1, 1), 1.0, None, 3.0, 1.0, 9.0))
    return rows


SCHEMA = "code string, date date, a double, b double, c double, d double, target double"


def plain(rows, kind, alpha, impute, scale, groups=None, share=0.95):
    """One fold after the other with pandas and numpy."""
    df = pd.DataFrame(rows, columns=["code", "date", *FEATURES, "target"]).dropna(subset=["target"])
    df[FEATURES] = df[FEATURES].astype(float)
    if not impute:
        df = df.dropna(subset=FEATURES)
    year = pd.to_datetime(df["date"]).dt.year
    out = {}
    for y in sorted(year.unique()):
        train, test = df[year != y].copy(), df[year == y].copy()
        means = train[FEATURES].mean()
        train[FEATURES], test[FEATURES] = train[FEATURES].fillna(means), test[FEATURES].fillna(means)
        columns = [*FEATURES, "target"]
        mean = {c: train[columns].mean() for c in [None]}
        std = {None: pd.Series(1.0, columns)}
        if scale == "global":
            std = {None: train[columns].std().replace(0, 1).fillna(1)}
        key = lambda code: None
        if scale == "basin":
            key = lambda code: code
            mean = {c: g[columns].mean() for c, g in train.groupby("code")}
            std = {c: g[columns].std().replace(0, 1).fillna(1) for c, g in train.groupby("code")}
        test = test[[key(c) in mean for c in test["code"]]]
        if not len(test):
            continue
        z = np.array([((r[columns] - mean[key(r.code)]) / std[key(r.code)]).to_numpy(float) for _, r in train.iterrows()])
        t = np.array([((r[columns] - mean[key(r.code)]) / std[key(r.code)]).to_numpy(float) for _, r in test.iterrows()])
        z -= z.mean(axis=0)
        x, w, v = z[:, :-1], z[:, -1], t[:, :-1]
        axes = folds.basis(z.T @ z, [[FEATURES.index(c) for c in g] for g in (groups or {}).values()], share)
        x, v = x @ axes, v @ axes
        coef = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ w) if kind == "ridge" else np.linalg.lstsq(x, w, rcond=None)[0]
        for (_, r), p in zip(test.iterrows(), v @ coef, strict=True):
            out[r.code, r.date] = mean[key(r.code)]["target"] + std[key(r.code)]["target"] * p
    return out


@pytest.mark.parametrize("kind, impute, scale, groups", [
    ("linear", False, None, None), ("linear", True, "global", None), ("ridge", True, "basin", None), ("ridge", True, None, None),
    ("ridge", True, "basin", {"x": ["a", "c"]}), ("linear", True, "global", {"x": ["a", "b", "c"]}),
])
def test_folds_match_separate_fits(frame, kind, impute, scale, groups):
    rows = record()
    got = models.leave_one_year_out(frame(rows, SCHEMA), FEATURES, "target", kind, impute=impute, scale=scale, groups=groups, alpha=2.0)
    got = {(r.code, r.date): r.prediction for r in got.collect()}
    expected = plain(rows, kind, 2.0, impute, scale, groups)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-7, abs=1e-7)


def test_components_explain_the_asked_share():
    cross = np.diag([9.0, 0.9, 0.1])
    assert [folds.components(cross, s).shape[1] for s in (0.5, 0.95, 0.999)] == [1, 2, 3]
    assert folds.components(np.zeros((2, 2)), 0.9).shape == (2, 1)


def test_dependent_and_constant_columns(frame):
    rows = [("s", dt.date(2000 + y, m, 1), float(m), 7.0, 2.0 * m, None, 3.0 * m + y * 0) for y in range(3) for m in range(1, 7)]
    got = models.leave_one_year_out(frame(rows, SCHEMA), FEATURES, "target", "linear", impute=True, scale="global").collect()
    assert len(got) == 18 and all(r.prediction == pytest.approx(r.target) for r in got)


def test_cascade_learns_what_ridge_leaves(frame):
    rows = [
        ("s", dt.date(2000 + y, m, 1 + k), float(m + 0.1 * k), float(k % 2), 0.0, 0.0, 2.0 * m + 5.0 * (m > 6)) for y in range(4) for m in range(1, 13) for k in range(6)
    ]
    df = frame(rows, SCHEMA)

    def error(**how):
        got = models.leave_one_year_out(df, ["a", "b"], "target", scale="basin", impute=True, **how).collect()
        assert len(got) == len(rows)
        return sum(abs(r.prediction - r.target) for r in got) / len(got)

    forest = {"numTrees": 8, "maxDepth": 4, "seed": 3}
    ridge = error(kind="ridge")
    assert error(kind="random_forest", params=forest, cascade=True) < 0.6 * ridge


def test_empty_and_single_year(frame):
    assert models.leave_one_year_out(frame([], SCHEMA), FEATURES, "target", "linear").collect() == []
    one = [r for r in record() if r[1].year == 2001]
    assert models.leave_one_year_out(frame(one, SCHEMA), FEATURES, "target", "ridge", impute=True).collect() == []
    assert models.leave_one_year_out(frame(one, SCHEMA), FEATURES, "target", "random_forest", impute=True).collect() == []


def test_random_trials_repeat_with_a_seed(frame):
    space = {"maxDepth": (1, 5), "numTrees": [2, 4], "subsamplingRate": (0.5, 1.0), "minInstancesPerNode": (1, 30, "log")}
    sets = models.sampled_parameters(space, 30, seed=4)
    assert sets == models.sampled_parameters(space, 30, seed=4) != models.sampled_parameters(space, 30, seed=5)
    assert all(1 <= s["maxDepth"] <= 5 and s["numTrees"] in (2, 4) and 0.5 <= s["subsamplingRate"] <= 1 for s in sets)
    assert all(isinstance(s["minInstancesPerNode"], int) and 1 <= s["minInstancesPerNode"] <= 30 for s in sets)
    found = models.search_parameters(frame(record(holes=0), SCHEMA), FEATURES, "target", space=space, trials=3, seed=4, parallelism=3).collect()
    assert sorted(r.trial for r in found) == [0, 1, 2] and [r.rmse for r in found] == sorted(r.rmse for r in found)
