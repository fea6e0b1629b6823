"""Mutual information, components on unseen rows, monthly regression against plain numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import models, pca, selection


def plain_information(x, y, bins):
    """Rank-binned mutual information with Miller-Madow correction."""
    known = ~np.isnan(x) & ~np.isnan(y)
    cut = [np.quantile(v[~np.isnan(v)], np.arange(1, bins) / bins) for v in (x[~np.isnan(y)], y)]
    a, b = ((v[known][:, None] > e).sum(axis=1) for v, e in zip((x, y), cut, strict=True))
    joint, _, _ = np.histogram2d(a, b, [np.arange(bins + 1) - 0.5] * 2)
    n, px, py = joint.sum(), joint.sum(axis=1), joint.sum(axis=0)
    at = joint > 0
    mi = (joint[at] / n * np.log(joint[at] * n / np.outer(px, py)[at])).sum()
    return max(0.0, mi - (at.sum() - (px > 0).sum() - (py > 0).sum() + 1) / (2 * n))


@pytest.fixture(scope="module")
def columns(spark):
    rng = np.random.default_rng(8)
    n = 6000
    y = rng.normal(size=n)
    x = {
        "strong": 0.9 * y + math.sqrt(1 - 0.81) * rng.normal(size=n), "twin": None, "square": y * y + 0.1 * rng.normal(size=n),
        "weak": 0.3 * y + math.sqrt(1 - 0.09) * rng.normal(size=n), "noise": rng.normal(size=n), "flat": np.full(n, 2.0),
    }
    x["twin"] = 3 * x["strong"] + 0.01 * rng.normal(size=n)
    x["weak"][::9] = np.nan
    y[::11] = np.nan
    pdf = pd.DataFrame({**x, "y": y})
    df = spark.createDataFrame(pdf)
    return pdf, df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns])


NAMES = ["strong", "twin", "square", "weak", "noise", "flat"]


def test_information_equals_the_plain_estimate(columns):
    pdf, df = columns
    got = {r.feature: r for r in selection.mutual_information(df, NAMES, "y", 12).collect()}
    for name in NAMES:
        assert got[name].mi == pytest.approx(plain_information(pdf[name].to_numpy(), pdf["y"].to_numpy(), 12), abs=1e-9)
    assert got["flat"].mi == 0 and got["weak"].n < got["noise"].n


def test_information_of_normal_columns_is_near_the_true_value(columns):
    _, df = columns
    got = {r.feature: r.mi for r in selection.mutual_information(df, NAMES, "y").collect()}
    for name, rho in (("strong", 0.9), ("weak", 0.3), ("noise", 0.0)):
        assert got[name] == pytest.approx(-0.5 * math.log(1 - rho * rho), abs=0.05)


def test_the_best_are_chosen_after_the_correlation_cut(columns):
    _, df = columns
    # a correlation would not see the square; the twin goes as a copy of an earlier column
    assert selection.select_informative(df, NAMES[:-1], "y", 2) == ["strong", "square"]
    assert selection.select_informative(df, NAMES[:-1], "y", 3, limit=None) == ["strong", "twin", "square"]
    assert selection.select_informative(df.limit(0), ["strong", "weak"], "y", 1, limit=None) == []


def test_components_of_unseen_rows(spark, folder):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 2))
    rows = np.c_[z[:, 0], 2 * z[:, 0] + 0.01 * z[:, 1], z[:, 1], rng.normal(size=400)]
    old, new = rows[:300], rows[300:] * 5 + 1
    frame = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id int, a double, b double, c double, d double")
    model = pca.GroupPCA({"G": ["a", "b", "c"], "single": ["d"]}, 0.95).fit(frame(old))
    model.save(spark, folder)
    again = pca.GroupPCAModel.load(spark, folder)
    values, axes = np.linalg.eigh(np.cov(old[:, :3].T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    expected = (new[:, :3] - old[:, :3].mean(axis=0)) @ axes
    for m in (model, again):
        got = m.transform(frame(new)).orderBy("id")
        assert got.columns == ["id", "d", "G_PC1", "G_PC2"]
        assert np.allclose([[r.G_PC1, r.G_PC2] for r in got.collect()], expected)
    missing = spark.createDataFrame([(0, None, 1.0, 1.0, 1.0)], "id int, a double, b double, c double, d double")
    assert model.transform(missing).first().G_PC1 is None
    assert pca.GroupPCA({"G": ["a", "b"]}).fit(frame(old[:1])).transform(frame(new)).columns == ["id", "a", "b", "c", "d"]


def plain_regression(pdf, features, as_of, k, kind, alpha):
    """One station after the other."""
    out = {}
    for code, own in pdf.groupby("code"):
        past, now = own[own["date"] < as_of], own[own["date"] == as_of]
        best = {}
        for f in features:
            c = abs(past[f].corr(past["target"]))
            if not np.isnan(c) and c > best.get(f.split("_")[0], (-1.0, ""))[0]:
                best[f.split("_")[0]] = (c, f)
        chosen = [f for _, f in sorted(best.values(), reverse=True)[:k]]
        train = past.dropna(subset=["target", *chosen])
        q = r2 = None
        if chosen and len(train) >= 2 * k and len(now):
            x, y = train[chosen].to_numpy(float), train["target"].to_numpy(float)
            mx, my = x.mean(axis=0), y.mean()
            x, y = x - mx, y - my
            if kind == "linear":
                w = np.linalg.lstsq(x, y, rcond=None)[0]
            elif kind == "ridge":
                w = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)
            else:
                w = np.zeros(x.shape[1])
                for _ in range(2000):
                    for j in range(len(w)):
                        rho = x[:, j] @ (y - x @ w + x[:, j] * w[j])
                        w[j] = np.sign(rho) * max(abs(rho) - alpha * len(y), 0) / (x[:, j] @ x[:, j])
            r2 = 1 - ((y - x @ w) ** 2).sum() / (y**2).sum()
            value = my + (now[chosen].to_numpy(float)[0] - mx) @ w
            q = None if np.isnan(value) else max(value, 0.0)
        out[code] = (", ".join(chosen), q, r2)
    return out


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso"])
def test_monthly_regression_equals_one_station_after_the_other(spark, kind):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(8):
        for y in range(2000, 2000 + 3 + 2 * s):
            p, q, t = rng.normal(3, 1), rng.normal(0, 1), rng.normal(10, 3)
            gap = lambda v: None if rng.random() < 0.1 else float(v)
            rows.append((f"s{s}", dt.date(y, 6, 15), gap(p), gap(p * p + q), gap(t), gap(4 * p + 0.5 * t + 0.3 * rng.normal())))
            rows.append((f"s{s}", dt.date(y, 6, 16), 1.0, 1.0, 1.0, 1e6))
    rows += [("short", dt.date(2020, 6, 15), 1.0, 2.0, 3.0, 4.0), ("none", dt.date(2019, 6, 15), None, None, None, 1.0)]
    features = ["P_1", "P_2", "T_1"]
    as_of = dt.date(2012, 6, 15)
    df = spark.createDataFrame(rows, "code string, date date, P_1 double, P_2 double, T_1 double, target double")
    pdf = pd.DataFrame(rows, columns=["code", "date", *features, "target"]).astype(dict.fromkeys([*features, "target"], float))
    pdf = pdf[[d.day == 15 and d <= as_of for d in pdf["date"]]]
    for k in (1, 2):
        got = {r.code: r for r in models.monthly_regression(df, features, as_of, k, kind, 0.2).collect()}
        expected = plain_regression(pdf, features, as_of, k, kind, 0.2)
        assert got.keys() == expected.keys()
        for code, (chosen, q, r2) in expected.items():
            assert got[code].features == chosen
            assert (got[code].Q is None) == (q is None) and (got[code].r2 is None) == (r2 is None), code
            if q is not None:
                assert got[code].Q == pytest.approx(q, abs=0.00501)
            if r2 is not None:
                assert got[code].r2 == pytest.approx(r2, abs=1e-6)
