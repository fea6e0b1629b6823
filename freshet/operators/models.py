"""Per-station models (R5, R10-R13) and the hook for user models.

Station groups handed to a user's model hold at most one row per calendar day, so Spark spreads
stations over tasks and no group is unbounded.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from .features import feature_correlation, top_features
from .folds import fit_folds, own_units, predict_folds, prepared, scaled_prediction, with_fold

REGRESSORS = {
    "linear": LinearRegression,
    "random_forest": RandomForestRegressor,
    "gradient_boosting": GBTRegressor,
}


def solved(cross: np.ndarray, right: np.ndarray, rows: np.ndarray, kind: str, alpha: float) -> np.ndarray:
    """Coefficients of many small systems at once, from centred cross-products (systems x k x k).

    Lasso goes on by coordinate descent on the cross-products until no system's coefficients move.
    """
    size = cross.shape[-1]
    if kind == "linear":
        return (np.linalg.pinv(cross, hermitian=True) @ right[..., None])[..., 0]
    if kind == "ridge":
        return np.linalg.solve(cross + alpha * np.eye(size), right[..., None])[..., 0]
    if kind != "lasso":
        raise ValueError(f"unknown regression {kind!r}")
    w, norms = np.zeros_like(right), np.einsum("sii->si", cross)
    for _ in range(1000):
        before = w.copy()
        for j in range(size):
            rho = right[:, j] - np.einsum("si,si->s", cross[:, j], w) + norms[:, j] * w[:, j]
            least = np.maximum(np.abs(rho) - alpha * rows, 0)
            w[:, j] = np.sign(rho) * np.divide(least, norms[:, j], out=np.zeros_like(rho), where=norms[:, j] > 0)
        if np.abs(w - before).max(initial=0) < 1e-8:
            break
    return w


def _solver(kind: str, alpha: float):
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(cross: pd.Series, right: pd.Series, rows: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(rows), dtype=object)
        # systems of equal size together
        sizes = right.map(lambda r: -1 if r is None else len(r))
        for size in sizes[sizes > 0].unique():
            at = np.flatnonzero(sizes == size)
            c = np.stack(cross.iloc[at].to_list()).astype(float).reshape(len(at), size, size)
            w = solved(c, np.stack(right.iloc[at].to_list()).astype(float), rows.iloc[at].to_numpy(float), kind, alpha)
            for i, own in zip(at, w, strict=True):
                out.iat[i] = own.tolist()
        return out

    return solve


def monthly_regression(df: DataFrame, features: list[str], as_of, num_features: int = 2, kind: str = "linear", alpha: float = 1.0, target: str = "target") -> DataFrame:
    """Per station, the same month-day of all years; fit on the past, predict ``as_of``.

    Needs ``2 * num_features`` complete rows; with fewer features than asked for it goes on with
    those found.  The prediction is clipped at 0 and rounded
    to 2 decimals, ``r2`` is the in-sample fit.  Correlations and cross-products are aggregates; only the
    solution of a station's small system is Python, many stations at a time.
    """
    if kind not in ("linear", "ridge", "lasso"):
        raise ValueError(f"unknown regression {kind!r}")
    day = F.lit(as_of).cast("date")
    rows = df.where(
        (F.month("date") == F.month(day)) & (F.dayofmonth("date") == F.dayofmonth(day)) & (F.col("date") <= day)
    ).select("code", "date", F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    best = top_features(feature_correlation(rows.where(F.col("date") < day), features, "_y", ["code"]), ["code"], num_features)
    chosen = best.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("_best"))
    chosen = chosen.select("code", F.transform("_best", lambda b: b["feature"]).alias("_chosen"))
    named = F.create_map(*[c for f in features for c in (F.lit(f), F.col(f))])
    seen = rows.join(chosen, "code", "left").withColumn("_x", F.transform("_chosen", lambda f: named[f]))
    used = (F.col("date") < day) & F.col("_y").isNotNull() & F.forall("_x", lambda v: v.isNotNull())
    x = [F.when(used, F.get("_x", F.lit(i))) for i in range(num_features)]
    y = F.when(used, F.col("_y"))
    size = F.coalesce(F.size(F.first("_chosen")), F.lit(0))
    n = F.count(y)

    def own(parts):
        # a station may have found fewer features than asked for
        return F.filter(F.array(*parts), lambda v: v.isNotNull())

    sums = seen.groupBy("code").agg(
        F.first("_chosen").alias("_chosen"), size.alias("_k"), n.cast("double").alias("_n"), F.avg(y).alias("_my"), (n * F.var_pop(y)).alias("_yy"),
        own([F.avg(v) for v in x]).alias("_mx"), own([n * F.covar_pop(v, y) for v in x]).alias("_xy"),
        own([n * F.covar_pop(v, u) for v in x for u in x]).alias("_xx"), F.first(F.when(F.col("date") == day, F.col("_x")), ignorenulls=True).alias("_now"),
        F.max(F.col("date") == day).alias("_asked"),
    )
    able = F.col("_asked") & (F.col("_k") > 0) & (F.col("_n") >= 2 * num_features)
    # the systems that can be solved alone reach Python
    right = F.when(able, F.col("_xy"))
    fits = sums.withColumn("_able", able).withColumn("_w", _solver(kind, alpha)("_xx", right, "_n"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    k = F.col("_k")
    ww = F.flatten(F.transform("_w", lambda p: F.transform("_w", lambda q: p * q)))
    rest = F.col("_yy") - 2 * dot("_w", "_xy") + dot(ww, "_xx")
    value = F.col("_my") + dot("_w", F.zip_with("_now", "_mx", lambda p, q: p - q))
    return fits.select(
        "code", F.array_join(F.coalesce("_chosen", F.array().cast("array<string>")), ", ").alias("features"),
        F.when(F.col("_able") & (k > 0), F.round(F.greatest(value, F.lit(0.0) * value), 2)).alias("Q"),
        F.when(F.col("_able") & (k > 0) & (F.col("_yy") > 0), 1 - F.try_divide(rest, F.col("_yy"))).alias("r2"),
    )


def apply_model(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """2.11: a user forecast model, called once per station with its series in date order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return model(pdf.sort_values("date").reset_index(drop=True))

    return df.groupBy("code").applyInPandas(run, schema)


def _pipeline(kind: str, features: list[str], target: str, params: dict | None, prediction: str = "prediction") -> Pipeline:
    out = f"_{prediction}_vector"
    vectors = VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip")
    model = REGRESSORS[kind](featuresCol=out, labelCol=target, predictionCol=prediction, **(params or {}))
    return Pipeline(stages=[vectors, model])


def fit_on_all(df: DataFrame, features: list[str], target: str, kind: str = "random_forest", params: dict | None = None):
    """R11."""
    return _pipeline(kind, features, target, params).fit(df.dropna(subset=[target, *features]))


def at_once(spark: SparkSession, jobs: dict[str, Callable[[], object]], parallelism: int = 4) -> list:
    """Results of independent jobs, several at a time, each under a job group of its own name."""

    def run(item):
        name, job = item
        spark.sparkContext.setJobGroup(name, name)
        return job()

    with ThreadPoolExecutor(max(1, min(parallelism, len(jobs) or 1))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), item) for item in jobs.items()]]


def leave_one_year_out(
    df: DataFrame, features: list[str], target: str, kind: str = "random_forest", params: dict | None = None, cascade: bool = False,
    impute: bool = False, scale: str | None = None, groups: dict[str, list[str]] | None = None, share: float = 0.95,
    alpha: float = 1.0, parallelism: int = 4,
) -> DataFrame:
    """Each year predicted by a model of the others, prepared by the others alone (see ``folds.fit_folds``).

    ``linear`` and ``ridge`` come from yearly sums without a refit.  Other kinds are fitted once a year, several at a
    time; ``cascade`` fits them on what a ridge model of the same fold leaves over.
    """
    if kind in ("linear", "ridge") and not cascade:
        return predict_folds(df, fit_folds(df, features, target, kind, alpha, impute, scale, groups, share))
    # read once a fold: written to the shared folder
    rows = cut_lineage(df.select("code", "date", target, *features))
    folds = fit_folds(rows, features, target, "ridge", alpha, impute, scale, groups, share)
    rows = folds.complete(rows)
    base = scaled_prediction(folds) if cascade else F.lit(0.0)
    at = len(features)

    def one(year: int) -> DataFrame:
        inputs = [f"_x{i}" for i in range(folds.axes[year].shape[1])]

        def seen(part: DataFrame) -> DataFrame:
            part = with_fold(part, folds, F.lit(year)).withColumn("_z", F.array(*prepared(folds))).withColumn("_base", base)
            turned = {
                name: sum((F.col("_z")[i] * float(v) for i, v in enumerate(axis) if v), F.lit(0.0))
                for name, axis in zip(inputs, folds.axes[year].T, strict=True)
            }
            scaled = (F.col(target) - F.col("_mean")[at]) / F.col("_std")[at]
            return part.withColumns(turned).withColumn("_rest", scaled - F.col("_base"))

        model = _pipeline(kind, inputs, "_rest", params, "_found").fit(seen(rows.where(F.year("date") != year)))
        scored = model.transform(seen(rows.where(F.year("date") == year)))
        return scored.select("code", "date", target, own_units(folds, F.col("_base") + F.col("_found")).alias("prediction"))

    jobs = {f"leave out {year}": partial(one, year) for year in sorted(folds.axes)}
    parts = at_once(df.sparkSession, jobs, parallelism)
    empty = rows.select("code", "date", target, F.lit(None).cast("double").alias("prediction")).limit(0)
    return reduce(DataFrame.unionByName, parts) if parts else empty


def feature_importance(model, features: list[str], spark) -> DataFrame:
    """Sorted importances (one row per feature column)."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def year_split(df: DataFrame, share: float = 0.8, until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of the years (before ``until``) for training, the rest for validation."""
    if until is not None:
        df = df.where(F.year("date") < until)
    # calendar years: a handful of integers
    years = sorted(r[0] for r in df.select(F.year("date")).distinct().collect() if r[0] is not None)
    cut = years[max(0, int(len(years) * share) - 1)] if years else 0
    return df.where(F.year("date") <= cut), df.where(F.year("date") > cut)


def sampled_parameters(space: dict[str, list | tuple], trials: int, seed: int = 0) -> list[dict]:
    """Parameter sets drawn at random: from a list, or between two bounds (whole numbers if both are).

    A third item ``"log"`` draws on a logarithmic scale.
    """
    rng = random.Random(seed)

    def drawn(choice):
        if isinstance(choice, list):
            return rng.choice(choice)
        low, high, *log = choice
        whole = isinstance(low, int) and isinstance(high, int)
        if log:
            value = math.exp(rng.uniform(math.log(low), math.log(high + (0.5 if whole else 0))))
            return min(high, round(value)) if whole else value
        return rng.randint(low, high) if whole else rng.uniform(low, high)

    return [{name: drawn(space[name]) for name in sorted(space)} for _ in range(trials)]


def search_parameters(
    df: DataFrame, features: list[str], target: str, kind: str = "random_forest", grid: dict[str, list] | None = None, share: float = 0.8,
    space: dict[str, list | tuple] | None = None, trials: int = 10, seed: int = 0, until: int | None = None, parallelism: int = 4,
) -> DataFrame:
    """Validation RMSE and R2 of parameter sets, best first; several trials run at the same time.

    All combinations of ``grid``, or ``trials`` sets drawn from ``space``.  The validation rows are the last years'.
    """
    if space is not None:
        sets = sampled_parameters(space, trials, seed)
    else:
        names = list(grid or {})
        sets = [dict(zip(names, values, strict=True)) for values in product(*(grid[n] for n in names))]
    rows = cut_lineage(df.select("date", target, *features).dropna(subset=[target, *features]))
    train, valid = year_split(rows, share, until)

    def one(params: dict) -> tuple[float, float]:
        scored = _pipeline(kind, features, target, params).fit(train).transform(valid)
        metrics = RegressionEvaluator(labelCol=target, predictionCol="prediction")
        scored = scored.select(target, "prediction")
        return tuple(metrics.evaluate(scored, {metrics.metricName: m}) for m in ("rmse", "r2"))

    found = at_once(df.sparkSession, {f"trial {i}": partial(one, params) for i, params in enumerate(sets)}, parallelism)
    table = [
        (i, ", ".join(f"{k}={v}" for k, v in params.items()), float(rmse), float(r2))
        for i, (params, (rmse, r2)) in enumerate(zip(sets, found, strict=True))
    ]
    return df.sparkSession.createDataFrame(table, "trial int, params string, rmse double, r2 double").orderBy("rmse", "trial")
