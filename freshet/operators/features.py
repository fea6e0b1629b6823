"""Feature tables, imputation and feature selection."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.physics import cyclic_features
from . import windows as win


def feature_table(df: DataFrame, specs: dict, lags: dict[str, list[int]] | None = None, target: str | None = "discharge", horizon: int = 30, offset: int = 30) -> DataFrame:
    """Rolling statistics, lags of them, cyclic time features and the target."""
    df = win.rolling_features(df, specs)
    for column, numbers in (lags or {}).items():
        df = win.lag_features(df, column, numbers)
    df = df.withColumns(cyclic_features("date"))
    return win.target_future_mean(df, target, horizon, offset) if target else df


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column mean (one scalar subquery for all columns)."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    df = df.withColumn("_m", means)
    return df.withColumns({c: F.coalesce(F.col(c), F.col("_m")[c]) for c in columns}).drop("_m")


def _nearest(pdf: pd.DataFrame, columns: list[str], wanted: list[str], neighbours: int) -> pd.DataFrame:
    """Fill one season's rows from their nearest neighbours."""
    pdf = pdf.sort_values("date", kind="stable")
    x = pdf[columns].to_numpy(float)
    known = ~np.isnan(x)
    out = x.copy()
    for j in (columns.index(c) for c in wanted):
        holes, donors = np.flatnonzero(~known[:, j]), np.flatnonzero(known[:, j])
        if not len(donors):
            continue
        for at in np.array_split(holes, len(holes) // 256 + 1):
            both = known[at][:, None] & known[donors][None]
            gap = np.where(both, x[at][:, None] - x[donors][None], 0.0)
            shared = both.sum(axis=2)
            # the distance over shared columns stands for all columns; without a shared one there is none
            far = np.where(shared > 0, (gap**2).sum(axis=2) * len(columns) / np.maximum(shared, 1), np.inf)
            order = np.argsort(far, axis=1, kind="stable")[:, :neighbours]
            near = np.isfinite(np.take_along_axis(far, order, axis=1))
            total = np.where(near, x[donors, j][order], 0.0).sum(axis=1)
            out[at, j] = np.where(near.any(axis=1), total / np.maximum(near.sum(axis=1), 1), x[donors, j].mean())
    return pdf.assign(**{c: out[:, columns.index(c)] for c in wanted})


def impute_knn(df: DataFrame, columns: list[str], wanted: list[str] | None = None, neighbours: int = 5) -> DataFrame:
    """Missing values become the mean of the nearest rows of the same station and calendar month.

    The distance is Euclidean over the columns that both rows know, scaled up to all of them; ties go to the
    earlier date.  A row that shares no column with any donor takes the season's mean; a column without a value in the season stays
    missing.  ``wanted`` are the columns to fill (else all); the other columns stay as they are.  A season
    holds at most 31 rows a year, so every group is bounded by the calendar.
    """
    wanted = wanted or columns
    rest = [c for c in df.columns if c not in wanted]
    typed = df.select(*rest, *[F.col(c).cast("double").alias(c) for c in wanted])

    order = typed.columns

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        return _nearest(pdf, columns, wanted, neighbours)[order]

    filled = typed.groupBy("code", F.month("date")).applyInPandas(fill, typed.schema)
    # pandas has no missing number beside not-a-number
    back = {c: F.when(~F.isnan(c), F.col(c)) for c in {*wanted, *columns}}
    return filled.withColumns(back).select(*df.columns)


def feature_correlation(df: DataFrame, features: list[str], target: str, keys: list[str]) -> DataFrame:
    """Absolute correlation of every feature with the target per group.

    One aggregate per feature in a single pass; the unpivot runs on the aggregated rows.
    """
    def corr(f):
        # a constant side has no correlation; ``corr`` itself would divide by zero
        x, y = F.when(F.col(target).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(target))
        return F.abs(F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))

    corr = df.groupBy(*keys).agg(*[corr(f).alias(f) for f in features])
    long = corr.unpivot(keys, features, "feature", "abs_corr")
    return long.where(F.col("abs_corr").isNotNull() & ~F.isnan("abs_corr"))


def top_features(correlations: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best feature of each variable (name up to the first '_'), then the top k.

    Groups are bounded by the number of feature columns.
    """
    best = correlations.withColumn("variable", F.split("feature", "_")[0]).groupBy(*keys, "variable").agg(
        F.max(F.struct("abs_corr", "feature")).alias("b")
    ).select(*keys, "b.feature", "b.abs_corr")
    w = Window.partitionBy(*keys).orderBy(F.col("abs_corr").desc(), "feature")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vectors(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def correlated_features(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """Columns that correlate above ``limit`` with an earlier one.

    Only the columns x columns matrix reaches the driver.
    """
    matrix = Correlation.corr(_vectors(df.select(*columns), columns), "features").first()[0].toArray()
    return [c for j, c in enumerate(columns) if any(abs(matrix[i][j]) > limit for i in range(j))]


def drop_correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    return df.drop(*correlated_features(df, columns, limit))


def pca_groups(df: DataFrame, groups: dict[str, list[str]], variance: float = 0.95) -> DataFrame:
    """Each feature group replaced by the components that explain ``variance``."""
    for name, columns in groups.items():
        vectors = _vectors(df, columns, "_v")
        model = PCA(k=len(columns), inputCol="_v", outputCol="_p").fit(vectors)
        explained = np.cumsum(model.explainedVariance.toArray())
        keep = min(len(columns), int(np.searchsorted(explained, variance)) + 1)
        parts = vector_to_array(F.col("_p"))
        df = model.transform(vectors).withColumns(
            {f"{name}_pc{i + 1}": parts[i] for i in range(keep)}
        ).drop("_v", "_p", *columns)
    return df


def select_k_best(df: DataFrame, columns: list[str], target: str, k: int) -> list[str]:
    """The k best features by F-score (the reference scores by mutual information)."""
    rows = _vectors(df.where(F.col(target).isNotNull()), columns)
    selector = UnivariateFeatureSelector(
        featuresCol="features", labelCol=target, outputCol="_s", selectionMode="numTopFeatures"
    )
    selector.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(k)
    return [columns[i] for i in sorted(selector.fit(rows).selectedFeatures)]


def _harmonics(date: Column, n: int) -> list[Column]:
    angle = 2 * math.pi / 365.25 * F.dayofyear(date)
    terms = [F.lit(1.0)]
    for i in range(1, n + 1):
        terms += [F.cos(i * angle), F.sin(i * angle)]
    return terms


@pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(gram: pd.Series, rhs: pd.Series) -> pd.Series:
    """Least-squares solutions of a batch of flattened normal equations (harmonics only)."""
    good = (gram.notna() & rhs.notna()).to_numpy()
    out: list = [None] * len(gram)
    if good.any():
        right = np.stack(rhs[good].to_list()).astype(float)
        left = np.stack(gram[good].to_list()).astype(float).reshape(len(right), right.shape[1], -1)
        clean = np.isfinite(left).all(axis=(1, 2)) & np.isfinite(right).all(axis=1)
        solved = (np.linalg.pinv(left[clean], hermitian=True) @ right[clean][:, :, None])[:, :, 0]
        for i, row in zip(np.flatnonzero(good)[clean], solved, strict=True):
            out[i] = row.tolist()
    return pd.Series(out, dtype=object)


def fourier_climatology(df: DataFrame, value: str, harmonics: int = 2, keys=("code",)) -> DataFrame:
    """Least-squares seasonal cycle per station and the anomaly from it.

    The normal equations are sums, so Spark builds them with map-side partial aggregates;
    Python only solves one small system per station.
    """
    keys = list(keys)
    terms = _harmonics(F.col("date"), harmonics)
    size = len(terms)
    known = df.where(F.col(value).isNotNull())
    gram = {f"g{i}_{j}": F.sum(terms[i] * terms[j]) for i in range(size) for j in range(i, size)}
    rhs = {f"r{i}": F.sum(terms[i] * F.col(value)) for i in range(size)}
    sums = known.groupBy(*keys).agg(*[c.alias(n) for n, c in {**gram, **rhs}.items()])
    full = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)])
    coef = sums.select(*keys, _solve(full, F.array(*[F.col(f"r{i}") for i in range(size)])).alias("_coef"))
    fitted = sum((F.col("_coef")[i] * terms[i] for i in range(1, size)), F.col("_coef")[0] * terms[0])
    out = df.join(coef, keys, "left").withColumn(f"{value}_climatology", fitted)
    return out.withColumn(f"{value}_anomaly", F.col(value) - F.col(f"{value}_climatology")).drop("_coef")


def model_input_window(daily: DataFrame, forecasts: DataFrame, as_of, length: int, max_missing: int, max_missing_end: int, value: str = "Q50", stations: DataFrame | None = None) -> DataFrame:
    """The last ``length + 1`` days of each station, completed, with a usability flag.

    Flag 1: too many nulls inside the window or at its end, before or after the nulls are
    filled with earlier forecasts; such rows stay unfilled.  Flag 0: short inner gaps are
    interpolated and the end is carried forward.

    A station's days and the newest forecasts for them are one row of two small maps (of ``length + 2`` days), in which nulls
    are counted as they stand; so besides the newest forecast of each day there is a single exchange by station, and
    the interpolation keeps it.  ``stations`` (code) lists those asked for, else all with any day.
    """
    end = F.lit(as_of).cast("date")
    start = F.date_sub(end, length + 1)
    inside = F.col("date").between(start, end)
    newest = forecasts.where(inside).groupBy("code", "date").agg(F.max_by(value, "forecast_date").cast("double").alias("v"))
    parts = [
        daily.select("code", F.when(inside, F.struct("date", F.col("discharge").cast("double").alias("v"))).alias("seen"), F.lit(None).alias("made")),
        newest.select("code", F.lit(None).alias("seen"), F.struct("date", "v").alias("made")),
    ]
    wanted = daily if stations is None else stations
    kept = F.max("listed")
    if stations is not None:
        parts.append(stations.select("code", F.lit(None).alias("seen"), F.lit(None).alias("made")))
    kinds = "struct<date:date,v:double>"
    marked = [
        p.select("code", F.col("seen").cast(kinds), F.col("made").cast(kinds), F.lit(i == (0 if wanted is daily else 2)).alias("listed"))
        for i, p in enumerate(parts)
    ]
    rows = reduce(DataFrame.unionByName, marked).groupBy("code").agg(
        kept.alias("listed"), F.map_from_entries(F.collect_list("seen")).alias("seen"), F.map_from_entries(F.collect_list("made")).alias("made")
    ).where("listed")

    def bad(values: Column) -> Column:
        recent = F.slice(values, 3, length)
        missing = F.size(F.filter(recent, lambda v: v.isNull()))
        tail = F.aggregate(recent, F.lit(0), lambda n, v: F.when(v.isNull(), n + 1).otherwise(0))
        return (missing > max_missing) | (F.least(tail, F.lit(max_missing)) >= max_missing_end)

    days = F.sequence(start, end)
    rows = rows.withColumn("_days", days).withColumn("_seen", F.transform("_days", lambda d: F.col("seen")[d]))
    filled = F.transform("_days", lambda d: F.coalesce(F.col("seen")[d], F.col("made")[d]))
    rows = rows.withColumn("_filled", F.when(bad(F.col("_seen")), F.col("_seen")).otherwise(filled))
    rows = rows.withColumn("flag", bad(F.col("_filled")).cast("int"))
    long = rows.select("code", "flag", F.explode(F.arrays_zip(F.col("_days").alias("date"), F.col("_filled").alias("discharge"))).alias("d"))
    long = long.select("code", "d.date", "d.discharge", "flag")
    done = win.interpolate(long.withColumn("_full", F.col("discharge")), "_full")
    return done.select(
        "code", "date", F.when(F.col("flag") == 0, F.col("_full")).otherwise(F.col("discharge")).alias("discharge"), "flag"
    )


def forecast_flags(stations: DataFrame, predictions: DataFrame, values: list[str], as_of) -> DataFrame:
    """Operational forecasts with their flag: 0 made, 1 a null among a station's values, 2 no forecast at all.

    A station without predictions gets one row of nulls dated ``as_of``.
    """
    null = F.lit(False)
    for v in values:
        null = null | F.col(v).isNull()
    any_null = F.max(null).over(Window.partitionBy("code"))
    made = predictions.withColumn("flag", F.when(any_null, 1).otherwise(0))
    missing = stations.select("code").distinct().join(predictions.select("code").distinct(), "code", "left_anti")
    none = missing.select("code", F.lit(as_of).cast("date").alias("date"), F.lit(2).alias("flag"))
    return made.unionByName(none, allowMissingColumns=True).withColumn("forecast_date", F.lit(as_of).cast("date"))


def hindcast_flags(hindcast: DataFrame, values: list[str]) -> DataFrame:
    """Hindcast rows with their flag: 4 whole, 3 with a null among the values."""
    known = F.lit(True)
    for v in values:
        known = known & F.col(v).isNotNull()
    return hindcast.withColumn("flag", F.when(known, 4).otherwise(3))


def scale_with(df: DataFrame, scalers: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """M9: scale columns with given statistics (code, feature, mean, std | min, max).

    A column without spread at a station becomes null there.
    """
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaling {kind!r}")
    center, spread = (
        (F.col("mean"), F.col("std")) if kind == "standard" else (F.col("min"), F.col("max") - F.col("min"))
    )
    wide = scalers.groupBy("code").pivot("feature", columns).agg(
        F.first(center).alias("c"), F.first(spread).alias("s")
    )
    joined = df.join(wide, "code", "left")
    scaled = {c: F.try_divide(F.col(c) - F.col(f"{c}_c"), F.col(f"{c}_s")) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


