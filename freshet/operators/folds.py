"""Leave-one-year-out folds of linear models, all from one pass over the rows.

Everything a fold needs is a sum: counts, sums and cross-products of the features and the target, also
where values are missing.  They are built per station and year; a fold's training sums are the total minus
its year.  From them come the means that fill gaps, the scaling (over all rows or per station), the
covariance for principal components and the normal equations, so no model is fitted twice and the
rows are read once for all folds, once more to predict.

What reaches the driver is bounded by the calendar and the columns: a matrix per year.  Sums per
station stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALES = (None, "global", "basin")


def _full(flat: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles, row by row."""
    out = np.zeros((*flat.shape[:-1], size, size))
    i, j = np.triu_indices(size)
    out[..., i, j] = flat
    out[..., j, i] = flat
    return out


def filled(gram: np.ndarray, means: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means, centred cross-products and fill values, as if missing values were filled.

    ``gram`` holds sums of products of (known?, value or 0) for all columns, the target last; a column without
    a value is filled with 0.  ``means`` fills with other values than the gram's own.
    """
    d = gram.shape[-1] // 2
    known, seen, cross = gram[..., :d, :d], gram[..., :d, d:], gram[..., d:, d:]
    count, total = np.diagonal(known, axis1=-2, axis2=-1), np.diagonal(seen, axis1=-2, axis2=-1)
    rows = count[..., -1]
    if means is None:
        means = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
    # sums of column j over the rows where column i is missing, and rows where both are
    apart = total[..., None, :] - seen
    neither = rows[..., None, None] - count[..., :, None] - count[..., None, :] + known
    half = means[..., :, None] * apart
    cross = cross + half + np.swapaxes(half, -1, -2) + means[..., :, None] * means[..., None, :] * neither
    sums = total + means * (rows[..., None] - count)
    n = np.maximum(rows, 1)[..., None]
    return rows, sums / n, cross - sums[..., :, None] * sums[..., None, :] / n[..., None], means


def spread(rows: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Sample standard deviations; 1 where a column is constant or has a single row."""
    variance = np.maximum(np.diagonal(cross, axis1=-2, axis2=-1), 0) / np.maximum(rows - 1, 1)[..., None]
    return np.where(variance > 0, np.sqrt(variance), 1.0)


def components(cross: np.ndarray, share: float) -> np.ndarray:
    """The leading principal axes that explain ``share`` of the variance, as columns."""
    values, axes = np.linalg.eigh(cross)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    if values.sum() <= 0:
        return axes[:, :1]
    keep = int(np.argmax(np.cumsum(values) / values.sum() >= share - 1e-12)) + 1
    return axes[:, :keep]


def basis(cross: np.ndarray, groups: list[list[int]], share: float) -> np.ndarray:
    """The features as columns, ``groups`` of them replaced by their principal axes."""
    p = len(cross) - 1
    single = [j for j in range(p) if not any(j in g for g in groups)]
    blocks = [np.eye(p)[:, single]]
    for group in groups:
        axes = components(cross[np.ix_(group, group)], share)
        block = np.zeros((p, axes.shape[1]))
        block[group] = axes
        blocks.append(block)
    return np.hstack(blocks)


def weights(cross: np.ndarray, axes: np.ndarray, kind: str, alpha: float) -> np.ndarray:
    """Coefficients of the prepared features for a model that sees them along ``axes``."""
    p = len(cross) - 1
    xx, xy = axes.T @ cross[:p, :p] @ axes, axes.T @ cross[:p, p]
    if kind == "ridge":
        return axes @ np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    if kind != "linear":
        raise ValueError(f"unknown linear model {kind!r}")
    return axes @ (np.linalg.pinv(xx, hermitian=True) @ xy)


@dataclass
class Folds:
    """Per year left out: fill values, coefficients and scaling, as DataFrames keyed by ``_year`` (and code)."""

    fits: DataFrame
    scalers: DataFrame
    keys: list[str]
    features: list[str]
    target: str
    impute: bool = False
    #: Per year the axes that prepared features are turned to before a model other than the linear one sees them.
    axes: dict[int, np.ndarray] = field(default_factory=dict)

    def complete(self, df: DataFrame) -> DataFrame:
        """The rows that folds use."""
        df = df.where(F.col(self.target).isNotNull())
        return df if self.impute else df.dropna(subset=self.features)


def year_sums(df: DataFrame, features: list[str], target: str, keys: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``*keys, _year, _gram`` of the rows with a target, and the values that columns are centred on."""
    columns = [*features, target]
    rows = df.where(F.col(target).isNotNull())
    centre = rows.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()
    centre = np.array([c or 0.0 for c in centre])
    known = [F.col(c).isNotNull().cast("double") for c in columns]
    value = [F.coalesce(F.col(c).cast("double") - F.lit(float(m)), F.lit(0.0)) for c, m in zip(columns, centre, strict=True)]
    named = rows.select(*keys, F.year("date").alias("_year"), *[z.alias(f"_z{i}") for i, z in enumerate([*known, *value])])
    size = 2 * len(columns)
    sums = [F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) for i in range(size) for j in range(i, size)]
    return named.groupBy(*keys, "_year").agg(F.array(*sums).alias("_gram")), centre


def _station_pass(size: int, years: np.ndarray, means: np.ndarray, scalers: bool):
    """Stations with their yearly sums -> each fold's scaled cross-products, summed, or each own year's scaling."""
    d = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, firsts, values, folds = [], [], [], []
            total = np.zeros((len(years), d, d))
            for code, own, grams in zip(*(batch.column(i) for i in range(3)), strict=True):
                own, grams = np.array(own.as_py()), _full(np.array(grams.as_py()), size)
                at = np.searchsorted(years, own)
                less = np.zeros((len(years), size, size))
                less[at] = grams
                rows, mean, cross, _ = filled(grams.sum(axis=0) - less, means)
                std = spread(rows, cross)
                used = rows > 0.5
                if scalers:
                    for y, i in zip(own.tolist(), at.tolist(), strict=True):
                        if used[i]:
                            names.append(code.as_py())
                            folds.append(y)
                            firsts.append(mean[i].tolist())
                            values.append(std[i].tolist())
                else:
                    total += np.where(used[:, None, None], cross / std[:, :, None] / std[:, None, :], 0.0)
            if scalers:
                out = [pa.array(names, pa.string()), pa.array(folds, pa.int32()), pa.array(firsts, pa.list_(pa.float64())), pa.array(values, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, ["code", "_year", "_mean", "_std"])
            else:
                out = [pa.array(years, pa.int32()), pa.array(total.reshape(len(years), -1).tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, ["_year", "_cross"])

    return run


def fit_folds(
    df: DataFrame, features: list[str], target: str, kind: str = "linear", alpha: float = 1.0, impute: bool = False,
    scale: str | None = None, groups: dict[str, list[str]] | None = None, share: float = 0.95,
) -> Folds:
    """For every calendar year the model of all other years.

    ``impute`` fills missing features with the fold's means (else rows with one are left out); ``scale``
    standardises features and target over all rows or per station (``basin``); ``groups`` of features become the principal
    components that explain ``share`` of their variance.  ``kind`` is linear (least norm where columns depend on each
    other) or ridge with penalty ``alpha``.  Rows without a target take no part.
    """
    if scale not in SCALES:
        raise ValueError(f"unknown scaling {scale!r}")
    spark, p = df.sparkSession, len(features)
    if not impute:
        df = df.dropna(subset=features)
    per, centre = year_sums(df, features, target, ["code"] if scale == "basin" else [])
    size = 2 * (p + 1)
    if scale == "basin":
        yearly = per.select("_year", F.posexplode("_gram")).groupBy("_year", "pos").agg(F.sum("col").alias("v"))
        yearly = yearly.groupBy("_year").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("g"))
        yearly = yearly.select("_year", F.transform("g", lambda x: x["v"]).alias("_gram"))
    else:
        yearly = per
    # one small matrix a year
    found = sorted((r["_year"], r["_gram"]) for r in yearly.collect() if r["_year"] is not None)
    years = np.array([y for y, _ in found], np.int32)
    grams = _full(np.array([g for _, g in found]).reshape(len(found), size * (size + 1) // 2), size)
    rows, mean, cross, fill = filled(grams.sum(axis=0) - grams)
    std = spread(rows, cross) if scale == "global" else np.ones_like(mean)
    index = [[features.index(c) for c in g] for g in (groups or {}).values()]
    if scale == "basin":
        held = per.where("_year is not null").groupBy("code").agg(F.sort_array(F.collect_list(F.struct("_year", "_gram"))).alias("s"))
        held = held.select("code", F.transform("s", lambda x: x["_year"]).alias("years"), F.transform("s", lambda x: x["_gram"]).alias("grams"))
        summed = held.mapInArrow(_station_pass(size, years, fill, False), "_year int, _cross array<double>")
        summed = summed.select("_year", F.posexplode("_cross")).groupBy("_year", "pos").agg(F.sum("col").alias("v"))
        scaled = np.zeros((len(years), (p + 1) ** 2))
        for r in summed.collect():
            scaled[np.searchsorted(years, r["_year"]), r["pos"]] = r["v"]
        scaled = scaled.reshape(-1, p + 1, p + 1)
        scalers = held.mapInArrow(_station_pass(size, years, fill, True), "code string, _year int, _mean array<double>, _std array<double>")
        move = F.array(*[F.lit(float(c)) for c in centre])
        scalers = scalers.withColumn("_mean", F.zip_with("_mean", move, lambda a, b: a + b))
    else:
        scaled = cross / std[:, :, None] / std[:, None, :]
        table = [(int(y), (m + centre).tolist(), s.tolist()) for y, m, s, n in zip(years, mean, std, rows, strict=True) if n > 0.5]
        scalers = spark.createDataFrame(table, "_year int, _mean array<double>, _std array<double>")
    axes = {int(y): basis(c, index, share) for y, c, n in zip(years, scaled, rows, strict=True) if n > 0.5}
    fits = [
        (int(y), (f + centre).tolist(), weights(c, axes[int(y)], kind, alpha).tolist())
        for y, f, c in zip(years, fill, scaled, strict=True) if int(y) in axes
    ]
    fits = spark.createDataFrame(fits, "_year int, _fill array<double>, _weight array<double>")
    return Folds(fits, scalers, ["code", "_year"] if scale == "basin" else ["_year"], features, target, impute, axes)


def with_fold(df: DataFrame, folds: Folds, year: Column) -> DataFrame:
    """Rows beside the fill values, scaling and coefficients of the fold ``year``; those without a fold are left out."""
    rows = df.withColumn("_year", year)
    # one row a calendar year
    rows = rows.join(F.broadcast(folds.fits), "_year")
    scalers = folds.scalers if "code" in folds.keys else F.broadcast(folds.scalers)
    return rows.join(scalers, folds.keys)


def prepared(folds: Folds) -> list[Column]:
    """The features as the fold's model sees them."""
    return [
        (F.coalesce(F.col(c).cast("double"), F.col("_fill")[i]) - F.col("_mean")[i]) / F.col("_std")[i]
        for i, c in enumerate(folds.features)
    ]


def scaled_prediction(folds: Folds) -> Column:
    return sum((z * F.col("_weight")[i] for i, z in enumerate(prepared(folds))), F.lit(0.0))


def own_units(folds: Folds, scaled: Column) -> Column:
    """A scaled target as it was."""
    at = len(folds.features)
    return F.col("_mean")[at] + F.col("_std")[at] * scaled


def predict_folds(df: DataFrame, folds: Folds) -> DataFrame:
    """``code, date, target, prediction`` of every row with a target, by the fold of its year, in the target's own units.

    Rows whose station (with ``basin`` scaling) or year has no training row have no prediction and are left out.
    """
    rows = with_fold(folds.complete(df), folds, F.year("date"))
    return rows.select("code", "date", folds.target, own_units(folds, scaled_prediction(folds)).alias("prediction"))
