"""Principal components of feature groups, fitted once and applied to any rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import components


class GroupPCA(Estimator):
    """Fits, for each group of columns, the components that explain ``variance`` of it.

    The means and covariances of all groups are one aggregate; axes are those of the covariance matrix,
    turned so that their largest loading is positive.  Rows that lack a column of a group do not count for it.  A group of
    one column, or with fewer than two rows, is left as it is.
    """

    def __init__(self, groups: dict[str, list[str]], variance: float = 0.95):
        super().__init__()
        self.groups, self.variance = groups, variance

    def _fit(self, dataset: DataFrame) -> GroupPCAModel:
        sums = {}
        for name, columns in self.groups.items():
            whole = F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x)
            known = [F.when(whole, F.col(c).cast("double")) for c in columns]
            sums[f"{name}_n"] = F.count(known[0])
            for i, x in enumerate(known):
                sums[f"{name}_m{i}"] = F.avg(x)
                for j in range(i, len(known)):
                    sums[f"{name}_c{i}_{j}"] = F.covar_samp(x, known[j])
        row = dataset.agg(*[c.alias(n) for n, c in sums.items()]).first()
        fitted = {}
        for name, columns in self.groups.items():
            size = len(columns)
            if size < 2 or row[f"{name}_n"] < 2:
                continue
            cov = np.array([[row[f"{name}_c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
            axes = components(cov, self.variance)
            axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
            fitted[name] = (columns, np.array([row[f"{name}_m{i}"] for i in range(size)]), axes)
        return GroupPCAModel(fitted)


class GroupPCAModel(Model):
    """Means and axes of each group; replaces a group's columns by ``<group>_PC1``, ``<group>_PC2``, ...

    A row that lacks a column of a group has no components of it.
    """

    def __init__(self, groups: dict[str, tuple[list[str], np.ndarray, np.ndarray]]):
        super().__init__()
        self.groups = groups

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made, gone = {}, []
        for name, (columns, mean, axes) in self.groups.items():
            for k, axis in enumerate(axes.T, 1):
                made[f"{name}_PC{k}"] = sum((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, axis, strict=True))
            gone += columns
        return dataset.withColumns(made).drop(*gone) if made else dataset

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per group, column and component."""
        rows = [
            (name, i, c, float(mean[i]), k, float(axes[i, k]))
            for name, (columns, mean, axes) in self.groups.items() for i, c in enumerate(columns) for k in range(axes.shape[1])
        ]
        schema = "name string, place int, feature string, mean double, component int, loading double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> GroupPCAModel:
        groups: dict[str, dict] = {}
        for r in spark.read.parquet(path).orderBy("name", "place", "component").collect():
            own = groups.setdefault(r["name"], {})
            own.setdefault(r.place, (r.feature, r["mean"], []))[2].append(r.loading)
        return GroupPCAModel({
            name: ([f for f, _, _ in own.values()], np.array([m for _, m, _ in own.values()]), np.array([a for _, _, a in own.values()]))
            for name, own in groups.items()
        })
