"""Registration of runnable queries and their equivalent SQL.

``shape`` names columns whose type or rounding is fixed on both sides:
``r<n>`` rounds a double to n decimals (first five digits further out, so sums added in
another order cannot fall on the other side of a tie); ``i`` / ``l`` cast to INT / BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import with_views
from .views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _parse(shape: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in shape.split()]


def _shape_spark(df: DataFrame, shape: str) -> DataFrame:
    out = {}
    for name, kind in _parse(shape):
        c = F.col(f"`{name}`")
        if kind[0] == "r":
            n = int(kind[1:])
            out[name] = F.round(F.round(c.cast("double"), n + 5), n) + F.lit(0.0)
        else:
            out[name] = c.cast("int" if kind == "i" else "bigint")
    return df.withColumns(out)


def _shape_sql(body: str, shape: str) -> str:
    parts = []
    for name, kind in _parse(shape):
        if kind[0] == "r":
            n = int(kind[1:])
            parts.append(f'round(round(CAST("{name}" AS DOUBLE), {n + 5}), {n}) + 0.0 AS "{name}"')
        else:
            parts.append(f'CAST("{name}" AS {"INTEGER" if kind == "i" else "BIGINT"}) AS "{name}"')
    replace = f" REPLACE ({', '.join(parts)})" if parts else ""
    return f"SELECT *{replace} FROM (\n{body}\n) AS shaped"


def query(name: str, sql: str | None = None, shape: str = ""):
    """Register a function ``Tables -> DataFrame`` and, where possible, its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _shape_spark(fn(Tables(spark, folder)), shape)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(_shape_sql(sql, shape))
        return fn

    return register
