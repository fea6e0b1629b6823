"""Ordering and newest-rows views for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rounding import forecast_bounds, stable_round


def output_order(df: DataFrame, *columns: str) -> DataFrame:
    """A global sort belongs to the sink only."""
    return df.orderBy(*(columns or ("code", "date")))


def bulletin_order(df: DataFrame) -> DataFrame:
    """T2."""
    return df.orderBy("basin", "bulletin_order")


def summary_table(forecasts: DataFrame, kind: str = "delta", percent: float = 0.0) -> DataFrame:
    """T4: newest date's forecasts with bounds, rounded, by model."""
    newest = forecasts.agg(F.max("date").alias("d"))
    rows = forecasts.where(F.col("date") == newest.scalar())
    bounds = forecast_bounds("forecasted_discharge", "delta", kind, percent)
    rows = rows.withColumns({k: stable_round(v, 3) for k, v in bounds.items()})
    return rows.withColumn("forecasted_discharge", stable_round("forecasted_discharge", 3)).orderBy(
        "model_short", "code"
    )


def skill_table(skill: DataFrame, horizon) -> DataFrame:
    """T5: skill with month and period in month, in calendar order."""
    h = cal.horizon_of(horizon)
    month = (F.floor((F.col(h.in_year) - 1) / h.per_month) + 1).cast("int")
    return skill.withColumns(
        {"month": month, h.in_month: cal.period_in_month_of(h.in_year, h)}
    ).orderBy("code", "month", h.in_month, "model_short")
