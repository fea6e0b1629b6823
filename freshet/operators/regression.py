"""Period regressions and site forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics
from ..functions.rounding import discharge_range, percent_of_norm, round_significant
from ..schemas import require_columns
from .joins import select_points
from .skill import DELTA_FACTOR

FITTED = ("slope", "intercept", "rsquared", "q_mean", "q_std_sigma", "delta")


def _fit(y: Column, x: Column) -> dict[str, Column]:
    """Sufficient-statistics aggregates of a least-squares line (partial, one pass)."""
    return {
        "_n": F.regr_count(y, x),
        "slope": F.regr_slope(y, x),
        "intercept": F.regr_intercept(y, x),
        "rsquared": F.regr_r2(y, x),
        "q_mean": F.avg(y),
        "q_std_sigma": F.stddev_pop(y),
    }


def _gated(fit: dict[str, Column]) -> dict[str, Column]:
    """More than two points are needed for any result."""
    out = {n: F.when(fit["_n"] > 2, c) for n, c in fit.items() if n != "_n"}
    out["delta"] = DELTA_FACTOR * out["q_std_sigma"]
    return out


def _complete(columns: list[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def fit_period_regression(df: DataFrame, period: str = "issue_period", predictor: str = "predictor", target: str = "discharge_avg", complete: list[str] | None = None) -> DataFrame:
    """R1 for all stations and periods at once: one fit per (code, period).

    A row takes part only when all ``complete`` columns (default: all columns) are known.
    """
    require_columns(df, "code", period, predictor, target)
    rows = df.dropna(subset=complete or df.columns)
    fit = _gated(_fit(F.col(target), F.col(predictor)))
    return rows.groupBy("code", period).agg(*[c.alias(n) for n, c in fit.items()])


def forecast_period(df: DataFrame, number: int, period: str = "issue_period") -> DataFrame:
    """The rows of one period with their station's fit and prediction."""
    rows = df.where(F.col(period) == number)
    fit = fit_period_regression(rows, period)
    out = rows.join(fit, ["code", period], "left")
    return out.withColumn(
        "forecasted_discharge", physics.linear_prediction("slope", "predictor", "intercept")
    )


def hindcast_regression(df: DataFrame, period: str = "issue_period", parity: bool = False) -> DataFrame:
    """R2: every issue date predicted from the dates before it, in one window pass.

    The default leaves the predicted row out of its own fit; ``parity`` includes it, as
    the reference's hindcast does.  Only issue dates are predicted; window groups hold
    one row per year.
    """
    if "issue_date" in df.columns:
        df = df.where("issue_date")
    usable = _complete([c for c in df.columns if c not in ("code", period)])
    x = F.when(usable, F.col("predictor"))
    y = F.when(usable, F.col("discharge_avg"))
    w = Window.partitionBy("code", period).orderBy("date").rowsBetween(
        Window.unboundedPreceding, 0 if parity else -1
    )
    fit = _gated({n: c.over(w) for n, c in _fit(y, x).items()})
    return df.withColumns(fit).withColumn(
        "forecasted_discharge", physics.linear_prediction("slope", "predictor", "intercept")
    )


def point_selected_regression(df: DataFrame, selection: DataFrame, period: str = "issue_period") -> DataFrame:
    """Fit on the visible years only."""
    return fit_period_regression(select_points(df, selection, period).drop("year"), period)


def site_forecast(series: DataFrame, fits: DataFrame, norms: DataFrame, as_of, period: str = "issue_period") -> DataFrame:
    """One row per site - predictor on the date, forecast (never negative), norms,
    percent of norm and printed range.  Predictor and forecast are rounded to valid digits first.

    ``as_of`` may be a list of dates: the predictor is then the mean of those known, the period that of the site's latest
    date.  A site without a row on any of them has no forecast.
    """
    if isinstance(as_of, list | tuple):
        dates = [F.lit(d).cast("date") for d in as_of]
        today = series.where(F.col("date").isin(*dates)).groupBy("code").agg(
            F.max_by(period, "date").alias(period), F.avg("predictor").alias("predictor")
        )
    else:
        today = series.where(F.col("date") == F.lit(as_of).cast("date")).select("code", period, "predictor")
    today = today.select("code", period, round_significant("predictor").alias("predictor"))
    rows = today.join(fits.select("code", period, "slope", "intercept", "delta"), ["code", period], "left")
    rows = rows.join(norms.withColumnRenamed("q_mean", "q_norm"), ["code", period], "left")
    rows = rows.withColumn(
        "fc_qexp", round_significant(physics.linear_prediction("slope", "predictor", "intercept", clip=True))
    )
    return rows.withColumn("perc_norm", percent_of_norm("fc_qexp", "q_norm")).withColumns(
        discharge_range("fc_qexp", "delta")
    )


def predictor_from_readings(daily: DataFrame, morning: DataFrame, as_of, days: int = 3, lag_days: int = 20, mean: bool = False) -> DataFrame:
    """Predictor of each station from daily means and the morning value.

    Daily means of the ``days - 1`` days before ``as_of`` count; without any, the newest
    earlier day within ``lag_days`` does.  Negative values are missing, a missing day is
    replaced by the mean of the known ones.
    """
    day = F.lit(as_of).cast("date")
    start = F.date_sub(day, days - 1)
    recent = daily.where((F.col("date") < day) & (F.col("date") >= F.date_sub(start, lag_days)))
    value = F.when(F.col("discharge") >= 0, round_significant("discharge"))
    inside = F.col("date") >= start
    stats = recent.groupBy("code").agg(
        F.count_if(inside).alias("_rows"),
        F.count(F.when(inside, value)).alias("_n"),
        F.sum(F.when(inside, value)).alias("_sum"),
        F.max_by(value, F.when(value.isNotNull(), F.col("date"))).alias("_newest"),
    )
    first = morning.where(F.to_date("ts") == day).groupBy("code").agg(
        round_significant(F.max_by("value", "ts")).alias("_morning")
    )
    joined = stats.join(first, "code", "left")
    some = F.col("_rows") > 0
    total = F.when(some, F.coalesce("_sum", F.lit(0.0))).otherwise(F.coalesce("_newest", F.lit(0.0)))
    known = F.when(some, F.col("_n")).otherwise(F.col("_newest").isNotNull().cast("bigint"))
    last = F.coalesce("_morning", "_newest")
    n = known + last.isNotNull().cast("bigint")
    total = total + F.coalesce(last, F.lit(0.0))
    average = total / F.nullif(n, F.lit(0))
    held = F.when(some, F.col("_rows")).otherwise(1) + 1
    filled = F.when(held < days, total + average).otherwise(total)
    return joined.select("code", F.when(n > 0, average if mean else filled).alias("predictor"))
