"""Climatological hydrographs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rounding import stable_round
from .aggregates import RUNOFF_QUANTILES, quantile_columns


def explode_norms(norms: DataFrame, horizon) -> DataFrame:
    """Per-station arrays of 72 or 36 values -> (code, period, norm).

    An array of any other length counts as unknown.
    """
    h = cal.horizon_of(horizon)
    valid = norms.where(F.size("norms") == h.per_year)
    return valid.select("code", F.posexplode("norms").alias("_pos", "norm")).select(
        "code", (F.col("_pos") + 1).alias(h.in_year), "norm"
    )


def period_hydrograph(series: DataFrame, horizon, as_of_year: int, norms: DataFrame | None = None) -> DataFrame:
    """Climatology (without the current year), norm, last and current year per
    (code, target period), in one group-by.

    Last and current year are conditional aggregates, so J4 needs no join; percentiles
    see one value per year.  The shown date is last year's issue date moved one year on
    (D9); a period without a record last year gets its own issue date (D8).
    """
    h = cal.horizon_of(horizon)
    issued = series.where(F.col("issue_date"))
    value, year = F.col("discharge_avg"), F.year("date")
    past = F.when(year != as_of_year, value)
    prior = year == as_of_year - 1
    shown = cal.leap_clipped("date", F.lit(as_of_year))
    stats = issued.groupBy("code", F.col("target_period").alias(h.in_year)).agg(
        F.avg(past).alias("mean"),
        F.min(past).alias("min"),
        F.max(past).alias("max"),
        *quantile_columns(past, RUNOFF_QUANTILES),
        F.max_by(value, F.when(prior, F.col("date"))).alias("last_year"),
        F.max_by(value, F.when(year == as_of_year, F.col("date"))).alias("current_year"),
        F.add_months(F.max(F.when(prior, shown)), 12).alias("_date"),
        F.max(F.when(prior, cal.aligned_day_of_year("date", F.lit(as_of_year)))).alias("_doy"),
        F.count_if(year != as_of_year).alias("_past_rows"),
    ).where(F.col("_past_rows") > 0).drop("_past_rows")
    if norms is not None:
        stats = stats.join(explode_norms(norms, h), ["code", h.in_year], "left")
    else:
        stats = stats.withColumn("norm", F.lit(None).cast("double"))
    numbers = ["mean", "min", "max", "q05", "q25", "q75", "q95", "norm", "last_year", "current_year"]
    issue = cal.issue_date_of_period(h.in_year, F.lit(as_of_year), h)
    return stats.withColumns({n: stable_round(n, 3) for n in numbers}).withColumns(
        {
            "date": F.coalesce("_date", issue),
            "day_of_year": F.coalesce("_doy", F.dayofyear(issue)),
            h.in_month: cal.period_in_month_of(h.in_year, h),
        }
    ).drop("_date", "_doy")


def align_years(df: DataFrame, as_of_year: int) -> DataFrame:
    """Last year's rows moved to the current year's axis."""
    y = F.lit(as_of_year)
    prior = F.year("date") == as_of_year - 1
    return df.withColumns(
        {
            "day_of_year": cal.aligned_day_of_year("date", y),
            "shown_date": F.when(prior, F.add_months("date", 12)).otherwise(F.col("date")),
        }
    )


DAILY_QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q95": 0.95}


def daily_hydrograph(df: DataFrame, as_of_year: int) -> DataFrame:
    """A10: statistics per (code, normalised day), mapped back to calendar days."""
    q, year = F.col("discharge"), F.year("date")
    stats = df.groupBy("code", cal.normalized_day("date").alias("_norm_day")).agg(
        F.count(q).alias("count"),
        F.avg(q).alias("mean"),
        F.stddev_samp(q).alias("std"),
        F.min(q).alias("min"),
        *quantile_columns(q, DAILY_QUANTILES),
        F.max(q).alias("max"),
        F.avg(F.when(year == as_of_year - 1, q)).alias("last_year"),
        F.avg(F.when(year == as_of_year, q)).alias("current_year"),
    )
    first = F.make_date(F.lit(as_of_year), F.lit(1), F.lit(1))
    days = cal.calendar_days_of("_norm_day", F.lit(as_of_year))
    return (
        stats.withColumn("day_of_year", F.explode(days))
        .withColumn("date", F.date_add(first, F.col("day_of_year") - 1))
        .drop("_norm_day")
    )


def danger_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach the danger level, null when unknown."""
    return df.join(thresholds.select("code", "dangerous_discharge"), "code", "left")
