"""Joins between forecasts, observations, forcing and registry.

No broadcast hints: Catalyst and AQE broadcast a side when its measured size is under
the threshold, and split skewed partitions of the sort-merge join otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.text import site_label


def with_stats(observed: DataFrame, stats: DataFrame) -> DataFrame:
    """J6."""
    return observed.join(stats.select("date", "code", "q_mean", "q_std_sigma", "delta"), ["date", "code"], "left")


def calendar_scaffold(df: DataFrame, start=None, end=None) -> DataFrame:
    """Every station on every day of the common span.

    The span is a one-row aggregate used as scalar subqueries; each station explodes its
    own sequence, so no cross join is planned.
    """
    span = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    first = F.lit(start).cast("date") if start else span.select("a").scalar()
    last = F.lit(end).cast("date") if end else span.select("b").scalar()
    codes = df.select("code").distinct()
    days = codes.select("code", F.explode(F.sequence(first, last)).alias("date"))
    return days.join(df, ["code", "date"], "left")


def merge_forcing(p: DataFrame, t: DataFrame, how: str = "inner") -> DataFrame:
    """J8."""
    return p.join(t, ["code", "date"], how)


def left_chain(base: DataFrame, *tables: DataFrame) -> DataFrame:
    """Base with each table attached by (date, code)."""
    return reduce(lambda a, b: a.join(b, ["date", "code"], "left"), tables, base)


def norm_with_operational(norm: DataFrame, operational: DataFrame) -> DataFrame:
    """J10."""
    return norm.join(operational, ["code", "date"], "left")


def select_points(df: DataFrame, selection: DataFrame, period: str) -> DataFrame:
    """Keep the years marked visible; a (code, period) without any mark keeps all."""
    marks = selection.select("code", period, "year", "visible")
    marked = marks.select("code", period).distinct().withColumn("_marked", F.lit(True))
    rows = df.withColumn("year", F.year("date")).join(marks, ["code", period, "year"], "left")
    rows = rows.join(marked, ["code", period], "left")
    return rows.where(F.col("visible") | F.col("_marked").isNull()).drop("visible", "_marked")


def forecasts_with_skill(forecasts: DataFrame, skill: DataFrame, period: str) -> DataFrame:
    """J12."""
    keys = ["code", period, "model_short"]
    return forecasts.join(skill.select(*keys, "sdivsigma", "nse", "accuracy", "mae"), keys, "left")


def with_labels(df: DataFrame, registry: DataFrame) -> DataFrame:
    """J13."""
    names = registry.select("code", "name", "basin")
    return df.join(names, "code", "left").withColumn("station_label", site_label("code", "name"))


def in_spans(df: DataFrame, day: str, spans: DataFrame, start: str, end: str, keys: list[str], width: int = 32) -> DataFrame:
    """Rows whose ``day`` lies in a span of their keys, both ends included; each once.

    The calendar is cut into bins of ``width`` days.  A span meets the rows of the bins that it touches by an equality that
    Spark can hash or merge, and a range test decides, so a span counts once per ``width`` days and not once a day, and a
    hot key is spread over its bins.  Spans without a start or an end, or that end before they start, hold no row.
    """
    def bin_of(c):
        return F.floor(F.date_diff(c, F.lit("1970-01-01").cast("date")) / width)

    spans = spans.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"))
    bins = spans.withColumn("_bin", F.explode(F.sequence(bin_of("_start"), bin_of("_end")))).alias("s")
    rows = df.withColumn("_bin", bin_of(day)).alias("r")
    same = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in [*keys, "_bin"]]
    return rows.join(bins, [*same, F.col(f"r.{day}").between(F.col("s._start"), F.col("s._end"))], "left_semi").drop("_bin")


def fill_gaps_from_hindcast(forecasts: DataFrame, hindcast: DataFrame, gaps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Forecast rows plus hindcast rows inside a gap span of the same keys (else of the same code)."""
    fill = in_spans(hindcast, "forecast_date", gaps, "gap_start", "gap_end", keys or ["code"])
    return forecasts.unionByName(fill, allowMissingColumns=True)


def replace_flagged(forecasts: DataFrame, hindcast: DataFrame, values: list[str]) -> DataFrame:
    """Rows flagged 1 or 2 take values and flag from the hindcast, when it has the
    same (code, forecast_date, date)."""
    keys = ["code", "forecast_date", "date"]
    other = hindcast.select(*keys, *[F.col(c).alias(f"_h_{c}") for c in [*values, "flag"]], F.lit(True).alias("_hit"))
    joined = forecasts.join(other, keys, "left")
    swap = F.col("flag").isin(1, 2) & F.coalesce("_hit", F.lit(False))
    columns = {c: F.when(swap, F.col(f"_h_{c}")).otherwise(F.col(c)) for c in [*values, "flag"]}
    return joined.withColumns(columns).select(*forecasts.columns)


def new_codes(requested: DataFrame, forecasts: DataFrame) -> DataFrame:
    """J17."""
    return requested.select("code").distinct().join(forecasts.select("code"), "code", "left_anti")


def climatology_366(df: DataFrame) -> DataFrame:
    """Mean discharge on a full 1..366 axis; day 366 borrows day 365 when unknown."""
    mean = df.groupBy("code", F.dayofyear("date").alias("day_of_year")).agg(
        F.avg("discharge").alias("discharge_daily_mean")
    )
    axis = df.select("code").distinct().select(
        "code", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("day_of_year")
    )
    borrowed = mean.where(F.col("day_of_year") == 365).select(
        "code", F.lit(366).alias("day_of_year"), F.col("discharge_daily_mean").alias("_b")
    )
    full = axis.join(mean, ["code", "day_of_year"], "left").join(borrowed, ["code", "day_of_year"], "left")
    return full.select(
        "code", "day_of_year", F.coalesce("discharge_daily_mean", "_b").alias("discharge_daily_mean")
    )


def site_statistics(hydrograph: DataFrame, series: DataFrame, horizon, period: int) -> DataFrame:
    """Per site the chosen period's climatology, last year's value and the newest
    predictor of the period before."""
    h = cal.horizon_of(horizon)
    chosen = hydrograph.where(F.col(h.in_year) == period).select(
        "code", "mean", "norm", "min", "max", "last_year"
    )
    before = (period - 2) % h.per_year + 1
    predictor = series.where(F.col("issue_date") & (F.col("issue_period") == before)).groupBy("code").agg(
        F.max_by("predictor", "date").alias("predictor")
    )
    return chosen.join(predictor, "code", "left")
