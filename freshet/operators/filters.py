"""Row and station selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_name


def filter_code_date(df: DataFrame, codes: DataFrame, until) -> DataFrame:
    """F1."""
    return filter_selected(df.where(F.col("date") <= F.lit(until).cast("date")), codes)


def filter_selected(df: DataFrame, codes: DataFrame) -> DataFrame:
    """a semi join, so the selection may be of any size."""
    return df.join(codes.select("code").distinct(), "code", "left_semi")


def codes_in_all(*tables: DataFrame) -> DataFrame:
    """F9."""
    return reduce(lambda a, b: a.intersect(b), [t.select("code") for t in tables])


def predictable_rivers(pentad: DataFrame, decad: DataFrame, flags: DataFrame, model: str) -> DataFrame:
    """selected stations whose flag for ``model`` is set."""
    on = flags.where(F.col(model)).select("code")
    return pentad.select("code").union(decad.select("code")).distinct().join(on, "code", "left_semi")


def sites_due(sites: DataFrame, horizon: str) -> DataFrame:
    """stations (or virtual stations) with the horizon enabled, flattened, in
    bulletin order."""
    parts = split_name("official_name")
    return (
        sites.where(F.col("enabled_forecasts")[f"{horizon}_forecast"])
        .select(
            F.col("site_code").alias("code"),
            F.col("official_name").alias("name"),
            parts["river"].alias("river_name"),
            parts["place"].alias("punkt_name"),
            F.col("region.name").alias("region"),
            F.col("basin.name").alias("basin"),
            "bulletin_order",
        )
        .orderBy("basin", "bulletin_order")
    )


def decad_from_pentad_sites(sites: DataFrame, decad: DataFrame, restriction: DataFrame | None = None) -> DataFrame:
    """F13."""
    out = filter_selected(sites, decad)
    return out if restriction is None else filter_selected(out, restriction)


def day_window(df: DataFrame, month_day: str) -> DataFrame:
    """one calendar day over all years, 'M-d'."""
    month, day = (int(x) for x in month_day.split("-"))
    return df.where((F.month("date") == month) & (F.dayofmonth("date") == day))


def forecast_list(registry: DataFrame) -> DataFrame:
    """F16: stations for forecasting have codes starting with '1'."""
    return registry.where(F.col("code").startswith("1"))


def configuration_list(registry: DataFrame, excluded: DataFrame) -> DataFrame:
    """F16: stations offered for configuration."""
    kept = registry.where(~F.col("code").startswith("3"))
    return kept.join(excluded.select("code"), "code", "left_anti")


def hindcast_bounds(forcing: DataFrame, start, end, horizon_days: int, warmup_days: int = 60) -> DataFrame:
    """one row with the allowed span and whether the requested one fits."""
    span = forcing.agg(
        F.date_add(F.min("date"), warmup_days).alias("earliest"),
        F.date_sub(F.max("date"), horizon_days).alias("latest"),
    )
    ok = (F.lit(start).cast("date") >= F.col("earliest")) & (F.lit(end).cast("date") <= F.col("latest"))
    return span.withColumn("valid", ok)


def require_hindcast_bounds(forcing: DataFrame, start, end, horizon_days: int, warmup_days: int = 60) -> DataFrame:
    """F17 as a guard: the forcing itself, failing at run time when the span does not fit."""
    check = hindcast_bounds(forcing, start, end, horizon_days, warmup_days).select(
        F.assert_true("valid", F.lit("hindcast span exceeds the forcing record")).isNull().alias("ok")
    )
    return forcing.where(check.scalar())


def stations_without_data(registry: DataFrame, df: DataFrame, as_of) -> DataFrame:
    """stations with no observation on a date."""
    day = df.where((F.col("date") == F.lit(as_of).cast("date")) & F.col("discharge").isNotNull())
    return registry.select("code").join(day.select("code"), "code", "left_anti")


def missing_forecasts(registry: DataFrame, forecasts: DataFrame, as_of, models: list[str]) -> DataFrame:
    """stations with the models that have a null or no forecast on a date.

    The array is bounded by the fixed list of models.
    """
    due = registry.select("code", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_short"))
    made = forecasts.where(
        (F.col("date") == F.lit(as_of).cast("date")) & F.col("forecasted_discharge").isNotNull()
    )
    absent = due.join(made.select("code", "model_short"), ["code", "model_short"], "left_anti")
    return absent.groupBy("code").agg(F.array_sort(F.collect_set("model_short")).alias("models"))
