"""Group-by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rounding import stable_round
from ..session import deal
from .merge import dedupe
from .quantiles import exact_quantiles

# Quantile levels of probabilistic forecasts, Q5..Q95 in steps of 5.
FORECAST_QUANTILES = {f"Q{p}": p / 100 for p in range(5, 100, 5)}


def period_norms(df: DataFrame, period: str, value: str = "discharge_avg") -> DataFrame:
    """A7."""
    return df.groupBy("code", period).agg(
        F.avg(value).alias("q_mean"), F.min(value).alias("q_min"), F.max(value).alias("q_max")
    )


def quantile_columns(value: str, probs: dict[str, float]) -> list[Column]:
    """Exact, linear interpolation.  For groups the calendar bounds (one value per year)."""
    values = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()]))
    return [values[i].alias(name) for i, name in enumerate(probs)]


RUNOFF_QUANTILES = {"q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}


def runoff_stats(df: DataFrame, period: str, as_of_year: int, value: str = "discharge_avg") -> DataFrame:
    """Climatology per (code, period) without the current year."""
    past = df.where(F.year("date") != as_of_year)
    return past.groupBy("code", period).agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *quantile_columns(value, RUNOFF_QUANTILES),
    )


def daily_mean_readings(readings: DataFrame, value: str = "value") -> DataFrame:
    """Intra-day readings -> mean per (code, UTC day).

    ``sum`` and ``count`` combine map-side, so a day with very many readings ships one
    row per task.
    """
    return readings.groupBy("code", F.to_date("ts").alias("date")).agg(F.avg(value).alias("discharge"))


def classify_site_types(payload_rows: DataFrame) -> DataFrame:
    """Which station types a site reports under."""
    hydro = F.bool_or(F.col("station_type") == "hydro")
    meteo = F.bool_or(F.col("station_type") == "meteo")
    kind = F.when(hydro & meteo, "both").when(hydro, "hydro").when(meteo, "meteo").otherwise("none")
    return payload_rows.groupBy("code").agg(kind.alias("site_type"))


def monthly_station(df: DataFrame) -> DataFrame:
    """Decadal meteo values -> month; precipitation is summed, the rest averaged."""
    total = F.lower(F.col("variable")).contains("precipitation")
    return (
        df.groupBy("code", "variable", F.trunc("date", "month").alias("date"))
        .agg(
            F.sum("value").alias("_sum"),
            F.avg("value").alias("_avg"),
            F.min_by("unit", "date").alias("unit"),
        )
        .select(
            "code", "variable", "date",
            F.when(total, F.col("_sum")).otherwise(F.col("_avg")).alias("value"),
            "unit",
        )
    )


def virtual_station(df: DataFrame, rules: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sum of contributing stations per (virtual code, date, ...).

    ``rules`` rows: ``virtual_code, code, weight, position`` (position 0 = first listed).
    Null when any contributor is missing or null; only dates the first contributor has;
    an existing own record keeps everything before its last date.
    """
    keys = ["virtual_code", "date", *extra]
    needed = F.count(F.lit(1)).over(Window.partitionBy("virtual_code"))
    parts = df.join(rules.withColumn("_needed", needed), "code")
    total = parts.groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("discharge")).alias("_sum"),
        F.count("discharge").alias("_have"),
        F.max("_needed").alias("_needed"),
        F.bool_or(F.col("position") == 0).alias("_first"),
    )
    out = total.where("_first").select(
        F.col("virtual_code").alias("code"),
        "date",
        *extra,
        F.when(F.col("_have") == F.col("_needed"), F.col("_sum")).alias("discharge"),
    )
    own = df.join(rules.select(F.col("virtual_code").alias("code")).distinct(), "code", "left_semi")
    last = own.groupBy("code").agg(F.max("date").alias("_last"))
    out = out.join(last, "code", "left")
    return out.where(F.col("_last").isNull() | (F.col("date") >= F.col("_last"))).drop("_last")


def station_norm_compare(df: DataFrame, as_of_year: int) -> DataFrame:
    """This year against last year and the day-month norm, as a long table."""
    keys = ["code", "variable"]
    norm = df.groupBy(*keys, F.month("date").alias("_m"), F.dayofmonth("date").alias("_d")).agg(
        F.avg("value").alias("value_norm")
    )
    now = df.where(F.year("date") == as_of_year).withColumns(
        {"_m": F.month("date"), "_d": F.dayofmonth("date")}
    ).withColumnRenamed("value", "value_current")
    before = df.where(F.year("date") == as_of_year - 1).select(
        *keys, F.add_months("date", 12).alias("date"), F.col("value").alias("value_last")
    )
    both = now.join(before, [*keys, "date"]).join(norm, [*keys, "_m", "_d"])

    def percent(base: str) -> Column:
        diff = F.col("value_current") - F.col(base)
        return F.when(F.col(base) == 0, 100.0).otherwise(diff / F.nullif(F.col(base), F.lit(0.0)) * 100)

    both = both.withColumns(
        {
            "diff_last_year": F.col("value_current") - F.col("value_last"),
            "diff_norm": F.col("value_current") - F.col("value_norm"),
            "percentage_last_year": percent("value_last"),
            "percentage_norm": percent("value_norm"),
        }
    )
    types = [
        "value_current", "value_last", "value_norm", "diff_last_year", "diff_norm",
        "percentage_last_year", "percentage_norm",
    ]
    long = both.unpivot([*keys, "date", "unit"], types, "type", "value")
    unit = F.when(F.col("type").contains("percentage"), "%").otherwise(F.col("unit"))
    return long.withColumns({"unit": unit, "value": stable_round("value", 2)})


def daily_forcing_norm(df: DataFrame, value: str, as_of_year: int) -> DataFrame:
    """Mean per day of year dated in the current year; day 366 only in leap years."""
    leap = cal.is_leap_year(F.lit(as_of_year))
    norm = df.groupBy("code", F.dayofyear("date").alias("_doy")).agg(
        stable_round(F.avg(value), 2).alias(f"{value}_norm")
    )
    first = F.make_date(F.lit(as_of_year), F.lit(1), F.lit(1))
    return norm.where((F.col("_doy") <= 365) | leap).select(
        "code", F.date_add(first, F.col("_doy") - 1).alias("date"), f"{value}_norm"
    )


def snow_norm(df: DataFrame, as_of_year: int, value: str = "value", keys=("code", "var")) -> DataFrame:
    """Mean per day of year without the shown year."""
    first = F.make_date(F.lit(as_of_year), F.lit(1), F.lit(1))
    return (
        df.where(F.year("date") != as_of_year)
        .groupBy(*keys, F.dayofyear("date").alias("doy"))
        .agg(F.avg(value).alias("norm"))
        .withColumn("date", F.date_add(first, F.col("doy") - 1))
    )


def ensemble_stats(df: DataFrame, value: str = "value", keys=("code", "date")) -> DataFrame:
    """Spread and Q5..Q95 over ensemble members, in one aggregation.

    ``percentile`` counts equal values before the shuffle and holds a group's distinct values only.
    """
    sd = F.stddev_samp(value).alias("sd")
    return df.groupBy(*keys).agg(sd, *quantile_columns(value, FORECAST_QUANTILES))


def ensemble_stats_ranked(df: DataFrame, value: str = "value", keys=("code", "date"), tasks: int | None = None) -> DataFrame:
    """A20 for members whose distinct values are too many for one task: ranked over range partitions."""
    ranked = exact_quantiles(df, list(keys), value, FORECAST_QUANTILES, tasks)
    spread = df.groupBy(*keys).agg(F.stddev_samp(value).alias("sd"))
    return deal(spread, tasks, *keys).join(ranked, list(keys), "left")


def daily_to_period(df: DataFrame, horizon, value: str = "Q50") -> DataFrame:
    """Daily lead values of issue dates -> mean over the first target period,
    the one that holds the day after the issue date."""
    h = cal.horizon_of(horizon)
    first_end = cal.next_issue_date(F.date_add("forecast_date", 1), h)
    rows = df.where(
        cal.is_issue_date("forecast_date", h)
        & (F.col("date") > F.col("forecast_date"))
        & (F.col("date") <= first_end)
    )
    return rows.groupBy("code", F.col("forecast_date")).agg(F.avg(value).alias("forecasted_discharge"))


def latest_date_per_site(df: DataFrame) -> DataFrame:
    """A22."""
    return df.groupBy("code").agg(F.max("date").alias("last_date"))


def fetch_ranges(sites: DataFrame, latest: DataFrame, end_date, lookback_days: int) -> DataFrame:
    """One row per station with its request's month and the month's first start.

    The station list of a month stays rows (month, start_date, code): it grows with the
    network and must not become one array.
    """
    end = F.lit(end_date).cast("date")
    per_site = sites.select("code").distinct().join(latest, "code", "left").select(
        "code",
        F.coalesce(F.least(F.date_add("last_date", 1), end), F.date_sub(end, lookback_days)).alias("site_start"),
    ).withColumn("month", F.date_format("site_start", "yyyy-MM"))
    starts = per_site.groupBy("month").agg(F.min("site_start").alias("start_date"))
    return per_site.join(starts, "month").select("month", "start_date", "code", "site_start")


def recency_check(expected: DataFrame, df: DataFrame, as_of, max_age_days: int = 3) -> DataFrame:
    """A24."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), max_age_days)
    joined = expected.select("code").distinct().join(latest_date_per_site(df), "code", "left")
    return joined.withColumn("recent", F.coalesce(F.col("last_date") >= cutoff, F.lit(False)))


def reliability_stats(stats: DataFrame, check: DataFrame, as_of) -> DataFrame:
    """State table (code, checks, recent_data_present, reliability_pct, last_gap_date)
    after one more check."""
    old = stats.select(
        "code", F.col("checks").alias("_c"), F.col("recent_data_present").alias("_p"),
        F.col("last_gap_date").alias("_g"),
    )
    joined = old.join(check.select("code", "recent"), "code", "full_outer")
    seen = F.col("recent").isNotNull().cast("bigint")
    checks = F.coalesce("_c", F.lit(0)) + seen
    present = F.coalesce("_p", F.lit(0)) + F.coalesce(F.col("recent").cast("bigint"), F.lit(0))
    gap = F.when(~F.col("recent"), F.lit(as_of).cast("date")).otherwise(F.col("_g"))
    pct = F.when(checks > 0, stable_round(100.0 * present / checks, 1)).otherwise(0.0)
    return joined.select(
        "code", checks.alias("checks"), present.alias("recent_data_present"),
        pct.alias("reliability_pct"), gap.alias("last_gap_date"),
    )


def low_reliability(stats: DataFrame, min_checks: int = 5, below: float = 80.0) -> DataFrame:
    return stats.where((F.col("checks") >= min_checks) & (F.col("reliability_pct") < below))


def spot_check(sites: DataFrame, reference: DataFrame, output: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Newest reference value of each site against the output of the same date.

    ``match`` is null (an error) when either side is missing.
    """
    newest = reference.where(F.col("value").isNotNull()).groupBy("code").agg(
        F.max("date").alias("date"), F.max_by("value", "date").alias("reference_value")
    )
    out = output.select("code", "date", F.col("discharge").alias("output_value"))
    match = F.abs(F.col("reference_value") - F.col("output_value")) < tolerance
    return (
        sites.select("code").distinct().join(newest, "code", "left")
        .join(out, ["code", "date"], "left")
        .withColumn("match", match)
    )


def spot_check_dual(first: DataFrame, second: DataFrame) -> DataFrame:
    """Matched when either variable matches."""
    a = first.select("code", F.col("match").alias("_a"))
    b = second.select("code", F.col("match").alias("_b"))
    either = F.when(F.col("_a") | F.col("_b"), True).when(F.col("_a").isNull() & F.col("_b").isNull(), None).otherwise(False)
    return a.join(b, "code", "full_outer").select("code", either.alias("match"))


def spot_check_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("match")).alias("matched"),
        F.count_if(~F.col("match")).alias("mismatched"),
        F.count_if(F.col("match").isNull()).alias("errors"),
    )


def null_flags(df: DataFrame, threshold: int, value: str = "discharge") -> DataFrame:
    """Null counts of a station's window -> exceeds / inside / at the end."""
    last = df.groupBy("code").agg(F.max(F.when(F.col(value).isNotNull(), F.col("date"))).alias("_last"))
    missing = F.col(value).isNull()
    tail = missing & (F.col("_last").isNull() | (F.col("date") > F.col("_last")))
    counts = df.join(last, "code").groupBy("code").agg(
        F.count_if(missing).alias("nulls"),
        F.least(F.count_if(tail), F.lit(threshold)).alias("nulls_at_end"),
    )
    return counts.withColumns(
        {
            "exceeds_threshold": F.col("nulls") > threshold,
            "nans_in_between": F.col("nulls") - F.col("nulls_at_end") > 0,
            "nans_at_end": F.col("nulls_at_end") > 0,
        }
    )


def monthly_frame(df: DataFrame, discharge: str = "discharge", minimum: int = 15) -> DataFrame:
    """Discharge mean (with enough valid days), T mean, P sum per month."""
    return df.groupBy("code", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.when(F.count(discharge) >= minimum, F.avg(discharge)).alias(discharge),
        F.avg("T").alias("T"),
        F.sum("P").alias("P"),
    )


def basin_statistics(train: DataFrame, columns: list[str], per_basin: bool = True) -> DataFrame:
    """Long table (code, feature, mean, std); a zero or missing spread becomes 1."""
    long = train.unpivot(["code"], columns, "feature", "value")
    keys = ["code", "feature"] if per_basin else ["feature"]
    std = F.coalesce(F.nullif(F.stddev_samp("value"), F.lit(0.0)), F.lit(1.0))
    return long.groupBy(*keys).agg(F.avg("value").alias("mean"), std.alias("std"))


def basin_scaler(train: DataFrame, target: DataFrame, columns: list[str], per_basin: bool = True) -> DataFrame:
    """Scale ``target`` with statistics of ``train``."""
    aggs = [
        e for c in columns for e in (
            F.avg(c).alias(f"_m_{c}"),
            F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}"),
        )
    ]
    if per_basin:
        joined = target.join(train.groupBy("code").agg(*aggs), "code", "left")
    else:
        stats = train.agg(F.struct(*aggs).alias("_s")).scalar()
        joined = target.withColumn("_stats", stats).select("*", "_stats.*").drop("_stats")
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(scaled).select(*target.columns)


def elevation_bands(bands: DataFrame, n: int = 3) -> DataFrame:
    """Assign each elevation band (code, band, area) to one of ``n`` area percentiles.

    Bands of a station without area belong to none.
    """
    w = Window.partitionBy("code").orderBy("band")
    total = F.sum("area").over(Window.partitionBy("code"))
    share = F.try_divide(F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0)), total)
    group = F.when(share.isNotNull(), n)
    for i in range(n - 1, 0, -1):
        group = F.when(share <= i / n, i).otherwise(group)
    return bands.withColumn("percentile_band", group)


def snow_by_elevation(snow: DataFrame, bands: DataFrame, n: int = 3) -> DataFrame:
    """Area-weighted snow per percentile band (unknown bands count as zero)."""
    groups = elevation_bands(bands, n)
    weights = groups.groupBy("code", "percentile_band").agg(F.sum("area").alias("_total"))
    rows = snow.join(groups, ["code", "band"])
    sums = rows.groupBy("code", "date", "var", "percentile_band").agg(
        F.sum(F.col("value") * F.col("area")).alias("_sum")
    )
    out = sums.join(weights, ["code", "percentile_band"]).where(F.col("_total") != 0)
    return out.select(
        "code", "date", "var", "percentile_band", (F.col("_sum") / F.col("_total")).alias("value")
    )


def band_area_weighting(snow: DataFrame, bands: DataFrame) -> DataFrame:
    """A31."""
    rows = snow.join(bands.select("code", "band", "area"), ["code", "band"], "left")
    return rows.withColumn("value", F.col("value") * F.col("area")).drop("area")


def gap_summary(gaps: DataFrame) -> DataFrame:
    """A36."""
    days = F.datediff("gap_end", "gap_start") + 1
    return gaps.groupBy("code").agg(F.count(F.lit(1)).alias("gaps"), F.sum(days).alias("gap_days"))


def retrieval_summary(requested: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row of counts, built from scalar subqueries."""
    wanted = requested.select("code").distinct()
    got = delivered.select("code").distinct()
    missing = wanted.join(got, "code", "left_anti")
    count = F.count(F.lit(1))
    return delivered.agg(
        count.alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ).select(
        wanted.agg(count.alias("n")).scalar().alias("sites_requested"),
        got.agg(count.alias("n")).scalar().alias("sites_delivered"),
        missing.agg(count.alias("n")).scalar().alias("sites_missing"),
        "records", "first_date", "last_date",
    )


def pivot_recent_log(df: DataFrame, horizon, models: list[str]) -> DataFrame:
    """Newest date, one row per station and a column per model.

    Stations without a row on that date appear with nulls and the period of their own
    newest record.
    """
    h = cal.horizon_of(horizon)
    newest = df.agg(F.max("date").alias("d"))
    recent = df.where(F.col("date") == newest.scalar())
    wide = recent.groupBy("code", "date", h.in_month).pivot("model_short", models).agg(
        F.first("forecasted_discharge", ignorenulls=True)
    )
    last = df.groupBy("code").agg(F.max_by(h.in_month, "date").alias(h.in_month))
    absent = last.join(recent.select("code").distinct(), "code", "left_anti")
    absent = absent.withColumn("date", newest.scalar())
    return wide.unionByName(absent, allowMissingColumns=True)


def predictor_window_totals(df: DataFrame, date, horizon, total: bool, value: str) -> DataFrame:
    """Sum (precipitation) or mean (temperature, snow) in both display windows."""
    agg = F.sum if total else F.avg
    bounds = cal.forecast_window(F.lit(date).cast("date"), horizon)
    d = F.col("date")
    before = d.between(bounds["predictor_start"], bounds["predictor_end"])
    after = d.between(bounds["forecast_start"], bounds["forecast_end"])
    return df.where(before | after).groupBy("code").agg(
        agg(F.when(before, F.col(value))).alias("predictor_window"),
        agg(F.when(after, F.col(value))).alias("forecast_window"),
    )


def stations_by_basin(registry: DataFrame) -> DataFrame:
    """Station labels of each basin, one row per station in label order.

    The list stays rows; a basin may hold any number of stations.
    """
    label = F.concat_ws(" - ", "code", "name")
    return registry.select("basin", label.alias("label")).orderBy("basin", "label")


def last_forecast_date(*tables: DataFrame) -> DataFrame:
    """Newest forecast date of each gauge over several horizons."""
    from .merge import stack

    return latest_date_per_site(stack(*[t.select("code", "date") for t in tables]))


def model_names(df: DataFrame, station: str, date) -> DataFrame:
    """Labels of the models that forecast a station on a date, last row per model."""
    rows = df.where((F.col("code") == station) & (F.col("date") == F.lit(date).cast("date")))
    return dedupe(rows.select("model_short", "model_long", "priority"), ["model_short"], F.col("priority")).drop("priority")
