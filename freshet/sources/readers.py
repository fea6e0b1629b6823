"""Scans and typed inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from ..operators.filters import filter_selected
from ..operators.merge import dedupe, stack
from ..schemas import DAILY_TEXT, PAYLOAD, REGISTRY, REGISTRY_FIELDS, SELECTION, VIRTUAL_RULES, null_nans, require_columns


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def typed_daily(df: DataFrame) -> DataFrame:
    """Columns checked, code as text, date parsed, unreadable numbers null."""
    require_columns(df, "code", "date", "discharge")
    is_text = dict(df.dtypes)["date"] == "string"
    date = text.parse_date_mixed("date") if is_text else F.to_date("date")
    q = F.expr("try_cast(discharge AS DOUBLE)")
    return null_nans(
        df.select(text.normalize_code("code").alias("code"), date.alias("date"), q.alias("discharge"))
    )


def read_daily_discharge(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """With a declared schema, so no inference pass reads the files twice."""
    if fmt == "csv":
        raw = spark.read.schema(DAILY_TEXT).option("header", True).option("enforceSchema", False).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    return typed_daily(raw)


def read_runoff_csv_dir(spark: SparkSession, folder: str, codes: DataFrame | None = None) -> DataFrame:
    """Every CSV below a folder; the first four columns by position."""
    raw = (
        spark.read.schema("date STRING, code STRING, discharge STRING, name STRING")
        .option("header", True)
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .csv(folder)
    )
    rows = raw.select(
        text.parse_date_mixed("date").alias("date"),
        text.normalize_code("code").alias("code"),
        F.expr("try_cast(discharge AS DOUBLE)").alias("discharge"),
        "name",
    )
    return rows if codes is None else filter_selected(rows, codes)


def flatten_api_payload(df: DataFrame, column: str = "json") -> DataFrame:
    """Nested payload -> one row per value of hydrological stations, with both time stamps."""
    parsed = df.select(F.from_json(F.col(column), PAYLOAD).alias("p"))
    site = parsed.select(F.explode("p.results").alias("s")).where(F.col("s.station_type") == "hydro")
    data = site.select("s.station_code", "s.station_id", "s.station_name", F.explode("s.data").alias("d"))
    value = data.select(
        "station_code", "station_id", "station_name", "d.variable_code", "d.unit", F.explode("d.values").alias("v")
    )
    return value.where(F.col("v.value").isNotNull()).select(
        F.col("station_code").alias("code"),
        "station_id",
        F.col("station_name").alias("name"),
        "variable_code",
        "unit",
        F.to_timestamp("v.timestamp_local").alias("ts"),
        F.to_timestamp("v.timestamp_utc").alias("ts_utc"),
        F.col("v.value").alias("value"),
        F.col("v.value_code").alias("value_code"),
        F.col("v.value_type").alias("value_type"),
    )


def payload_sites(df: DataFrame, column: str = "json") -> DataFrame:
    """Input of S5: (code, station_type) of every delivered site."""
    parsed = df.select(F.from_json(F.col(column), PAYLOAD).alias("p"))
    return parsed.select(F.explode("p.results").alias("s")).select(
        F.col("s.station_code").alias("code"), "s.station_type"
    )


def read_station_registry(df: DataFrame, column: str = "json") -> DataFrame:
    """Map of stations, every field wrapped in a one-element list -> rows."""
    entries = df.select(F.explode(F.from_json(F.col(column), REGISTRY)).alias("id", "s"))
    return entries.select(
        F.col("id").alias("header"), *[F.element_at(f"s.{field}", 1).alias(name) for name, field in REGISTRY_FIELDS.items()]
    )


def read_station_selection(df: DataFrame, restriction: DataFrame | None = None, column: str = "json") -> DataFrame:
    """S8."""
    ids = df.select(F.explode(F.from_json(F.col(column), SELECTION)["stationsID"]).alias("code")).distinct()
    return ids if restriction is None else ids.intersect(restriction.select("code"))


def read_virtual_rules(df: DataFrame, column: str = "json") -> DataFrame:
    """Rules of virtual stations -> (virtual_code, code, weight, position)."""
    stations = df.select(
        F.explode(F.from_json(F.col(column), VIRTUAL_RULES)["virtualStations"]).alias("virtual_code", "r")
    ).where(F.col("r.combinationFunction") == "sum")
    return stations.select(
        "virtual_code", F.posexplode(F.map_entries("r.weightByStation")).alias("position", "e")
    ).select("virtual_code", F.col("e.key").alias("code"), F.col("e.value").alias("weight"), "position")


def with_target_period(df: DataFrame, horizon) -> DataFrame:
    """Published tables number the period that starts on the next day."""
    h = cal.horizon_of(horizon)
    following = F.date_add("date", 1)
    return df.withColumns(
        {h.in_month: cal.period_in_month(following, h), h.in_year: cal.period_in_year(following, h)}
    )


def read_observed(series: DataFrame, horizon) -> DataFrame:
    """S9."""
    rows = series.where(F.col("issue_date") & F.col("discharge_avg").isNotNull())
    out = rows.select("code", "date", "discharge_avg")
    return with_target_period(out, horizon).withColumns(
        {"model_long": F.lit("Observed (Obs)"), "model_short": F.lit("Obs")}
    )


STATS = ("q_mean", "q_std_sigma", "delta")


def read_linreg_forecasts(df: DataFrame, horizon, order: str) -> tuple[DataFrame, DataFrame]:
    """(forecasts, statistics) of the stored regression table."""
    rows = dedupe(df.withColumn("code", text.normalize_code("code")), ["date", "code"], F.col(order)).drop(order)
    stats = rows.select("date", "code", *STATS)
    forecasts = rows.drop(*STATS, "discharge_avg")
    short, long = text.MODEL_LABELS["LR"]
    forecasts = forecasts.withColumns({"model_long": F.lit(long), "model_short": F.lit(short)})
    return with_target_period(forecasts, horizon), stats


def read_daily_ml_forecasts(df: DataFrame, horizon, model: str | None = None) -> DataFrame:
    """Daily probabilistic rows -> mean per (code, issue date, model).

    With a ``model`` column the labels come from it; an unknown model gives no rows.
    """
    h = cal.horizon_of(horizon)
    if model is not None:
        df = df.withColumn("model", F.lit(model))
    quantiles = [c for c in df.columns if c == "Q" or (c[:1] == "Q" and c[1:].isdigit())]
    center = "Q50" if "Q50" in quantiles else "Q"
    rows = df.where(cal.is_issue_date("forecast_date", h) & F.col("date").isNotNull())
    mean = rows.groupBy("code", "forecast_date", "model").agg(*[F.avg(q).alias(q) for q in quantiles])
    labelled = mean.withColumns(
        {"model_short": text.model_short("model"), "model_long": text.model_long("model")}
    ).where(F.col("model_short").isNotNull())
    named = labelled.drop("model").withColumnsRenamed({"forecast_date": "date", center: "forecasted_discharge"})
    return with_target_period(named, h)


def read_ml_models(tables: DataFrame, models: list[str], horizon) -> DataFrame:
    """The wanted models of one table partitioned by model."""
    wanted = [m.upper() for m in models if m.upper() in text.MODEL_LABELS]
    return read_daily_ml_forecasts(tables.where(F.upper("model").isin(*wanted)), horizon)


def read_rainfall_runoff_forecasts(df: DataFrame, horizon, value: str = "Q50") -> DataFrame:
    """Daily rainfall-runoff forecasts -> first target period's mean, labelled."""
    from ..operators.aggregates import daily_to_period

    short, long = text.MODEL_LABELS["RRAM"]
    period = daily_to_period(df, horizon, value).withColumnRenamed("forecast_date", "date")
    return with_target_period(period, horizon).withColumns(
        {"model_long": F.lit(long), "model_short": F.lit(short)}
    )


def read_rainfall_runoff_files(spark: SparkSession, folder: str) -> DataFrame:
    """Daily files named ``..._<code>.csv`` with mixed date layouts."""
    raw = (
        spark.read.schema("forecast_date STRING, date STRING, Q50 DOUBLE")
        .option("header", True)
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .csv(folder)
    )
    return raw.select(
        F.regexp_extract(F.input_file_name(), r"_(\d+)\.csv", 1).alias("code"),
        text.parse_date_mixed("forecast_date").alias("forecast_date"),
        text.parse_date_mixed("date").alias("date"),
        "Q50",
    )


def merge_rainfall_runoff(forecasts: DataFrame, hindcasts: DataFrame) -> DataFrame:
    """Forecasts win on equal (code, date)."""
    tagged = stack(hindcasts.withColumn("_side", F.lit(0)), forecasts.withColumn("_side", F.lit(1)))
    return dedupe(tagged, ["code", "date"], F.col("_side")).drop("_side")


def read_csv_mixed_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """S23."""
    return df.withColumns({c: text.parse_date_mixed(c) for c in columns})


def display_forecasts(df: DataFrame, order: str) -> DataFrame:
    """Issue-shifted ``Date``, keep-last per (Date, code, model), year column."""
    shifted = df.withColumn("Date", F.date_add("issue", 1))
    return dedupe(shifted, ["Date", "code", "model_short"], F.col(order)).withColumn("year", F.year("Date"))


def newest_forecast_date(df: DataFrame) -> DataFrame:
    """Rows of the newest forecast date of each model's table; a stale station shows nothing."""
    newest = df.groupBy("model").agg(F.max("forecast_date").alias("forecast_date"))
    return df.join(newest, ["model", "forecast_date"], "left_semi")


def shift_predictor_date(df: DataFrame, horizon, days: int = 1) -> DataFrame:
    """S28."""
    h = cal.horizon_of(horizon)
    rows = df.dropna(subset=["predictor", "discharge_avg"]).withColumn("date", F.date_add("date", days))
    return rows.withColumn(h.in_year, cal.period_in_year("date", h))


def typed_forcing(df: DataFrame, values: list[str]) -> DataFrame:
    """Parsed date, text code, numeric values."""
    return df.select(
        text.parse_date_mixed(F.col("date").cast("string")).alias("date"),
        text.normalize_code("code").alias("code"),
        *[F.col(v).cast("double").alias(v) for v in values],
    )


def read_static_features(df: DataFrame) -> DataFrame:
    """S31."""
    return df.drop("cluster", "log_q").withColumnRenamed("CODE", "code")


def read_hydrograph(df: DataFrame, selected: DataFrame, restricted: DataFrame | None, values: list[str]) -> DataFrame:
    """Typed hydrograph of the selected and allowed stations."""
    rows = filter_selected(df, selected)
    rows = rows if restricted is None else filter_selected(rows, restricted)
    return rows.withColumns({v: F.col(v).cast("double") for v in values})


def match_bulletin_selection(selection: DataFrame, registry: DataFrame) -> DataFrame:
    """Stored bulletin rows matched to the registry."""
    return selection.join(registry.select("code", "name", "basin"), "code").select(
        "code", text.site_label("code", "name").alias("label"), "basin",
        F.col("model_short").alias("model"), F.col("forecasted_discharge").alias("forecast"),
        "fc_lower", "fc_upper",
    )


def file_ages(spark: SparkSession, inputs: list[str], output: str) -> DataFrame:
    """Newest input and oldest output file; only file metadata is read."""

    def stamp(paths, pick):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        return files.agg(pick("modificationTime").alias("m")).scalar()

    ages = spark.range(1).select(
        stamp(inputs, F.max).alias("newest_input"), stamp(output, F.min).alias("oldest_output")
    )
    needs = F.col("oldest_output").isNull() | (F.col("newest_input") > F.col("oldest_output"))
    return ages.select(needs.alias("needs_reprocess"))


def needs_reprocess(spark: SparkSession, inputs: list[str], output: str) -> bool:
    return file_ages(spark, inputs, output).first()[0]
