"""Sinks (S17-S22, S24, S26, S30, S34).

``*_table`` functions shape a table for publication; ``publish`` and ``write_csv`` store it.  A table
is written to a folder of its own; a small pointer file is switched when it is whole.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.merge import dedupe, latest_forecasts, latest_per_period, null_stale_rows, round_doubles, stack
from ..schemas import require_columns
from .readers import with_target_period


def daily_series_table(df: DataFrame) -> DataFrame:
    """S17."""
    require_columns(df, "code", "date", "discharge")
    return round_doubles(df.select("code", "date", "discharge"), 3)


def daily_hydrograph_table(df: DataFrame) -> DataFrame:
    """Days without any observation are left out."""
    return round_doubles(df.where(F.col("count") > 0), 3)


def period_series_table(df: DataFrame, horizon) -> DataFrame:
    """Issue dates only, period numbers of the following day."""
    rows = df.where(F.col("issue_date")).select("code", "date", "predictor", "discharge_avg")
    return round_doubles(with_target_period(rows, horizon), 3)


def skill_table(df: DataFrame) -> DataFrame:
    """S20."""
    return round_doubles(df, 4)


def forecast_tables(df: DataFrame, horizon) -> tuple[DataFrame, DataFrame]:
    """The full table and its ``_latest`` view."""
    return round_doubles(df, 3), latest_forecasts(df, horizon)


def linreg_tables(fresh: DataFrame, existing: DataFrame | None, horizon, period: str) -> tuple[DataFrame, DataFrame]:
    """The newest row of each station is rounded, stale rows lose their values, then
    it is upserted by (date, code); second table: newest per (code, period)."""
    rows = round_doubles(fresh.where(F.col("issue_date")).drop("issue_date", "discharge"), 3)
    last = dedupe(rows, ["code"], F.col("date"))
    last = null_stale_rows(last, ["predictor", "discharge_avg", "forecasted_discharge"])
    last = last.withColumn("code", text.normalize_code("code"))
    if existing is None:
        full = last
    else:
        tagged = stack(existing.withColumn("_side", F.lit(0)), last.withColumn("_side", F.lit(1)))
        full = dedupe(tagged, ["date", "code"], F.col("_side")).drop("_side")
    return full, latest_per_period(full, horizon, period)


def most_recent_table(df: DataFrame) -> DataFrame:
    """Rows of each model's newest date, ready for ``partitionBy('model_short')``."""
    newest = df.groupBy("model_short").agg(F.max("date").alias("date"))
    return df.join(newest, ["model_short", "date"], "left_semi")


def append_period_forecast(existing: DataFrame, daily: DataFrame, horizon) -> DataFrame:
    """Stored period forecasts plus the newly issued one; a rerun replaces its date."""
    from ..operators.aggregates import daily_to_period

    new = daily_to_period(daily, horizon)
    keys = ["code", "forecast_date"]
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def station_readings_table(*tables: DataFrame) -> DataFrame:
    """Readings with variable, unit and normalised code as one long table."""
    long = stack(*[t.select("code", "date", "variable", "unit", "value") for t in tables])
    return long.withColumn("code", text.normalize_code("code"))


def bulletin_selection_table(df: DataFrame) -> DataFrame:
    """Columns stored for the bulletin."""
    return round_doubles(
        df.select("code", "model_short", "forecasted_discharge", "fc_lower", "fc_upper"), 3
    )


def file_store(base: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it: local, HDFS or an object store."""
    if base.startswith("file:"):
        return fs.LocalFileSystem(), "/" + base.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)


def _current(store: fs.FileSystem, root: str) -> str | None:
    if store.get_file_info(f"{root}/_current").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/_current") as pointer:
        return pointer.read().decode().strip()


def publish(df: DataFrame, base: str, partition_by: list[str] | None = None, fmt: str = "parquet", **options) -> str:
    """Write a folder of its own, then rename a pointer file over the old one.

    Readers of the version before keep it; older ones are deleted.  A failed job leaves all as it is.
    Raises if another job has published meanwhile.
    """
    store, root = file_store(base)
    before, version = _current(store, root), uuid.uuid4().hex
    writer = df.write.format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{base}/version={version}")
    if _current(store, root) != before:
        store.delete_dir(f"{root}/version={version}")
        raise RuntimeError(f"another job has published to {base}")
    with store.open_output_stream(f"{root}/_current.{version}") as pointer:
        pointer.write(version.encode())
    store.move(f"{root}/_current.{version}", f"{root}/_current")
    for found in store.get_file_info(fs.FileSelector(root)):
        if found.base_name.startswith("version=") and found.base_name[8:] not in (before, version):
            store.delete_dir(found.path)
    return f"{base}/version={version}"


def published(spark: SparkSession, base: str, fmt: str = "parquet", schema=None, **options) -> DataFrame | None:
    """The current version, or None before the first publication."""
    store, root = file_store(base)
    version = _current(store, root)
    if version is None:
        return None
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(f"{base}/version={version}")


def write_csv(df: DataFrame, base: str, order: list[str]) -> str:
    """Sorted CSV files with a header and ISO dates."""
    return publish(df.orderBy(*order), base, fmt="csv", header=True)


def read_csv(spark: SparkSession, base: str, schema) -> DataFrame:
    """A table of ``write_csv``, typed by its schema."""
    return published(spark, base, "csv", schema, header=True)


def export_hydrograph(df: DataFrame, as_of_year: int) -> DataFrame:
    """Column names of the exported hydrograph carry the two years."""
    return df.withColumnsRenamed({"last_year": str(as_of_year - 1), "current_year": str(as_of_year)})
