"""Table layouts and the column check every entry point uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAILY_TEXT = "code STRING, date STRING, discharge STRING"
REGISTRY = (
    "map<string, struct<name_ru: array<string>, river_ru: array<string>, punkt_ru: array<string>, "
    "name_eng: array<string>, river_eng: array<string>, punkt_eng: array<string>, "
    "lat: array<double>, long: array<double>, code: array<string>>>"
)
# our column: the registry's field
REGISTRY_FIELDS = {
    "code": "code", "name": "name_ru", "river": "river_ru", "place": "punkt_ru", "name_eng": "name_eng",
    "river_eng": "river_eng", "place_eng": "punkt_eng", "lat": "lat", "lon": "long",
}
SELECTION = "struct<stationsID: array<string>>"
PAYLOAD = (
    "struct<results: array<struct<station_code: string, station_id: bigint, "
    "station_name: string, station_type: string, data: array<struct<"
    "variable_code: string, unit: string, values: array<struct<value: double, "
    "timestamp_local: string, timestamp_utc: string, value_code: int, "
    "value_type: string>>>>>>>"
)
VIRTUAL_RULES = (
    "struct<virtualStations: map<string, struct<combinationFunction: string, "
    "weightByStation: map<string, double>>>>"
)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; present: {df.columns}")
    return df


def null_nans(df: DataFrame) -> DataFrame:
    """NaN means 'missing' in hydrological files; Spark aggregates skip NULL only."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in numeric else F.col(c)
            for c in df.columns
        ]
    )
