import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from freshet.operators import forcing, joins
from freshet.schemas import null_nans, require_columns
from freshet.sources import readers, writers

D = dt.date


def test_required_columns(frame):
    with pytest.raises(ValueError, match="discharge"):
        require_columns(frame([("A",)], "code string"), "code", "discharge")


def test_csv_reader_types_every_row(spark, frame, folder):
    path = folder
    frame([("15013.0", "05.01.2024", "1.5"), ("15013", "2024-01-06", "n/a"), ("15013", "2024-01-07", "NaN")], "code string, date string, discharge string").write.option("header", True).csv(path)
    out = readers.read_daily_discharge(spark, path).orderBy("date").collect()
    assert [(r.code, r.date, r.discharge) for r in out] == [("15013", D(2024, 1, 5), 1.5), ("15013", D(2024, 1, 6), None), ("15013", D(2024, 1, 7), None)]


def test_nan_becomes_null(frame):
    assert null_nans(frame([(float("nan"),), (1.0,)], "x double")).where("x is null").count() == 1


def test_payload_skips_meteo_sites_and_null_values(frame):
    def site(code, kind, value):
        values = [{"value": value, "timestamp_local": "2024-01-01T08:00:00"}, {"value": None, "timestamp_local": "2024-01-02T08:00:00"}]
        return {"station_code": code, "station_type": kind, "data": [{"variable_code": "WDDA", "values": values}]}

    doc = json.dumps({"results": [site("1", "hydro", 3.5), site("2", "meteo", 9.0)]})
    rows = readers.flatten_api_payload(frame([(doc,)], "json string")).collect()
    assert [(r.code, r.value, r.ts) for r in rows] == [("1", 3.5, dt.datetime(2024, 1, 1, 8))]


def test_registry_and_selection(frame):
    doc = {"12345": {"name_ru": ["p"], "lat": [41.5], "long": [74.1], "code": ["12345"]}, "12346": {"name_ru": ["q"], "lat": [42.5], "long": [75.1], "code": ["12346"]}}
    sites = readers.read_station_registry(frame([(json.dumps(doc),)], "json string")).orderBy("code").collect()
    assert [(s.code, s.name, s.lat, s.lon) for s in sites] == [("12345", "p", 41.5, 74.1), ("12346", "q", 42.5, 75.1)]
    chosen = readers.read_station_selection(frame([('{"stationsID": ["12176", "12256"]}',)], "json string"), frame([("12256",)], "code string"))
    assert [r.code for r in chosen.collect()] == ["12256"]


def test_gateway_file(frame):
    rows = [("Latitude", "41", "41", "x"), ("01.02.2024", "3.5", "0.2", "x"), ("02.02.2024", "bad", "0.4", "x")]
    df = frame(rows, "Station string, `15013` string, `15013.1` string, Source string")
    out = sorted((r.date, r.code, r["T"], r.P) for r in forcing.transform_control_member(df).collect())
    assert out == [(D(2024, 2, 1), "15013", 3.5, 0.2), (D(2024, 2, 2), "15013", None, 0.4)]


def test_snow_columns_with_and_without_band(frame):
    df = frame([("01.02.2024", 1.0, 2.0)], "date string, `15013_3` double, `15016` double")
    out = sorted((r.code, r.band, r.value) for r in forcing.transform_snow(df, "SWE").collect())
    assert out == [("15013", 3, 1.0), ("15016", None, 2.0)]


def test_quantile_mapping(frame):
    df = frame([("1", D(2024, 1, 1), 4.0, 0.0), ("1", D(2024, 1, 2), 0.5, 10.0), ("2", D(2024, 1, 1), 0.5, 1.0)], "code string, date date, P double, T double")
    params = frame([("1", 2.0, 0.5, 1.0, 1.0, 1.0)], "code string, a_p double, b_p double, wet_day double, a_t double, b_t double")
    out = sorted((r.code, r.date, r.P, r["T"]) for r in forcing.quantile_map(df, params).collect())
    assert out == [("1", D(2024, 1, 1), 4.0, 0.0), ("1", D(2024, 1, 2), 0.0, 10.0), ("2", D(2024, 1, 1), 0.5, 1.0)]


def test_first_target_period_is_numeric_and_crosses_new_year(frame):
    issued = D(2023, 12, 31)
    rows = [("1", issued, issued + dt.timedelta(days=i), float(i)) for i in range(1, 12)]
    out = readers.read_rainfall_runoff_forecasts(frame(rows, "code string, forecast_date date, date date, Q50 double"), "pentad").first()
    assert (out.forecasted_discharge, out.pentad_in_year, out.model_short) == (3.0, 1, "RRAM")


def test_flagged_rows_are_replaced_only_when_a_hindcast_exists(frame):
    schema = "code string, forecast_date date, date date, Q50 double, flag int"
    d = D(2024, 1, 5)
    made = frame([("1", d, d, 1.0, 1), ("2", d, d, 2.0, 2), ("3", d, d, 3.0, 0)], schema)
    hind = frame([("1", d, d, None, 0), ("3", d, d, 9.0, 0)], schema)
    out = sorted((r.code, r.Q50, r.flag) for r in joins.replace_flagged(made, hind, ["Q50"]).collect())
    assert out == [("1", None, 0), ("2", 2.0, 2), ("3", 3.0, 0)]


def test_stored_regression_upserts_and_keeps_two_years(frame):
    schema = "code string, date date, discharge double, issue_date boolean, pentad_in_year int, predictor double, discharge_avg double, forecasted_discharge double"
    fresh = frame([("1.0", D(2024, 1, 5), 1.0, True, 2, 1.23456, 2.0, 3.0), ("1.0", D(2024, 1, 6), 1.0, False, 2, None, None, None), ("2.0", D(2023, 6, 5), 1.0, True, 32, 1.0, 1.0, 1.0)], schema)
    old = frame([("1", D(2024, 1, 5), 2, 9.0, 9.0, 9.0), ("1", D(2021, 1, 5), 2, 8.0, 8.0, 8.0), ("1", D(2020, 2, 5), 8, 8.0, 8.0, 8.0)], "code string, date date, pentad_in_year int, predictor double, discharge_avg double, forecasted_discharge double")
    full, latest = writers.linreg_tables(fresh, old, "pentad", "pentad_in_year")
    got = {(r.code, r.date): r.predictor for r in full.collect()}
    assert got == {("1", D(2024, 1, 5)): 1.235, ("1", D(2021, 1, 5)): 8.0, ("1", D(2020, 2, 5)): 8.0, ("2", D(2023, 6, 5)): None}
    assert {(r.code, r.date) for r in latest.collect()} == {("1", D(2024, 1, 5)), ("2", D(2023, 6, 5))}


def test_reprocessing_is_needed_when_an_input_is_newer(spark, folder):
    base = folder
    spark.range(1).write.parquet(f"{base}/a")
    spark.range(1).write.parquet(f"{base}/b")
    assert readers.needs_reprocess(spark, [f"{base}/b"], f"{base}/a")


def test_csv_sink_is_sorted_with_a_header(spark, frame, folder):
    df = frame([("B", D(2024, 1, 2), 2.5), ("A", D(2024, 1, 3), None), ("A", D(2024, 1, 1), 1.0)], "code string, date date, discharge double")
    for _ in range(2):
        path = writers.write_csv(df.coalesce(1), folder, ["code", "date"])
    lines = [r.value for r in spark.read.text(path).collect()]
    assert [x for x in lines if x != "code,date,discharge"] == ["A,2024-01-01,1.0", "A,2024-01-03,", "B,2024-01-02,2.5"] and "code,date,discharge" in lines
    assert sorted(writers.read_csv(spark, folder, df.schema).collect(), key=str) == sorted(df.collect(), key=str)
