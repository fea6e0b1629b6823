"""S rows: every reader and sink, on files or nested data derived from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, forcing, hydrograph, skill
from ..sources import readers, writers
from . import runs
from .calendar_queries import MAPPED, _parameters
from .registry import query
from .sql import MODEL_LONG, MODEL_SHORT, SHIP, issue, next_issue, pim, piy

NEXT = "CAST(date + 1 AS DATE)"


@query("S1_read_daily_discharge", "SELECT code, date, discharge FROM daily")
def read_daily_discharge(t):
    path = t.scratch("daily-csv")
    printed = t.daily.select(
        F.concat("code", F.lit(".0")).alias("code"), F.date_format("date", "dd.MM.yyyy").alias("date"), "discharge"
    )
    printed.write.option("header", True).csv(path)
    return readers.read_daily_discharge(t.spark, path)


@query(
    "S2_read_runoff_csv_dir",
    "SELECT date, code, CASE WHEN discharge >= 25 THEN discharge END AS discharge, name FROM daily JOIN (SELECT code AS c, name FROM registry WHERE flag) AS r ON code = c",
)
def read_runoff_csv_dir(t):
    path = t.scratch("runoff-csv")
    rows = t.daily.join(t.registry.select("code", "name"), "code")
    shown = F.when(F.col("discharge") >= 25, F.col("discharge").cast("string")).otherwise("no data")
    rows.select("date", "code", shown.alias("value"), "name").write.option("header", True).csv(path)
    return readers.read_runoff_csv_dir(t.spark, path, t.registry.where("flag"))


@query("S3_standardize_date", "SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def standardize_date(t):
    return t.events.select("event_id", text.standardize_date("ts").alias("date"))


def _payload(t):
    """One nested document per given event; no grouping, so no document can grow."""
    value = F.when(F.col("event_type") != "signup", F.col("value"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    none = F.lit(None).cast("string")
    values = F.array(
        F.struct(
            value.alias("value"), stamp(F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("timestamp_local"),
            stamp(F.col("ts")).alias("timestamp_utc"), F.expr("cast(event_id % 3 as int)").alias("value_code"),
            F.col("event_type").alias("value_type"),
        ),
        F.struct(
            F.lit(None).cast("double").alias("value"), none.alias("timestamp_local"), none.alias("timestamp_utc"),
            F.lit(None).cast("int").alias("value_code"), none.alias("value_type"),
        ),
    )
    data = F.array(F.struct(F.lit("WDDA").alias("variable_code"), F.lit("m3/s").alias("unit"), values.alias("values")))
    code = (F.expr("user_id div 15") + 10000).cast("string")
    site = F.struct(
        code.alias("station_code"),
        F.col("event_id").alias("station_id"),
        F.concat(F.lit("post "), F.col("user_id").cast("string")).alias("station_name"),
        F.when(F.col("event_type") == "error", "meteo").otherwise("hydro").alias("station_type"),
        data.alias("data"),
    )
    return t.events.select(F.to_json(F.struct(F.array(site).alias("results"))).alias("json"))


EVENT_CODE = "CAST(10000 + user_id // 15 AS VARCHAR)"


@query(
    "S4_flatten_api_payload",
    f"""SELECT {EVENT_CODE} AS code, event_id AS station_id, 'post ' || CAST(user_id AS VARCHAR) AS name, 'WDDA' AS variable_code, 'm3/s' AS unit,
      strftime(ts + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_utc, value, CAST(event_id % 3 AS INTEGER) AS value_code, event_type AS value_type
    FROM events WHERE event_type NOT IN ('error', 'signup')""",
)
def flatten_api_payload(t):
    rows = readers.flatten_api_payload(_payload(t))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("ts", "ts_utc")})


@query(
    "S4_daily_mean_of_payload",
    f"""SELECT {EVENT_CODE} AS code, CAST(date_trunc('second', ts) AS DATE) AS date, avg(value) AS discharge
    FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1, 2""",
    "discharge:r6",
)
def daily_mean_of_payload(t):
    """S6 on the UTC stamps of S4."""
    rows = readers.flatten_api_payload(_payload(t)).select("code", F.col("ts_utc").alias("ts"), "value")
    return aggregates.daily_mean_readings(rows)


@query(
    "S5_classify_site_types",
    f"""SELECT code, CASE WHEN h AND m THEN 'both' WHEN h THEN 'hydro' ELSE 'meteo' END AS site_type FROM (
      SELECT {EVENT_CODE} AS code, bool_or(event_type <> 'error') AS h, bool_or(event_type = 'error') AS m FROM events GROUP BY 1) AS s""",
)
def classify_site_types(t):
    return aggregates.classify_site_types(readers.payload_sites(_payload(t)))


@query("S6_daily_mean_readings", "SELECT code, CAST(ts AS DATE) AS date, avg(value) AS discharge FROM readings GROUP BY 1, 2", "discharge:r6")
def daily_mean_readings(t):
    return aggregates.daily_mean_readings(t.readings)


@query(
    "S7_read_station_registry",
    """SELECT code AS header, code, name, river, place, upper(name) AS name_eng, upper(river) AS river_eng, upper(place) AS place_eng, lat, lon
    FROM registry""",
)
def read_station_registry(t):
    station = F.struct(
        F.array("name").alias("name_ru"), F.array("river").alias("river_ru"), F.array("place").alias("punkt_ru"),
        F.array(F.upper("name")).alias("name_eng"), F.array(F.upper("river")).alias("river_eng"),
        F.array(F.upper("place")).alias("punkt_eng"), F.array("lat").alias("lat"), F.array("lon").alias("long"), F.array("code").alias("code")
    )
    return readers.read_station_registry(t.registry.select(F.to_json(F.create_map("code", station)).alias("json")))


@query("S8_read_station_selection", "SELECT code FROM registry WHERE flag")
def read_station_selection(t):
    chosen = t.registry.select(F.to_json(F.struct(F.array("code").alias("stationsID"))).alias("json"))
    return readers.read_station_selection(chosen, t.registry.where("flag"))


@query(
    "S9_read_observed",
    f"SELECT code, date, discharge_avg, 'Observed (Obs)' AS model_long, 'Obs' AS model_short, {pim(NEXT)} AS pentad_in_month, {piy(NEXT)} AS pentad_in_year FROM observed",
    "discharge_avg:r6",
)
def read_observed(t):
    return readers.read_observed(t.series("pentad"), "pentad")


def _with_older_rows(t):
    """The stored regression table with an older copy of every row."""
    older = t.linreg.withColumns({"forecasted_discharge": F.lit(-1.0), "arrival": F.lit(0)})
    return older.unionByName(t.linreg.withColumn("arrival", F.lit(1)))


@query(
    "S10_read_linreg_forecasts",
    f"""SELECT code, date, slope, intercept, forecasted_discharge, {pim(NEXT)} AS pentad_in_month, {piy(NEXT)} AS pentad_in_year,
      'Linear regression (LR)' AS model_long, 'LR' AS model_short, q_mean, q_std_sigma, delta FROM linreg""",
    "slope:r5 intercept:r5 forecasted_discharge:r5 q_mean:r6 q_std_sigma:r6 delta:r6",
)
def read_linreg_forecasts(t):
    forecasts, stats = readers.read_linreg_forecasts(_with_older_rows(t), "pentad", "arrival")
    keep = ["slope", "intercept", "forecasted_discharge", "pentad_in_month", "pentad_in_year", "model_long", "model_short"]
    return forecasts.select("code", "date", *keep).join(stats, ["code", "date"])


QS = ("Q5", "Q25", "Q50", "Q75", "Q95")


def _ml(h):
    means = ", ".join(f"avg({q}) AS {'forecasted_discharge' if q == 'Q50' else q}" for q in QS)
    return f"""SELECT * EXCLUDE (model), {pim(NEXT, h)} AS {h}_in_month, {piy(NEXT, h)} AS {h}_in_year, {MODEL_SHORT.format(m='model')} AS model_short, {MODEL_LONG.format(m='model')} AS model_long
      FROM (SELECT code, forecast_date AS date, model, {means} FROM daily_ml WHERE {issue('forecast_date', h)} GROUP BY 1, 2, 3) AS m"""


ML_SHAPE = "Q5:r6 Q25:r6 forecasted_discharge:r6 Q75:r6 Q95:r6"

for _h in ("pentad", "decad"):

    @query(f"S11_read_daily_ml_forecasts_{_h}", _ml(_h), ML_SHAPE)
    def read_daily_ml_forecasts(t, h=_h):
        return readers.read_daily_ml_forecasts(t.daily_ml.drop("flag"), h)


@query("S32_read_ml_models", f"SELECT * FROM ({_ml('pentad')}) AS m WHERE model_short IN ('TFT', 'TiDE')", ML_SHAPE)
def read_ml_models(t):
    return readers.read_ml_models(t.daily_ml.drop("flag"), ["TFT", "tide", "unknown"], "pentad")


def _period(model, h="pentad"):
    first_end = next_issue("CAST(forecast_date + 1 AS DATE)", h)
    return f"""SELECT code, forecast_date AS date, avg(Q50) AS forecasted_discharge FROM daily_ml
      WHERE model = '{model}' AND {issue('forecast_date', h)} AND date > forecast_date AND date <= {first_end} GROUP BY 1, 2"""


def _rr(model, h="pentad"):
    return f"""SELECT code, date, forecasted_discharge, {pim(NEXT, h)} AS {h}_in_month, {piy(NEXT, h)} AS {h}_in_year,
      'Rainfall runoff assimilation model (RRAM)' AS model_long, 'RRAM' AS model_short FROM ({_period(model, h)}) AS p"""


for _h in ("pentad", "decad"):

    @query(f"S12_read_rainfall_runoff_{_h}", _rr("TFT", _h), "forecasted_discharge:r6")
    def read_rainfall_runoff(t, h=_h):
        return readers.read_rainfall_runoff_forecasts(t.daily_ml.where("model = 'TFT'"), h)


@query(
    "S12_read_rainfall_runoff_files",
    "SELECT code, forecast_date, date, Q50 FROM daily_ml WHERE model = 'TIDE'",
)
def read_rainfall_runoff_files(t):
    path = t.scratch("rainfall-runoff")
    rows = t.daily_ml.where("model = 'TIDE'").select(
        F.concat(F.lit("daily_"), "code", F.lit(".csv")).alias("file"),
        F.date_format("forecast_date", "dd.MM.yyyy").alias("forecast_date"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "Q50",
    )
    # one task writes a gauge's file whole
    rows.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    return readers.read_rainfall_runoff_files(t.spark, path)


@query(
    "S13_read_all_rainfall_runoff",
    f"""WITH f AS ({_rr('TFT')}), h AS ({_rr('TIDE')})
    SELECT * FROM f UNION ALL SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.code = h.code AND f.date = h.date)""",
    "forecasted_discharge:r6",
)
def read_all_rainfall_runoff(t):
    new = readers.read_rainfall_runoff_forecasts(t.daily_ml.where("model = 'TFT'"), "pentad")
    old = readers.read_rainfall_runoff_forecasts(t.daily_ml.where("model = 'TIDE'"), "pentad")
    return readers.merge_rainfall_runoff(new, old)


DAYS_BY_LINE = f"SELECT {SHIP} AS date, l_linenumber AS n, sum(l_quantity) AS s, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2"
ALL_DAYS = f"(SELECT DISTINCT {SHIP} AS date FROM lineitem) AS days CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS n) AS lines"


@query(
    "S14_transform_control_member",
    f"SELECT d.date, CAST(d.n AS VARCHAR) AS code, s AS T, m AS P FROM (SELECT date, n FROM {ALL_DAYS}) AS d LEFT JOIN ({DAYS_BY_LINE}) AS v ON d.date = v.date AND d.n = v.n",
)
def transform_control_member(t):
    return forcing.transform_control_member(t.gateway)


def _member_file(t, flag, variable):
    agg = F.sum("l_quantity") if variable == "P" else F.max("l_quantity")
    wide = (
        t.lineitem.where(F.col("l_returnflag") == flag)
        .groupBy(F.date_format("l_shipdate", "dd.MM.yyyy").alias("date"))
        .pivot("l_linenumber", list(range(1, 8)))
        .agg(agg)
    )
    return wide.withColumnsRenamed({str(i): f"basin_{i}" for i in range(1, 8)})


def _member(t, flag, number, variable):
    return forcing.transform_ensemble_member(_member_file(t, flag, variable), variable, "00003", number)


def _member_sql(flag, number, variable):
    fn = "sum" if variable == "P" else "max"
    return f"""SELECT d.date, '00003' AS code, 'basin_' || CAST(d.n AS VARCHAR) AS name, CAST({number} AS INTEGER) AS ensemble_member, v AS {variable}
      FROM (SELECT date, n FROM (SELECT DISTINCT {SHIP} AS date FROM lineitem WHERE l_returnflag = '{flag}') AS days CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS n) AS lines) AS d
      LEFT JOIN (SELECT {SHIP} AS date, l_linenumber AS n, {fn}(l_quantity) AS v FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1, 2) AS q ON d.date = q.date AND d.n = q.n"""


@query(
    "S15_merge_ensemble",
    f"""SELECT * FROM ({_member_sql('A', 1, 'P')} UNION ALL {_member_sql('N', 2, 'P')}) AS p
      FULL OUTER JOIN ({_member_sql('A', 1, 'T')} UNION ALL {_member_sql('R', 3, 'T')}) AS q USING (date, code, name, ensemble_member)""",
)
def merge_ensemble(t):
    p = _member(t, "A", 1, "P").unionByName(_member(t, "N", 2, "P"))
    temperature = _member(t, "A", 1, "T").unionByName(_member(t, "R", 3, "T"))
    return forcing.merge_ensemble(p, temperature)


def _snow_wide(t):
    wide = (
        t.lineitem.groupBy(F.date_format("l_shipdate", "dd.MM.yyyy").alias("date"))
        .pivot("l_linenumber", list(range(1, 8)))
        .agg(F.sum("l_quantity"))
    )
    return wide.withColumnsRenamed({str(i): f"16936_{i}" for i in range(1, 8)})


@query(
    "S16_transform_snow",
    f"""SELECT d.date, '16936' AS code, 'SWE' AS var, CAST(d.n AS INTEGER) AS band, s AS value
    FROM (SELECT date, n FROM {ALL_DAYS}) AS d LEFT JOIN ({DAYS_BY_LINE}) AS v ON d.date = v.date AND d.n = v.n""",
)
def transform_snow(t):
    return forcing.transform_snow(_snow_wide(t), "SWE")


@query(
    "S16_pivot_snow",
    "SELECT date, code, " + ", ".join(f"max(value) FILTER (WHERE band = {b}) AS HS_{b}" for b in range(1, 8)) + " FROM snow WHERE var = 'HS' GROUP BY 1, 2",
)
def pivot_snow(t):
    return forcing.pivot_snow(t.snow, "HS", list(range(1, 8)))


def _stored(t, table, order):
    """The table as it is read back from its published CSV files."""
    base = t.scratch("csv")
    writers.write_csv(table, base, order)
    return writers.read_csv(t.spark, base, table.schema)


@query("S17_write_daily_series", "SELECT code, date, round_even(round(P, 9), 3) AS discharge FROM forcing", "discharge:r6")
def write_daily_series(t):
    return _stored(t, writers.daily_series_table(t.forcing.select("code", "date", F.col("P").alias("discharge"))), ["code", "date"])


NORM_DAY = "(dayofyear(date) - CASE WHEN year(date) IN (1996, 2000) AND dayofyear(date) >= 60 THEN 1 ELSE 0 END)"
HYDRO = f"""SELECT code, n, count(discharge) AS count, avg(discharge) AS mean, stddev_samp(discharge) AS std, min(discharge) AS min,
    quantile_cont(discharge, 0.05) AS q05, quantile_cont(discharge, 0.25) AS q25, quantile_cont(discharge, 0.5) AS q50, quantile_cont(discharge, 0.75) AS q75, quantile_cont(discharge, 0.95) AS q95,
    max(discharge) AS max, avg(discharge) FILTER (WHERE year(date) = 1999) AS last_year, avg(discharge) FILTER (WHERE year(date) = 2000) AS current_year
  FROM (SELECT *, {NORM_DAY} AS n FROM holes) AS h GROUP BY 1, 2"""
DAILY_HYDROGRAPH = f"""SELECT * EXCLUDE (n, day_of_year), CAST(day_of_year AS INTEGER) AS day_of_year, CAST(DATE '2000-01-01' + CAST(day_of_year - 1 AS INTEGER) AS DATE) AS date
  FROM (SELECT *, unnest(CASE WHEN n < 59 THEN [n] WHEN n = 59 THEN [59, 60] ELSE [n + 1] END) AS day_of_year FROM ({HYDRO}) AS s) AS e"""
HYDRO_NUMBERS = "mean std min q05 q25 q50 q75 q95 max last_year current_year".split()


@query(
    "S18_write_daily_hydrograph",
    "SELECT * REPLACE (" + ", ".join(f"round_even(round({c}, 9), 3) AS {c}" for c in HYDRO_NUMBERS) + f") FROM ({DAILY_HYDROGRAPH}) AS h WHERE count > 0",
    " ".join(f"{c}:r6" for c in HYDRO_NUMBERS),
)
def write_daily_hydrograph(t):
    return _stored(t, writers.daily_hydrograph_table(hydrograph.daily_hydrograph(t.holes, 2000)), ["code", "day_of_year"])


for _h in ("pentad", "decad"):

    @query(
        f"S19_write_period_series_{_h}",
        f"""SELECT code, date, round_even(round(predictor, 9), 3) AS predictor, round_even(round(discharge_avg, 9), 3) AS discharge_avg, {pim(NEXT, _h)} AS {_h}_in_month, {piy(NEXT, _h)} AS {_h}_in_year
        FROM series_{_h} WHERE issue_date""",
        "predictor:r6 discharge_avg:r6",
    )
    def write_period_series(t, h=_h):
        return _stored(t, writers.period_series_table(t.series(h), h), ["code", "date"])


METRICS = """CASE WHEN count(*) >= 2 AND var_samp(o) * (count(*) - 1) >= 1e-10 AND stddev_samp(o) >= 1e-10 THEN sqrt(sum((o - s) * (o - s)) / (count(*) - 1)) / stddev_samp(o) END AS sdivsigma,
  CASE WHEN count(*) >= 2 AND var_samp(o) * (count(*) - 1) >= 1e-10 AND stddev_samp(o) >= 1e-10 THEN 1 - sum((o - s) * (o - s)) / (var_samp(o) * (count(*) - 1)) END AS nse,
  arg_max(delta, date) AS delta, avg(CASE WHEN abs(o - s) <= delta THEN 1.0 ELSE 0.0 END) AS accuracy, avg(abs(o - s)) AS mae, count(*) AS n_pairs"""
PAIRS = """SELECT f.*, o.discharge_avg AS o, f.forecasted_discharge AS s, o.delta FROM forecasts AS f JOIN observed AS o ON f.code = o.code AND f.date = o.date"""
SKILL = f"SELECT pentad_in_year, code, model_long, model_short, {METRICS} FROM ({PAIRS}) AS p GROUP BY 1, 2, 3, 4"
SKILL_SHAPE = "sdivsigma:r5 nse:r5 delta:r5 accuracy:r5 mae:r5 n_pairs:l"
SKILL_KEYS = ["pentad_in_year", "code", "model_long", "model_short"]


@query(
    "S20_write_skill",
    f"SELECT * REPLACE ({', '.join(f'round_even(round({c}, 10), 4) AS {c}' for c in ('sdivsigma', 'nse', 'delta', 'accuracy', 'mae'))}) FROM ({SKILL}) AS s",
    SKILL_SHAPE,
)
def write_skill(t):
    scores = skill.score(skill.pair_with_observations(t.forecasts, t.observed), SKILL_KEYS)
    return _stored(t, writers.skill_table(scores), SKILL_KEYS)


@query(
    "S21_write_forecasts",
    """WITH newest AS (SELECT code, pentad_in_year, model_short, max(date) AS date FROM forecasts GROUP BY 1, 2, 3),
    latest AS (SELECT * FROM newest WHERE year(date) >= (SELECT max(year(date)) FROM newest) - 1)
    SELECT f.code, f.date, f.model_short, f.pentad_in_year, round_even(round(forecasted_discharge, 9), 3) AS forecasted_discharge, l.date IS NOT NULL AS latest
    FROM forecasts AS f LEFT JOIN latest AS l ON f.code = l.code AND f.date = l.date AND f.model_short = l.model_short AND f.pentad_in_year = l.pentad_in_year""",
    "forecasted_discharge:r6",
)
def write_forecasts(t):
    keys = ["code", "date", "model_short", "pentad_in_year"]
    full, latest = (_stored(t, table, keys) for table in writers.forecast_tables(t.forecasts, "pentad"))
    marked = full.join(latest.select(*keys, F.lit(True).alias("latest")), keys, "left")
    return marked.select(*keys, "forecasted_discharge", F.coalesce("latest", F.lit(False)).alias("latest"))


@query("S22_atomic_table_replace", "SELECT code, date, discharge FROM raw")
def atomic_table_replace(t):
    base = t.scratch("published")
    writers.publish(t.daily, base)
    current = writers.published(t.spark, base)
    writers.publish(current.withColumn("discharge", F.col("discharge") - 12), base)
    return writers.published(t.spark, base)


@query(
    "S24_save_most_recent",
    "SELECT f.* FROM forecasts AS f JOIN (SELECT model_short AS m, max(date) AS d FROM forecasts GROUP BY 1) AS n ON model_short = m AND date = d",
    "forecasted_discharge:r6",
)
def save_most_recent(t):
    path = t.scratch("most-recent")
    writers.publish(writers.most_recent_table(t.forecasts), path, partition_by=["model_short"])
    return writers.published(t.spark, path)


@query("S25_needs_reprocess")
def needs_reprocess(t):
    return readers.file_ages(t.spark, [f"{t.folder}/lineitem.parquet", f"{t.folder}/orders.parquet"], f"{t.folder}/events.parquet")


FRESH = """SELECT code, max(date) AS date, arg_max(issue_period, date) AS pentad_in_year, arg_max(round_even(round(predictor, 9), 3), date) AS predictor,
    arg_max(round_even(round(discharge_avg, 9), 3), date) AS discharge_avg, arg_max(round_even(round(forecasted_discharge, 9), 3), date) AS forecasted_discharge
  FROM (SELECT code, date, issue_period, coalesce(predictor, -1) AS predictor, coalesce(discharge_avg, -1) AS discharge_avg, coalesce(forecasted_discharge, -1) AS forecasted_discharge FROM linreg WHERE date >= DATE '2000-01-01') AS l GROUP BY 1"""


@query(
    "S26_write_linreg_forecasts",
    f"""WITH fresh AS ({FRESH}),
    stale AS (SELECT code, date, pentad_in_year, CASE WHEN ok THEN predictor END AS predictor, CASE WHEN ok THEN discharge_avg END AS discharge_avg, CASE WHEN ok THEN forecasted_discharge END AS forecasted_discharge
      FROM (SELECT *, date >= make_date((SELECT max(year(date)) FROM fresh), 1, 1) - 5 AS ok FROM fresh) AS f),
    stored AS (SELECT code, date, issue_period AS pentad_in_year, coalesce(predictor, -1) AS predictor, coalesce(discharge_avg, -1) AS discharge_avg, coalesce(forecasted_discharge, -1) AS forecasted_discharge FROM linreg WHERE date < DATE '2000-01-01'),
    both_sides AS (SELECT * FROM stored UNION ALL SELECT * FROM stale),
    latest AS (SELECT code, pentad_in_year, max(date) AS d FROM both_sides GROUP BY 1, 2)
    SELECT b.*, l.d IS NOT NULL AND year(b.date) >= (SELECT max(year(d)) FROM latest) - 1 AS latest FROM both_sides AS b
      LEFT JOIN latest AS l ON b.code = l.code AND b.pentad_in_year = l.pentad_in_year AND b.date = l.d""",
    "predictor:r5 discharge_avg:r5 forecasted_discharge:r5",
)
def write_linreg_forecasts(t):
    columns = ["code", "date", "discharge", "issue_date", "pentad_in_year", "predictor", "discharge_avg", "forecasted_discharge"]
    rows = t.linreg.withColumnRenamed("issue_period", "pentad_in_year").select(*columns)
    rows = rows.fillna(-1.0, ["predictor", "discharge_avg", "forecasted_discharge"])
    new, old = rows.where("date >= '2000-01-01'"), rows.where("date < '2000-01-01'").drop("issue_date", "discharge")
    tables = writers.linreg_tables(new, old, "pentad", "pentad_in_year")
    full, latest = (_stored(t, table, ["code", "date"]) for table in tables)
    marks = latest.select("code", "date", F.lit(True).alias("latest"))
    return full.join(marks, ["code", "date"], "left").withColumn("latest", F.coalesce("latest", F.lit(False)))


@query(
    "S27_display_readers",
    """SELECT code, model_short, CAST(date + 1 AS DATE) AS "Date", forecasted_discharge, CAST(year(date + 1) AS INTEGER) AS year FROM forecasts""",
    "forecasted_discharge:r6",
)
def display_readers(t):
    rows = t.forecasts.select("code", "model_short", F.col("date").alias("issue"), "forecasted_discharge")
    older = rows.withColumns({"forecasted_discharge": F.lit(0.0), "arrival": F.lit(0)})
    both = older.unionByName(rows.withColumn("arrival", F.lit(1)))
    return readers.display_forecasts(both, "arrival").drop("issue", "arrival")


@query(
    "S27_newest_forecast_date",
    "SELECT d.* FROM daily_ml AS d JOIN (SELECT model AS m, max(forecast_date) AS f FROM daily_ml GROUP BY 1) AS n ON model = m AND forecast_date = f",
)
def newest_forecast_date(t):
    return readers.newest_forecast_date(t.daily_ml)


@query(
    "S28_shift_predictor_date",
    f"""SELECT code, {NEXT} AS date, predictor, discharge_avg, {piy(NEXT)} AS pentad_in_year FROM series_pentad WHERE predictor IS NOT NULL AND discharge_avg IS NOT NULL""",
    "predictor:r6 discharge_avg:r6",
)
def shift_predictor_date(t):
    rows = t.series("pentad").select("code", "date", "predictor", "discharge_avg")
    return readers.shift_predictor_date(rows, "pentad")


@query("S29_forcing_readers", "SELECT date, code, P, T FROM forcing")
def forcing_readers(t):
    printed = t.forcing.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.concat("code", F.lit(".0")).alias("code"), "P", "T"
    )
    return readers.typed_forcing(printed, ["P", "T"])


@query("S29_snow_readers", "SELECT date, code, SWE FROM (SELECT date, code, sum(value) AS SWE FROM snow WHERE var = 'SWE' GROUP BY 1, 2) AS s")
def snow_readers(t):
    total = t.snow.where("var = 'SWE'").groupBy("date", "code").agg(F.sum("value").alias("SWE"))
    return readers.typed_forcing(total.withColumn("date", F.date_format("date", "dd.MM.yyyy")), ["SWE"])


@query(
    "S30_append_period_forecast",
    f"""WITH new_rows AS ({_period('TFT')}), old_rows AS ({_period('TIDE')})
    SELECT code, date AS forecast_date, forecasted_discharge FROM new_rows
    UNION ALL SELECT code, date, forecasted_discharge FROM old_rows AS o WHERE NOT EXISTS (SELECT 1 FROM new_rows AS n WHERE n.code = o.code AND n.date = o.date)""",
    "forecasted_discharge:r6",
)
def append_period_forecast(t):
    stored = aggregates.daily_to_period(t.daily_ml.where("model = 'TIDE'"), "pentad")
    made = writers.append_period_forecast(stored, t.daily_ml.where("model = 'TFT'"), "pentad")
    return _stored(t, made, ["code", "forecast_date"])


@query("S31_read_static_features", "SELECT code, lat, lon, area FROM registry")
def read_static_features(t):
    table = t.registry.select(
        F.col("code").alias("CODE"), "lat", "lon", "area", F.lit(1).alias("cluster"), F.log("area").alias("log_q")
    )
    return readers.read_static_features(table)


@query(
    "S33_forcing_pipeline",
    f"""SELECT code, date, last_value(P IGNORE NULLS) OVER w AS P, last_value(T IGNORE NULLS) OVER w AS T FROM (
      SELECT code, date, CASE WHEN T >= -0.5 THEN P END AS P, CASE WHEN P >= 1 THEN T END AS T FROM ({MAPPED}) AS m) AS g
    WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "P:r6 T:r6",
)
def forcing_pipeline(t):
    mapped = forcing.quantile_map(t.forcing, _parameters(t))
    gappy = mapped.withColumns(
        {"P": F.when(F.col("T") >= -0.5, F.col("P")), "T": F.when(F.col("P") >= 1, F.col("T"))}
    )
    p, temperature = forcing.split_forcing(forcing.prepare_forcing(gappy))
    return p.join(temperature, ["code", "date"])


CORRECTED = """round_even(1.5 * pow(CASE WHEN P <= 8 THEN 0 ELSE P END, 0.5), 2) AS P, round_even(1.25 * pow(T + 273.15, 0.96) - 273.15, 2) AS T"""


def _corrections(t, codes):
    rows = [(c, 1.5, 0.5, 8.0, 1.25, 0.96) for c in codes]
    return t.spark.createDataFrame(rows, "code string, a_p double, b_p double, wet_day double, a_t double, b_t double")


@query(
    "S33_control_forcing_run",
    f"""SELECT code, date, last_value(P IGNORE NULLS) OVER w AS P, last_value(T IGNORE NULLS) OVER w AS T FROM (
      SELECT code, date, {CORRECTED} FROM (SELECT d.date, CAST(d.n AS VARCHAR) AS code, s AS T, m AS P FROM (SELECT date, n FROM {ALL_DAYS}) AS d LEFT JOIN ({DAYS_BY_LINE}) AS v ON d.date = v.date AND d.n = v.n) AS r WHERE code IN ('2', '4', '6')
      UNION ALL SELECT CAST(d.n AS VARCHAR), d.date, m, s FROM (SELECT date, n FROM {ALL_DAYS}) AS d LEFT JOIN ({DAYS_BY_LINE}) AS v ON d.date = v.date AND d.n = v.n WHERE d.n NOT IN (2, 4, 6)) AS c
    WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "P:r6 T:r6",
)
def control_forcing_run(t):
    p, temperature = runs.control_forcing(t.gateway, _corrections(t, ["2", "4", "6"]), t.scratch("forcing"))
    return p.join(temperature, ["code", "date"])


MEMBERS = (("A", 1), ("N", 2), ("R", 3))


@query(
    "S33_ensemble_forcing_run",
    f"""SELECT code, name, ensemble_member, date, last_value(P IGNORE NULLS) OVER w AS P, last_value(T IGNORE NULLS) OVER w AS T FROM (
      SELECT code, name, ensemble_member, date, {CORRECTED} FROM ({' UNION ALL '.join(_member_sql(f, n, 'P') for f, n in MEMBERS)}) AS p
      FULL OUTER JOIN ({' UNION ALL '.join(_member_sql(f, n, 'T') for f, n in MEMBERS)}) AS q USING (date, code, name, ensemble_member)) AS c
    WINDOW w AS (PARTITION BY code, name, ensemble_member ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "ensemble_member:i P:r6 T:r6",
)
def ensemble_forcing_run(t):
    """All members of all flags, from wide files to the two published tables."""
    files = [[(_member_file(t, flag, v), n) for flag, n in MEMBERS] for v in ("P", "T")]
    p, temperature = runs.ensemble_forcing(*files, "00003", _corrections(t, ["00003"]), t.scratch("forcing"))
    return p.join(temperature, ["code", "name", "ensemble_member", "date"])


SNOW = ("SWE", "HS", "ROF")


@query(
    "S16_pivot_snow_all",
    " UNION ALL ".join("SELECT date, code, '" + v + "' AS var, " + ", ".join(f"max(value) FILTER (WHERE band = {b}) AS band_{b}" for b in range(1, 8)) + f" FROM snow WHERE var = '{v}' GROUP BY 1, 2" for v in SNOW),
)
def pivot_snow_all(t):
    def one(v):
        wide = forcing.pivot_snow(t.snow, v, list(range(1, 8))).withColumn("var", F.lit(v))
        return wide.withColumnsRenamed({f"{v}_{b}": f"band_{b}" for b in range(1, 8)})

    return reduce(DataFrame.unionByName, [one(v) for v in SNOW])


@query(
    "S29_snow_readers_all",
    "SELECT date, code, " + ", ".join(f"sum(value) FILTER (WHERE var = '{v}') AS {v}" for v in SNOW) + " FROM snow GROUP BY 1, 2",
)
def snow_readers_all(t):
    total = t.snow.groupBy("date", "code").pivot("var", list(SNOW)).agg(F.sum("value"))
    return readers.typed_forcing(total.withColumn("date", F.date_format("date", "dd.MM.yyyy")), list(SNOW))


@query(
    "S12_read_rainfall_runoff_all_models",
    " UNION ALL ".join(f"SELECT *, '{m}' AS model FROM ({_rr(m)}) AS r" for m in ("TFT", "TIDE", "TSMIXER")),
    "forecasted_discharge:r6",
)
def read_rainfall_runoff_all(t):
    def one(m):
        return readers.read_rainfall_runoff_forecasts(t.daily_ml.where(F.col("model") == m), "pentad").withColumn("model", F.lit(m))

    return reduce(DataFrame.unionByName, [one(m) for m in ("TFT", "TIDE", "TSMIXER")])


@query("S34_write_station_readings", "SELECT code, date, variable, unit, value FROM meteo")
def write_station_readings(t):
    dotted = t.meteo.withColumn("code", F.concat("code", F.lit(".0")))
    table = writers.station_readings_table(
        dotted.where("variable = 'Precipitation'"), dotted.where("variable != 'Precipitation'")
    )
    return _stored(t, table, ["code", "variable", "date"])


PERIOD_STATS = "SELECT code, issue_period, avg(discharge_avg) AS mean, max(discharge_avg) AS top FROM series_pentad WHERE issue_date GROUP BY 1, 2"


@query("S35_display_hydrograph", f"SELECT * FROM ({PERIOD_STATS}) AS s WHERE code IN (SELECT code FROM registry WHERE flag)", "mean:r6 top:r6")
def display_hydrograph(t):
    stats = t.series("pentad").where("issue_date").groupBy("code", "issue_period").agg(
        F.avg("discharge_avg").cast("string").alias("mean"), F.max("discharge_avg").cast("string").alias("top")
    )
    return readers.read_hydrograph(stats, t.registry, t.registry.where("flag"), ["mean", "top"])


@query(
    "S36_bulletin_selection",
    """SELECT f.code, f.code || ' - ' || name AS label, basin, model_short AS model, round_even(round(forecasted_discharge, 9), 3) AS forecast,
      round_even(round(forecasted_discharge - 5, 9), 3) AS fc_lower, round_even(round(forecasted_discharge + 5, 9), 3) AS fc_upper
    FROM forecasts AS f JOIN registry AS r ON f.code = r.code WHERE date = (SELECT max(date) FROM forecasts)""",
    "forecast:r6 fc_lower:r6 fc_upper:r6",
)
def bulletin_selection(t):
    newest = t.forecasts.agg(F.max("date").alias("d")).scalar()
    chosen = t.forecasts.where(F.col("date") == newest).withColumns(
        {"fc_lower": F.col("forecasted_discharge") - 5, "fc_upper": F.col("forecasted_discharge") + 5}
    )
    return readers.match_bulletin_selection(writers.bulletin_selection_table(chosen), t.registry)


