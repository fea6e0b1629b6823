"""U rows: unions, upserts and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, merge
from .registry import query
from .selection_queries import VIRTUAL, _rules

U_SHAPE = "discharge:r6"


@query(
    "U1_stack_models",
    """SELECT code, date, model_short, forecasted_discharge, CAST(NULL AS DOUBLE) AS Q95 FROM forecasts UNION ALL SELECT code, date, model AS model_short, Q50 AS forecasted_discharge, Q95 FROM daily_ml""",
    "forecasted_discharge:r5",
)
def stack_models(t):
    ml = t.daily_ml.select("code", "date", F.col("model").alias("model_short"), F.col("Q50").alias("forecasted_discharge"), "Q95")
    return merge.stack(t.forecasts.select("code", "date", "model_short", "forecasted_discharge"), ml)


@query(
    "U2_update_and_append",
    """SELECT coalesce(o.code, n.code) AS code, coalesce(o.date, n.date) AS date, coalesce(n.discharge, o.discharge) AS discharge
    FROM (SELECT * FROM raw WHERE date < DATE '2000-01-01') AS o FULL OUTER JOIN (SELECT * FROM holes WHERE date >= DATE '1999-01-01') AS n ON o.code = n.code AND o.date = n.date""",
    U_SHAPE,
)
def update_and_append(t):
    return merge.update_append(t.raw.where("date < '2000-01-01'"), t.holes.where("date >= '1999-01-01'"), ["code", "date"])


def _keep(winner, loser, wq, lq):
    return f"SELECT * FROM {winner} WHERE {wq} UNION ALL SELECT l.* FROM {loser} AS l WHERE {lq} AND NOT EXISTS (SELECT 1 FROM {winner} AS w WHERE {wq} AND w.code = l.code AND w.date = l.date)"


@query("U3_upsert_keep_last", _keep("holes", "raw", "date >= DATE '1999-01-01'", "date < DATE '2000-01-01'"), U_SHAPE)
def upsert_keep_last(t):
    return merge.upsert(t.raw.where("date < '2000-01-01'"), t.holes.where("date >= '1999-01-01'"), ["code", "date"])


@query(
    "U4_extend_reanalysis",
    _keep("forcing2", "forcing", "date < (SELECT max(date) FROM forcing2) - 195", "year(date) < 2001").replace(
        "SELECT * FROM forcing2", "WITH forcing2 AS (SELECT code, date, P * 2 AS P, T FROM forcing WHERE year(date) >= 2000) SELECT * FROM forcing2", 1
    ),
    "P:r6 T:r6",
)
def extend_reanalysis(t):
    operational = t.forcing.where("year(date) >= 2000").withColumn("P", F.col("P") * 2)
    return merge.extend_reanalysis(t.forcing.where("year(date) < 2001"), operational)


@query("U5_reanalysis_and_control", _keep("raw", "holes", "date < DATE '2000-01-01'", "date >= DATE '1999-01-01'"), U_SHAPE)
def reanalysis_and_control(t):
    return merge.upsert(t.raw.where("date < '2000-01-01'"), t.holes.where("date >= '1999-01-01'"), ["code", "date"], keep="first")


@query(
    "U6_add_missing_hydroposts",
    """SELECT code, date, discharge FROM daily UNION ALL SELECT DISTINCT CAST(90000 + c_custkey // 150 AS VARCHAR), (SELECT min(date) FROM daily), CAST(NULL AS DOUBLE) FROM customer""",
)
def add_missing_hydroposts(t):
    sites = t.customer.select((F.expr("c_custkey div 150") + 90000).cast("string").alias("code"))
    return merge.add_missing_sites(t.daily, sites.unionByName(t.daily.select("code")))


@query("U7_unique_codes", "SELECT DISTINCT code FROM series_pentad UNION SELECT code FROM forecasts UNION SELECT code FROM readings")
def unique_codes(t):
    return merge.unique_codes(t.daily, t.forecasts, t.readings)


@query(
    "U8_append_hindcast_new_stations",
    """SELECT code, date, forecasted_discharge FROM (SELECT code, date, model_short, forecasted_discharge, CASE WHEN model_short = 'LR' THEN 1 ELSE 0 END AS own FROM forecasts WHERE model_short IN ('LR', 'TFT')) AS f
    QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY own DESC) = 1""",
    "forecasted_discharge:r5",
)
def append_hindcast(t):
    own, hind = (
        t.forecasts.where(F.col("model_short") == m).select("code", "date", "forecasted_discharge") for m in ("LR", "TFT")
    )
    return merge.upsert(hind, own, ["code", "date"])


@query(
    "U9_replace_same_day_forecast",
    """SELECT code, forecast_date, date, model, Q50 FROM daily_ml WHERE model = 'TFT'
    UNION ALL SELECT code, forecast_date, date, model, Q50 FROM daily_ml AS o WHERE model = 'TIDE' AND NOT EXISTS (SELECT 1 FROM daily_ml AS n WHERE n.model = 'TFT' AND n.code = o.code AND n.forecast_date = o.forecast_date)""",
)
def replace_same_day(t):
    keep = ["code", "forecast_date", "date", "model", "Q50"]
    old, new = (t.daily_ml.where(F.col("model") == m).select(*keep) for m in ("TIDE", "TFT"))
    return merge.replace_same_day(old, new)


@query(
    "U10_code_twin",
    "SELECT code, date, discharge FROM daily UNION ALL SELECT '9' || code, date, discharge FROM daily WHERE code IN (SELECT code FROM registry WHERE flag)",
)
def code_twin(t):
    twins = t.registry.where("flag").select("code", F.concat(F.lit("9"), "code").alias("twin"))
    return merge.with_code_twins(t.daily, twins)


VIRTUAL_2001 = f"SELECT * FROM ({VIRTUAL.format(source='holes')}) AS v WHERE discharge IS NOT NULL"


@query(
    "U11_assemble_daily",
    f"""SELECT code, date, round_even(round(discharge, 9), 3) AS discharge FROM (
      SELECT code, date, discharge, 0 AS side FROM daily WHERE date < DATE '2001-01-01' UNION ALL SELECT code, date, discharge, 1 FROM raw WHERE date >= DATE '2000-01-01'
      UNION ALL SELECT code, date, P, 2 FROM forcing WHERE date < DATE '1995-02-01' UNION ALL SELECT code, CAST(ts AS DATE), avg(value), 3 FROM readings GROUP BY 1, 2
      UNION ALL SELECT code, date, discharge, 4 FROM ({VIRTUAL_2001}) AS v) AS s QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY side DESC) = 1""",
    U_SHAPE,
)
def assemble_daily(t):
    return merge.assemble_daily(
        t.daily.where("date < '2001-01-01'"),
        t.raw.where("date >= '2000-01-01'"),
        morning=aggregates.daily_mean_readings(t.readings),
        gap_values=t.forcing.where("date < '1995-02-01'").select("code", "date", F.col("P").alias("discharge")),
        virtual=aggregates.virtual_station(t.holes, _rules(t)).where("discharge is not null"),
    )


@query(
    "U11_assemble_daily_append",
    """SELECT code, date, round_even(round(discharge, 9), 3) AS discharge FROM daily WHERE date < DATE '2001-01-01'
    UNION ALL SELECT r.code, r.date, round_even(round(r.discharge, 9), 3) FROM raw AS r JOIN (SELECT code, max(date) AS d FROM daily WHERE date < DATE '2001-01-01' GROUP BY 1) AS l ON r.code = l.code WHERE r.date > d""",
    U_SHAPE,
)
def assemble_daily_append(t):
    return merge.assemble_daily(t.daily.where("date < '2001-01-01'"), t.raw.where("date >= '2000-01-01'"), new_wins=False)
