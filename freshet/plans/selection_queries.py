"""F and J rows: station selection and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, filters, hydrograph, joins, merge, skill, sorting
from ..operators import windows as win
from .registry import query
from .source_queries import PAIRS, SKILL, SKILL_KEYS, SKILL_SHAPE

FLAGGED = "(SELECT code FROM registry WHERE flag)"


@query("F1_filter_code_date", f"SELECT code, date, discharge FROM daily WHERE code IN {FLAGGED} AND date <= DATE '1999-06-30'")
def filter_code_date(t):
    return filters.filter_code_date(t.daily, t.registry.where("flag"), "1999-06-30")


@query("F2_filter_selected_stations", f"SELECT code, date, discharge FROM daily WHERE code IN {FLAGGED}")
def filter_selected_stations(t):
    return filters.filter_selected(t.daily, t.registry.where("flag"))


THRESHOLDS = {"sdivsigma": 2.0, "accuracy": 0.3, "nse": None}
SKILLED = f"SELECT * FROM ({SKILL}) AS s WHERE sdivsigma < 2.0 AND accuracy > 0.3"


def _skill(t):
    return skill.score(skill.pair_with_observations(t.forecasts, t.observed), SKILL_KEYS)


@query("F6_skilled_only", SKILLED, SKILL_SHAPE)
def skilled_only(t):
    return skill.skilled_only(_skill(t), THRESHOLDS)


@query("F7_since_year", "SELECT code, date, discharge FROM daily WHERE year(date) >= 1998")
def since_year(t):
    return skill.since_year(t.daily, 1998)


@query(
    "F9_codes_in_all",
    "SELECT code FROM daily INTERSECT SELECT code FROM forcing WHERE P > 20 INTERSECT SELECT code FROM registry WHERE flag",
)
def codes_in_all(t):
    return filters.codes_in_all(t.daily, t.forcing.where("P > 20"), t.registry.where("flag"))


@query("F10_predictable_rivers", "SELECT DISTINCT code FROM series_pentad WHERE code IN (SELECT code FROM registry WHERE flag)")
def predictable_rivers(t):
    return filters.predictable_rivers(t.daily, t.forcing, t.registry.withColumnRenamed("flag", "TFT"), "TFT")


def _configured(t, virtual=False):
    """Station records as the configuration holds them, nested."""
    due = F.struct(F.col("flag").alias("pentad_forecast"), (~F.col("flag")).alias("decad_forecast"))
    code = F.concat(F.lit("9"), F.col("code")) if virtual else F.col("code")
    return t.registry.select(
        code.alias("site_code"),
        F.col("name").alias("official_name"),
        due.alias("enabled_forecasts"),
        F.struct(F.col("river").alias("name")).alias("region"),
        F.struct(F.col("basin").alias("name")).alias("basin"),
        "bulletin_order",
    )


def _due(flag, code="code"):
    return f"SELECT {code} AS code, name, river AS river_name, place AS punkt_name, river AS region, basin, bulletin_order FROM registry WHERE {flag}"


for _n, _h, _flag in (("F11", "pentad", "flag"), ("F11", "decad", "NOT flag")):

    @query(f"F11_sites_due_{_h}", _due(_flag))
    def sites_due(t, h=_h):
        return filters.sites_due(_configured(t), h)


@query("F12_virtual_sites_due", _due("flag", "'9' || code"))
def virtual_sites_due(t):
    return filters.sites_due(_configured(t, virtual=True), "pentad")


@query(
    "F13_decad_from_pentad_sites",
    f"SELECT code, name FROM registry WHERE code IN (SELECT code FROM daily WHERE discharge > 100) AND code IN {FLAGGED}",
)
def decad_from_pentad_sites(t):
    sites = t.registry.select("code", "name")
    return filters.decad_from_pentad_sites(sites, t.daily.where("discharge > 100"), t.registry.where("flag"))


@query("F14_day_window", "SELECT code, date, discharge FROM daily WHERE month(date) = 6 AND day(date) = 15")
def day_window(t):
    return filters.day_window(t.daily, "6-15")


@query(
    "F15_drop_blocks_with_null_labels",
    "SELECT code, date, model_short FROM forecasts WHERE model_short NOT IN (SELECT model_short FROM forecasts WHERE forecasted_discharge > 780)",
)
def drop_blocks(t):
    label = F.when(F.col("forecasted_discharge") <= 780, F.col("model_long"))
    return skill.complete_blocks(t.forecasts.withColumn("model_long", label)).select("code", "date", "model_short")


@query("F16_registry_filters", f"SELECT code, name FROM registry WHERE code LIKE '1%' AND code NOT LIKE '3%' AND code NOT IN {FLAGGED}")
def registry_filters(t):
    listed = filters.forecast_list(t.registry.select("code", "name"))
    return filters.configuration_list(listed, t.registry.where("flag"))


@query(
    "F17_hindcast_bounds",
    """SELECT CAST(min(date) + 60 AS DATE) AS earliest, CAST(max(date) - 5 AS DATE) AS latest,
      DATE '1996-01-01' >= min(date) + 60 AND DATE '2001-06-30' <= max(date) - 5 AS valid FROM forcing""",
)
def hindcast_bounds(t):
    return filters.hindcast_bounds(t.forcing, "1996-01-01", "2001-06-30", 5)


@query("F17_hindcast_guard", "SELECT code, date, P FROM forcing")
def hindcast_guard(t):
    return filters.require_hindcast_bounds(t.forcing, "1996-01-01", "2001-06-30", 5).select("code", "date", "P")


@query(
    "F18_stations_without_data",
    "SELECT code FROM registry WHERE code NOT IN (SELECT code FROM holes WHERE date = DATE '2001-07-01' AND discharge IS NOT NULL)",
)
def stations_without_data(t):
    return filters.stations_without_data(t.registry, t.holes, "2001-07-01")


MODELS = ["ARIMA", "LR", "TFT", "TSMixer", "TiDE"]


@query(
    "F18_missing_forecasts",
    f"""SELECT code, array_to_string(list_sort(list(m)), ',') AS models FROM (SELECT code, m FROM registry CROSS JOIN (SELECT unnest({MODELS}) AS m) AS all_models
      EXCEPT SELECT code, model_short FROM forecasts WHERE date = DATE '1998-05-31') AS absent GROUP BY 1""",
)
def missing_forecasts(t):
    rows = filters.missing_forecasts(t.registry, t.forecasts, "1998-05-31", MODELS)
    return rows.withColumn("models", F.array_join("models", ","))


@query("J1_forecasts_with_observations", f"SELECT code, date, model_short, s AS forecasted_discharge, o AS discharge_avg, delta FROM ({PAIRS}) AS p", "forecasted_discharge:r5 discharge_avg:r5 delta:r5")
def forecasts_with_observations(t):
    rows = skill.pair_with_observations(t.forecasts, t.observed)
    return rows.select("code", "date", "model_short", "forecasted_discharge", "discharge_avg", "delta")


@query("J2_skill_parts", SKILL, SKILL_SHAPE)
def skill_parts(t):
    return _skill(t)


@query(
    "J3_forecasts_with_ensemble",
    """SELECT code, date, model_short, forecasted_discharge FROM forecasts
    UNION ALL SELECT code, date, 'EM', avg(forecasted_discharge) FROM forecasts GROUP BY 1, 2""",
    "forecasted_discharge:r5",
)
def forecasts_with_ensemble(t):
    rows = t.forecasts.select("code", "date", "model_short", "forecasted_discharge")
    mean = skill.simple_ensemble(rows, ["code", "date"]).withColumn("model_short", F.lit("EM"))
    return skill.append_ensemble(skill.append_ensemble(rows, mean), mean)


STATS = """SELECT code, target_period, avg(q) FILTER (WHERE y <> 2000) AS mean, min(q) FILTER (WHERE y <> 2000) AS min, max(q) FILTER (WHERE y <> 2000) AS max,
    quantile_cont(CASE WHEN y <> 2000 THEN q END, 0.05) AS q05, quantile_cont(CASE WHEN y <> 2000 THEN q END, 0.25) AS q25, quantile_cont(CASE WHEN y <> 2000 THEN q END, 0.75) AS q75, quantile_cont(CASE WHEN y <> 2000 THEN q END, 0.95) AS q95,
    arg_max(q, date) FILTER (WHERE y = 1999 AND q IS NOT NULL) AS last_year, arg_max(q, date) FILTER (WHERE y = 2000 AND q IS NOT NULL) AS current_year,
    CAST(max(date) FILTER (WHERE y = 1999) + INTERVAL 1 YEAR AS DATE) AS last_date, max(dayofyear(date) + CASE WHEN month(date) > 2 THEN 1 ELSE 0 END) FILTER (WHERE y = 1999) AS last_doy
  FROM (SELECT code, date, target_period, year(date) AS y, discharge_avg AS q FROM {series} WHERE issue_date) AS s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE y <> 2000) > 0"""


@query(
    "J4_last_and_current_year",
    f"SELECT code, target_period AS pentad_in_year, round_even(round(last_year, 9), 3) AS last_year, round_even(round(current_year, 9), 3) AS current_year FROM ({STATS.format(series='series_pentad')}) AS s",
    "last_year:r6 current_year:r6",
)
def last_and_current_year(t):
    h = hydrograph.period_hydrograph(t.series("pentad"), "pentad", 2000)
    return h.select("code", "pentad_in_year", "last_year", "current_year")


def _norms(t):
    """72 values per station: mean discharge of each target period."""
    means = t.series("pentad").where("issue_date").groupBy("code", "target_period").agg(F.avg("discharge_avg").alias("m"))
    listed = F.array_sort(F.collect_list(F.struct("target_period", "m")))
    return means.groupBy("code").agg(listed.alias("l")).select("code", F.col("l.m").alias("norms"))


NORM_ROWS = "SELECT code, target_period, avg(discharge_avg) AS norm FROM series_pentad WHERE issue_date GROUP BY 1, 2"


@query(
    "J5_norms",
    f"SELECT code, target_period AS pentad_in_year, norm FROM ({NORM_ROWS}) AS n WHERE code IN (SELECT code FROM ({NORM_ROWS}) AS m GROUP BY 1 HAVING count(*) = 72)",
    "norm:r6",
)
def norms(t):
    return hydrograph.explode_norms(_norms(t), "pentad")


@query(
    "J6_observed_with_stats",
    "SELECT o.code, o.date, discharge_avg, q_mean, q_std_sigma, f.delta FROM observed AS o LEFT JOIN (SELECT code AS c, date AS d, q_mean, q_std_sigma, delta FROM linreg) AS f ON code = c AND date = d",
    "discharge_avg:r6 q_mean:r6 q_std_sigma:r6 delta:r6",
)
def observed_with_stats(t):
    return joins.with_stats(t.observed.drop("delta"), t.linreg)


@query(
    "J7_calendar_scaffold",
    """SELECT c.code, c.date, discharge FROM (SELECT code, date FROM (SELECT DISTINCT code FROM daily) AS k CROSS JOIN
      (SELECT CAST(unnest(generate_series((SELECT min(date) FROM daily), (SELECT max(date) FROM daily), INTERVAL 1 DAY)) AS DATE) AS date) AS d) AS c
    LEFT JOIN daily AS q ON c.code = q.code AND c.date = q.date""",
)
def calendar_scaffold(t):
    return joins.calendar_scaffold(t.daily)


@query(
    "J8_merge_forcing",
    "SELECT p.code, p.date, p.P, t.T FROM forcing AS p JOIN forcing AS t ON p.code = t.code AND p.date = CAST(t.date + 1 AS DATE)",
)
def merge_forcing(t):
    # temperatures move on a day, so that neither side holds all days of the other
    late = t.forcing.select("code", F.date_add("date", 1).alias("date"), "T")
    return joins.merge_forcing(t.forcing.select("code", "date", "P"), late)


@query(
    "J9_left_chain",
    """SELECT q.code, q.date, discharge, P, T, SWE, HS, ROF FROM daily AS q
      LEFT JOIN (SELECT code, CAST(date + 1 AS DATE) AS date, P, T FROM forcing) AS f ON q.code = f.code AND q.date = f.date
      LEFT JOIN (SELECT code, date, sum(value) AS SWE FROM snow WHERE var = 'SWE' GROUP BY 1, 2) AS a ON q.code = a.code AND q.date = a.date
      LEFT JOIN (SELECT code, date, sum(value) AS HS FROM snow WHERE var = 'HS' GROUP BY 1, 2) AS b ON q.code = b.code AND q.date = b.date
      LEFT JOIN (SELECT code, date, sum(value) AS ROF FROM snow WHERE var = 'ROF' GROUP BY 1, 2) AS c ON q.code = c.code AND q.date = c.date""",
)
def left_chain(t):
    # one aggregate gives all snow variables, and forcing moves on a day so that the sides differ
    sums = [F.sum(F.when(F.col("var") == v, F.col("value"))).alias(v) for v in ("SWE", "HS", "ROF")]
    snow = t.snow.groupBy("code", "date").agg(*sums)
    forcing = t.forcing.select("code", F.date_add("date", 1).alias("date"), "P", "T")
    return joins.left_chain(t.daily, forcing, snow)


NORM_2001 = """SELECT code, CAST(DATE '2001-01-01' + CAST(doy - 1 AS INTEGER) AS DATE) AS date, round_even(round(m, 8), 2) AS P_norm
  FROM (SELECT code, dayofyear(date) AS doy, avg(P) AS m FROM forcing GROUP BY 1, 2) AS n WHERE doy <= 365"""


@query(
    "J10_norm_with_operational",
    f"SELECT n.code, n.date, P_norm, P, T FROM ({NORM_2001}) AS n LEFT JOIN forcing AS f ON n.code = f.code AND n.date = f.date",
    "P_norm:r6",
)
def norm_with_operational(t):
    return joins.norm_with_operational(aggregates.daily_forcing_norm(t.forcing, "P", 2001), t.forcing)


def _selection(t):
    """Point selection: odd years of even periods are kept, even years are hidden."""
    rows = t.series("pentad").where(F.col("issue_date") & (F.col("issue_period") % 2 == 0))
    year = F.year("date")
    return rows.select("code", "issue_period", year.alias("year"), (year % 2 == 1).alias("visible"))


@query(
    "J11_select_points",
    "SELECT code, date, issue_period, CAST(year(date) AS INTEGER) AS year, predictor FROM series_pentad WHERE issue_date AND (issue_period % 2 = 1 OR year(date) % 2 = 1)",
    "predictor:r6",
)
def select_points(t):
    rows = t.series("pentad").where("issue_date").select("code", "date", "issue_period", "predictor")
    return joins.select_points(rows, _selection(t), "issue_period")


@query(
    "J12_forecasts_with_skill",
    f"""SELECT f.code, f.date, f.pentad_in_year, f.model_short, sdivsigma, accuracy FROM forecasts AS f LEFT JOIN ({SKILL}) AS s
      ON f.code = s.code AND f.pentad_in_year = s.pentad_in_year AND f.model_short = s.model_short""",
    "sdivsigma:r5 accuracy:r5",
)
def forecasts_with_skill(t):
    rows = joins.forecasts_with_skill(t.forecasts, _skill(t), "pentad_in_year")
    return rows.select("code", "date", "pentad_in_year", "model_short", "sdivsigma", "accuracy")


@query("J13_labels", "SELECT f.code, date, model_short, name, basin, f.code || ' - ' || name AS station_label FROM forecasts AS f LEFT JOIN registry AS r ON f.code = r.code")
def labels(t):
    return joins.with_labels(t.forecasts.select("code", "date", "model_short"), t.registry)


def _rules(t):
    """Each gauge contributes to the virtual station of its block of two."""
    number = F.col("code").cast("int") - 10000
    virtual = (F.floor(number / 2) + 90000).cast("string")
    return t.registry.select(
        virtual.alias("virtual_code"), "code", (F.pmod(number, F.lit(2)) * 0.5 + 0.5).alias("weight"),
        F.pmod(number, F.lit(2)).cast("int").alias("position"),
    )


RULES = """SELECT CAST(90000 + (CAST(code AS INTEGER) - 10000) // 2 AS VARCHAR) AS v, code AS c, ((CAST(code AS INTEGER) - 10000) % 2) * 0.5 + 0.5 AS w, (CAST(code AS INTEGER) - 10000) % 2 AS pos FROM registry"""
VIRTUAL = f"""SELECT v AS code, date, CASE WHEN count(discharge) = max(need) THEN sum(discharge * w) END AS discharge
  FROM {{source}} JOIN (SELECT *, count(*) OVER (PARTITION BY v) AS need FROM ({RULES}) AS r) AS rules ON code = c GROUP BY 1, 2 HAVING bool_or(pos = 0)"""


@query("J14_virtual_combine", VIRTUAL.format(source="holes"), "discharge:r6")
def virtual_combine(t):
    return aggregates.virtual_station(t.holes, _rules(t))


@query(
    "J14_virtual_forecasts",
    VIRTUAL.format(source="(SELECT code, date, model_short, forecasted_discharge AS discharge FROM forecasts) AS f")
    .replace("SELECT v AS code, date, CASE", "SELECT v AS code, date, model_short, CASE")
    .replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3"),
    "discharge:r5",
)
def virtual_forecasts(t):
    rows = t.forecasts.select("code", "date", "model_short", F.col("forecasted_discharge").alias("discharge"))
    return aggregates.virtual_station(rows, _rules(t), extra=("model_short",))


FC_GAPS = """SELECT code, prev AS a, forecast_date AS b FROM (SELECT code, forecast_date, lag(forecast_date) OVER (PARTITION BY code ORDER BY forecast_date) AS prev
  FROM (SELECT DISTINCT code, forecast_date FROM daily_ml WHERE model = 'TFT') AS u) AS l WHERE forecast_date - prev > 1"""


@query(
    "J15_fill_gaps_from_hindcast",
    f"""SELECT code, forecast_date, date, model, Q50 FROM daily_ml WHERE model = 'TFT'
    UNION ALL SELECT code, forecast_date, date, model, Q50 FROM daily_ml AS h WHERE model = 'TIDE' AND EXISTS (SELECT 1 FROM ({FC_GAPS}) AS g WHERE g.code = h.code AND h.forecast_date BETWEEN g.a AND g.b)""",
)
def fill_gaps_from_hindcast(t):
    keep = ["code", "forecast_date", "date", "model", "Q50"]
    made, hind = (t.daily_ml.where(F.col("model") == m).select(*keep) for m in ("TFT", "TIDE"))
    return joins.fill_gaps_from_hindcast(made, hind, win.forecast_gaps(made))


FLAGGED = "(SELECT code, model, forecast_date, date, Q50 FROM daily_ml WHERE flag = 1) AS made"
MODEL_GAPS = f"""SELECT code, model, prev AS a, forecast_date AS b FROM (SELECT code, model, forecast_date, lag(forecast_date) OVER (PARTITION BY code, model ORDER BY forecast_date) AS prev
  FROM (SELECT DISTINCT code, model, forecast_date FROM {FLAGGED}) AS u) AS l WHERE forecast_date - prev > 1"""


@query(
    "J15_fill_gaps_all_models",
    f"""SELECT * FROM {FLAGGED} UNION ALL SELECT code, model, forecast_date, date, Q50 * 2 AS Q50 FROM daily_ml AS h
    WHERE EXISTS (SELECT 1 FROM ({MODEL_GAPS}) AS g WHERE g.code = h.code AND g.model = h.model AND h.forecast_date BETWEEN g.a AND g.b)""",
)
def fill_gaps_all_models(t):
    """Every model's gaps, filled from its own hindcast."""
    keep = ["code", "model", "forecast_date", "date", "Q50"]
    made = t.daily_ml.where("flag = 1").select(*keep)
    hind = t.daily_ml.select(*keep).withColumn("Q50", F.col("Q50") * 2)
    keys = ["code", "model"]
    return joins.fill_gaps_from_hindcast(made, hind, win.forecast_gaps(made, keys=keys), keys)


@query(
    "J16_flagged_replacement",
    """SELECT f.code, f.forecast_date, f.date, CASE WHEN f.flag = 1 AND h.q IS NOT NULL THEN h.q ELSE f.Q50 END AS Q50, CAST(CASE WHEN f.flag = 1 AND h.q IS NOT NULL THEN 0 ELSE f.flag END AS INTEGER) AS flag
    FROM daily_ml AS f LEFT JOIN (SELECT code, forecast_date, date, Q50 * 2 AS q FROM daily_ml WHERE model = 'TIDE') AS h
      ON f.code = h.code AND f.forecast_date = h.forecast_date AND f.date = h.date WHERE f.model = 'TFT'""",
)
def flagged_replacement(t):
    keep = ["code", "forecast_date", "date", "Q50", "flag"]
    made = t.daily_ml.where("model = 'TFT'").select(*keep)
    hind = t.daily_ml.where("model = 'TIDE'").select(*keep).withColumns({"Q50": F.col("Q50") * 2, "flag": F.lit(0)})
    return joins.replace_flagged(made, hind, ["Q50"])


@query("J17_new_code_detection", "SELECT code FROM registry WHERE code NOT IN (SELECT code FROM forecasts WHERE forecasted_discharge > 815)")
def new_code_detection(t):
    return joins.new_codes(t.registry, t.forecasts.where("forecasted_discharge > 815"))


COMPARE = """SELECT n.code, n.variable, n.date, n.unit, n.value AS value_current, l.value AS value_last, m.value AS value_norm
  FROM (SELECT * FROM meteo WHERE year(date) = 2001) AS n
  JOIN (SELECT code, variable, CAST(date + INTERVAL 1 YEAR AS DATE) AS date, value FROM meteo WHERE year(date) = 2000) AS l ON n.code = l.code AND n.variable = l.variable AND n.date = l.date
  JOIN (SELECT code, variable, month(date) AS m, day(date) AS d, avg(value) AS value FROM meteo GROUP BY 1, 2, 3, 4) AS m ON n.code = m.code AND n.variable = m.variable AND month(n.date) = m.m AND day(n.date) = m.d"""
LONG = " UNION ALL ".join(
    f"SELECT code, variable, date, {unit} AS unit, '{name}' AS type, round_even(round({expr}, 8), 2) AS value FROM ({COMPARE}) AS c"
    for name, expr, unit in (
        ("value_current", "value_current", "unit"),
        ("value_last", "value_last", "unit"),
        ("value_norm", "value_norm", "unit"),
        ("diff_last_year", "value_current - value_last", "unit"),
        ("diff_norm", "value_current - value_norm", "unit"),
        ("percentage_last_year", "CASE WHEN value_last = 0 THEN 100 ELSE (value_current - value_last) / value_last * 100 END", "'%'"),
        ("percentage_norm", "CASE WHEN value_norm = 0 THEN 100 ELSE (value_current - value_norm) / value_norm * 100 END", "'%'"),
    )
)


@query(
    "J18_this_year_last_year_norm",
    f"SELECT code, variable, date, value FROM ({LONG}) AS l WHERE type = 'diff_norm'",
    "value:r6",
)
def this_year_last_year_norm(t):
    rows = aggregates.station_norm_compare(t.meteo, 2001)
    return rows.where("type = 'diff_norm'").select("code", "variable", "date", "value")


@query(
    "J19_arima_climatology",
    """SELECT a.code, a.doy AS day_of_year, coalesce(m.q, CASE WHEN a.doy = 366 THEN b.q END) AS discharge_daily_mean
    FROM (SELECT code, CAST(unnest(generate_series(1, 366)) AS INTEGER) AS doy FROM daily GROUP BY code) AS a
      LEFT JOIN (SELECT code, dayofyear(date) AS doy, avg(discharge) AS q FROM daily GROUP BY 1, 2) AS m ON a.code = m.code AND a.doy = m.doy
      LEFT JOIN (SELECT code, avg(discharge) AS q FROM daily WHERE dayofyear(date) = 365 GROUP BY 1) AS b ON a.code = b.code""",
    "discharge_daily_mean:r6",
)
def arima_climatology(t):
    return joins.climatology_366(t.daily)


CANDIDATE_SHAPE = "s:r5"


@query(
    "J20_candidates_tuple",
    f"""SELECT p.code, p.date, p.model_short, s FROM ({PAIRS}) AS p WHERE EXISTS (SELECT 1 FROM ({SKILLED}) AS k
      WHERE k.pentad_in_year = p.pentad_in_year AND k.code = p.code AND k.model_long = p.model_long AND k.model_short = p.model_short)""",
    CANDIDATE_SHAPE,
)
def candidates_tuple(t):
    pairs = skill.pair_with_observations(t.forecasts, t.observed)
    rows = skill.ensemble_candidates(pairs, skill.skilled_only(_skill(t), THRESHOLDS), SKILL_KEYS)
    return rows.select("code", "date", "model_short", F.col("forecasted_discharge").alias("s"))


@query(
    "J20_candidates_parity",
    f"""SELECT code, date, model_short, s FROM ({PAIRS}) AS p WHERE pentad_in_year IN (SELECT pentad_in_year FROM ({SKILLED}) AS a)
      AND code IN (SELECT code FROM ({SKILLED}) AS b) AND model_long IN (SELECT model_long FROM ({SKILLED}) AS c) AND model_short IN (SELECT model_short FROM ({SKILLED}) AS d)""",
    CANDIDATE_SHAPE,
)
def candidates_parity(t):
    pairs = skill.pair_with_observations(t.forecasts, t.observed)
    rows = skill.ensemble_candidates(pairs, skill.skilled_only(_skill(t), THRESHOLDS), SKILL_KEYS, parity=True)
    return rows.select("code", "date", "model_short", F.col("forecasted_discharge").alias("s"))


@query(
    "J21_danger_thresholds",
    "SELECT d.code, date, discharge, CASE WHEN flag THEN area / 100 END AS dangerous_discharge FROM daily AS d LEFT JOIN registry AS r ON d.code = r.code",
    "dangerous_discharge:r6",
)
def danger_thresholds(t):
    levels = t.registry.where("flag").select("code", (F.col("area") / 100).alias("dangerous_discharge"))
    return hydrograph.danger_thresholds(t.daily, levels)


@query(
    "J22_registry_merge",
    f"""SELECT code, CASE WHEN code IN (SELECT code FROM daily WHERE discharge > 150) THEN 'db ' || name ELSE 'cfg ' || name END AS name,
      CASE WHEN flag THEN lat + 1 ELSE lat END AS lat, CASE WHEN flag THEN lon + 1 ELSE lon END AS lon
    FROM registry WHERE (flag OR code IN (SELECT code FROM daily WHERE discharge > 150)) AND code IN (SELECT code FROM forecasts WHERE forecasted_discharge > 60)""",
)
def registry_merge(t):
    database = filters.filter_selected(t.registry, t.daily.where("discharge > 150")).select(
        "code", F.concat(F.lit("db "), "name").alias("name"), "lat", "lon"
    )
    configured = t.registry.where("flag").select(
        "code", F.concat(F.lit("cfg "), "name").alias("name"), (F.col("lat") + 1).alias("lat"), (F.col("lon") + 1).alias("lon")
    )
    return merge.merge_registry(database, configured, t.registry, t.forecasts.where("forecasted_discharge > 60"))


@query(
    "J23_models_for_station_and_date",
    "SELECT DISTINCT model_short, model_long FROM forecasts WHERE code = '10000' AND date = DATE '1998-05-31'",
)
def models_for(t):
    return aggregates.model_names(t.forecasts.withColumn("priority", F.lit(0)), "10000", "1998-05-31")


@query(
    "J24_site_statistics",
    f"""SELECT s.code, round_even(round(mean, 9), 3) AS mean, round_even(round(n.norm, 9), 3) AS norm, round_even(round(min, 9), 3) AS min, round_even(round(max, 9), 3) AS max, round_even(round(last_year, 9), 3) AS last_year, p.predictor
    FROM ({STATS.format(series='series_pentad')}) AS s
      LEFT JOIN (SELECT code, arg_max(predictor, date) FILTER (WHERE predictor IS NOT NULL) AS predictor FROM series_pentad WHERE issue_date AND issue_period = 34 GROUP BY 1) AS p ON s.code = p.code
      LEFT JOIN ({NORM_ROWS}) AS n ON s.code = n.code AND s.target_period = n.target_period
    WHERE s.target_period = 35""",
    "mean:r6 norm:r6 min:r6 max:r6 last_year:r6 predictor:r6",
)
def site_statistics(t):
    series = t.series("pentad")
    graph = hydrograph.period_hydrograph(series, "pentad", 2000, _norms(t))
    known = series.where(F.col("predictor").isNotNull())
    return joins.site_statistics(graph, known, "pentad", 35)


@query("T1_output_order", "SELECT code, date, discharge FROM daily")
def output_order(t):
    return sorting.output_order(t.daily)


@query("T2_bulletin_order", "SELECT basin, bulletin_order, code, name FROM registry")
def bulletin_order(t):
    return sorting.bulletin_order(t.registry.select("basin", "bulletin_order", "code", "name"))


@query(
    "T4_summary_table",
    """SELECT f.code, f.date, model_short, round_even(round(forecasted_discharge, 9), 3) AS forecasted_discharge, delta,
      round_even(round(forecasted_discharge - delta, 9), 3) AS fc_lower, round_even(round(forecasted_discharge + delta, 9), 3) AS fc_upper
    FROM forecasts AS f JOIN observed AS o ON f.code = o.code AND f.date = o.date
    WHERE f.date = (SELECT max(g.date) FROM forecasts AS g JOIN observed AS p ON g.code = p.code AND g.date = p.date)""",
    "forecasted_discharge:r6 delta:r6 fc_lower:r6 fc_upper:r6",
)
def summary_table(t):
    rows = skill.pair_with_observations(t.forecasts, t.observed)
    return sorting.summary_table(rows.select("code", "date", "model_short", "forecasted_discharge", "delta"))


@query(
    "T5_skill_table",
    f"SELECT *, (pentad_in_year - 1) // 6 + 1 AS month, (pentad_in_year - 1) % 6 + 1 AS pentad_in_month FROM ({SKILL}) AS s",
    SKILL_SHAPE + " month:i pentad_in_month:i",
)
def skill_table(t):
    return sorting.skill_table(_skill(t), "pentad")


