"""W rows: per-station windows over the whole daily record."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from ..operators import windows as win
from .registry import query
from .sql import DAYS, interpolated, issue

DN = "date - DATE '1970-01-01'"
FLAGGED = f"(SELECT *, {DN} AS dn, {issue('date')} AS issue_date, lead(discharge) OVER (PARTITION BY code ORDER BY date) AS nxt FROM daily) AS f"


@query("F3_pentad_issue_date", f"SELECT code, date, discharge, {issue('date')} AS issue_date FROM daily", "discharge:r6")
def pentad_issue_date(t):
    return win.add_issue_date(t.daily, "pentad")


@query("F4_decad_issue_date", f"SELECT code, date, discharge, {issue('date', 'decad')} AS issue_date FROM daily", "discharge:r6")
def decad_issue_date(t):
    return win.add_issue_date(t.daily, "decad")


@query("F5_negative_to_null", "SELECT code, date, CASE WHEN discharge >= 0 THEN discharge END AS discharge FROM raw", "discharge:r6")
def negative_to_null(t):
    return t.raw.withColumn("discharge", win.non_negative("discharge"))


@query(
    "W1_three_day_sum",
    f"""SELECT code, date, issue_date, CASE WHEN issue_date THEN sum(discharge) OVER (PARTITION BY code ORDER BY dn RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) END AS discharge_sum FROM {FLAGGED}""",
    "discharge_sum:r6",
)
def three_day_sum(t):
    return win.three_day_sum(win.add_issue_date(t.daily, "pentad")).drop("discharge")


def _next(h, day, lengths):
    def mean(k):
        return f"avg(nxt) OVER (PARTITION BY code ORDER BY dn RANGE BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"

    flagged = FLAGGED.replace(issue("date"), issue("date", h))
    cases = " ".join(f"WHEN day(date) = {day} AND day(last_day(date)) = {m} THEN {mean(k)}" for m, k in lengths.items())
    return f"SELECT code, date, issue_date, CASE WHEN NOT issue_date THEN NULL {cases} ELSE {mean(DAYS[h])} END AS discharge_avg FROM {flagged}"


@query("W2_next_pentad_avg", _next("pentad", 25, {28: 3, 29: 4, 31: 6}), "discharge_avg:r6")
def next_pentad_avg(t):
    return win.next_period_avg(win.add_issue_date(t.daily, "pentad"), "pentad").drop("discharge")


DECAD_AVG = _next("decad", 20, {28: 8, 29: 9, 31: 11})


@query("W3_next_decad_avg", DECAD_AVG, "discharge_avg:r6")
def next_decad_avg(t):
    return win.next_period_avg(win.add_issue_date(t.daily, "decad"), "decad").drop("discharge")


@query(
    "W4_decad_predictor",
    f"SELECT code, date, discharge_avg, CASE WHEN issue_date THEN lag(discharge_avg) OVER (PARTITION BY code, issue_date ORDER BY date) END AS predictor FROM ({DECAD_AVG}) AS a",
    "discharge_avg:r6 predictor:r6",
)
def decad_predictor(t):
    avg = win.next_period_avg(win.add_issue_date(t.daily, "decad"), "decad")
    return win.previous_issue_value(avg).select("code", "date", "discharge_avg", "predictor")


@query("W5_interpolate_rows", interpolated("holes", "discharge", 3, True, False), "discharge:r6")
def interpolate_rows(t):
    return win.interpolate(t.holes, "discharge", limit=3, both=True)


@query("W6_interpolate_time", interpolated("holes", "discharge", 2, False, True), "discharge:r6")
def interpolate_time(t):
    return win.interpolate(t.holes, "discharge", limit=2, by_time=True)


@query("W33_interpolate_linear", interpolated("holes", "discharge", None, False, False), "discharge:r6")
def interpolate_linear(t):
    return win.interpolate(t.holes, "discharge")


for _h in ("pentad", "decad"):

    @query(f"W7_prepare_series_{_h}", f"SELECT * FROM series_{_h}", "discharge:r6 predictor:r6 discharge_avg:r6")
    def prepare_series(t, h=_h):
        return t.series(h)


@query(
    "W8_change_filter",
    """SELECT code, date, CASE WHEN coalesce(abs(discharge - prev) > 3 * abs(prev), FALSE) THEN NULL ELSE discharge END AS discharge
    FROM (SELECT *, lag(discharge) OVER (PARTITION BY code ORDER BY date) AS prev FROM raw) AS r""",
    "discharge:r6",
)
def change_filter(t):
    return win.change_filter(t.raw)


SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring' WHEN month(date) <= 8 THEN 'summer' ELSE 'autumn' END"
SEASONAL = f"""SELECT d.code, d.date, CASE WHEN n <= 10 OR discharge BETWEEN q1 - 2.0 * (q3 - q1) AND q3 + 6.5 * (q3 - q1) THEN discharge END AS discharge
  FROM (SELECT *, {SEASON} AS season FROM daily) AS d JOIN (SELECT code, {SEASON} AS season, count(*) AS n, quantile_cont(discharge, 0.25) AS q1, quantile_cont(discharge, 0.75) AS q3 FROM daily GROUP BY 1, 2) AS b
  ON d.code = b.code AND d.season = b.season"""


@query("W9_seasonal_iqr_filter", SEASONAL, "discharge:r6")
def seasonal_iqr_filter(t):
    return win.seasonal_iqr_filter(t.daily)


REINDEX = """SELECT s.code, s.date, d.discharge FROM (SELECT code, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY code) AS s
  LEFT JOIN {source} AS d ON s.code = d.code AND s.date = d.date"""
ROUGH = f"""WITH seasonal AS ({SEASONAL}), full_days AS ({REINDEX.format(source='seasonal')}), first_fill AS ({interpolated('full_days', 'discharge', 2, False, True)}),
  steady AS (SELECT code, date, CASE WHEN coalesce(abs(discharge - prev) > 3 * abs(prev), FALSE) THEN NULL ELSE discharge END AS discharge FROM (SELECT *, lag(discharge) OVER (PARTITION BY code ORDER BY date) AS prev FROM first_fill) AS p)
  {interpolated('steady', 'discharge', 2, False, True)}"""


@query("W10_rough_outlier_filter", f"SELECT * FROM ({ROUGH}) AS rough", "discharge:r6")
def rough_outlier_filter(t):
    return win.rough_outlier_filter(t.daily)


@query("W12_daily_reindex", REINDEX.format(source="daily"), "discharge:r6")
def daily_reindex(t):
    return win.daily_reindex(t.daily)


IQR = """SELECT m.code, m.variable, m.date, CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END AS value
  FROM meteo AS m JOIN (SELECT code, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM meteo GROUP BY 1, 2) AS b ON m.code = b.code AND m.variable = b.variable"""


@query(
    "W11_station_iqr_filter",
    f"WITH limited AS ({IQR}) {interpolated('limited', 'value', 2, False, True, keys='code, variable')}",
    "value:r6",
)
def station_iqr_filter(t):
    rows = t.meteo.withColumn("arrival", F.lit(0))
    return win.station_iqr_filter(rows, order="arrival", tasks=t.tasks).select("code", "variable", "date", "value")


CUT = "DATE '2001-12-31' - 1800"


@query(
    "W13_detect_gaps",
    f"""SELECT code, CAST(greatest(date + 1, {CUT}) AS DATE) AS gap_start, CAST(nxt - 1 AS DATE) AS gap_end
    FROM (SELECT code, date, lead(date) OVER (PARTITION BY code ORDER BY date) AS nxt FROM daily) AS d WHERE greatest(date + 1, {CUT}) <= nxt - 1""",
)
def detect_gaps(t):
    return win.detect_gaps(t.daily, "2001-12-31", 1800)


@query(
    "W14_group_gaps",
    """WITH opened AS (SELECT code, gap_start, gap_end, CASE WHEN gap_start > CAST(reach + 1 AS DATE) OR reach IS NULL THEN 1 ELSE 0 END AS opens
      FROM (SELECT *, max(gap_end) OVER (ORDER BY gap_start, gap_end, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gaps) AS g),
    islands AS (SELECT *, sum(opens) OVER (ORDER BY gap_start, gap_end, code) AS island FROM opened),
    sites AS (SELECT island, code, min(gap_start) AS a, max(gap_end) AS b, (dense_rank() OVER (PARTITION BY island ORDER BY code) - 1) // 30 AS batch FROM islands GROUP BY island, code)
    SELECT island, batch, min(a) AS start_date, max(b) AS end_date, array_to_string(list_sort(list(code)), ',') AS sites FROM sites GROUP BY island, batch""",
    "island:l batch:i",
)
def group_gaps(t):
    return win.group_gaps(t.gaps).withColumn("sites", F.array_join("sites", ","))


@query(
    "W15_forecast_gaps",
    """SELECT code, prev AS gap_start, forecast_date AS gap_end FROM (SELECT code, forecast_date, lag(forecast_date) OVER (PARTITION BY code ORDER BY forecast_date) AS prev
      FROM (SELECT DISTINCT code, forecast_date FROM daily_ml) AS u) AS l WHERE forecast_date - prev > 1""",
)
def forecast_gaps(t):
    return win.forecast_gaps(t.daily_ml)


def _frame(w):
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _rolling(op, w):
    fn = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}[op]
    need = max(1, min(int(w * 0.5), 15))
    return f"CASE WHEN count(discharge) OVER {_frame(w)} >= {need} THEN {fn}(discharge) OVER {_frame(w)} END AS discharge_roll_{op}_{w}"


OPS = [(op, w) for op in ("mean", "sum", "min", "max", "std") for w in (3, 7, 15, 30)]


@query(
    "W16_rolling_features",
    f"SELECT code, date, {', '.join(_rolling(o, w) for o, w in OPS)} FROM holes",
    " ".join(f"discharge_roll_{o}_{w}:r6" for o, w in OPS),
)
def rolling_features(t):
    specs = {"discharge": [(op, [3, 7, 15, 30]) for op in ("mean", "sum", "min", "max", "std")]}
    return win.rolling_features(t.holes, specs).drop("discharge")


def _shape(w, expr, name):
    need = max(1, min(int(w * 0.5), 15))
    gate = f"count(discharge) OVER {_frame(w)} >= {need} AND count(discharge) OVER {_frame(w)} = count(*) OVER {_frame(w)}"
    return f"CASE WHEN {gate} THEN {expr} END AS discharge_roll_{name}_{w}"


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM holes) AS r"


@query(
    "W17_rolling_slope",
    "SELECT code, date, "
    + ", ".join(
        _shape(w, f"CASE WHEN count(discharge) OVER {_frame(w)} >= 2 THEN regr_slope(discharge, rn) OVER {_frame(w)} END", "slope")
        for w in (7, 15)
    )
    + f" FROM {NUMBERED}",
    "discharge_roll_slope_7:r6 discharge_roll_slope_15:r6",
)
def rolling_slope(t):
    return win.rolling_features(t.holes, {"discharge": [("slope", [7, 15])]}).drop("discharge")


@query(
    "W18_rolling_shape",
    "SELECT code, date, "
    + ", ".join(
        [
            _shape(7, f"max(discharge) OVER {_frame(7)} - min(discharge) OVER {_frame(7)}", "peak_to_peak"),
            _shape(7, f"mad(discharge) OVER {_frame(7)}", "median_abs_deviation"),
            _shape(7, f"rn - arg_max(rn, discharge * 100000 - rn) OVER {_frame(7)} + 1", "time_distance_from_peak"),
        ]
    )
    + f" FROM {NUMBERED}",
    "discharge_roll_peak_to_peak_7:r6 discharge_roll_median_abs_deviation_7:r6 discharge_roll_time_distance_from_peak_7:i",
)
def rolling_shape(t):
    ops = ("peak_to_peak", "median_abs_deviation", "time_distance_from_peak")
    return win.rolling_features(t.holes, {"discharge": [(o, [7]) for o in ops]}).drop("discharge")


@query(
    "W19_lag_features",
    "SELECT code, date, discharge, "
    + ", ".join(
        f"{'lag' if n > 0 else 'lead'}(discharge, {abs(n)}) OVER (PARTITION BY code ORDER BY date) AS discharge_{'lag' if n > 0 else 'lead'}_{abs(n)}"
        for n in (1, 5, 10, -3)
    )
    + " FROM daily",
)
def lag_features(t):
    return win.lag_features(t.daily, "discharge", [1, 5, 10, -3])


@query(
    "W20_dedupe_keep_last",
    """SELECT CAST(10000 + user_id // 15 AS VARCHAR) AS code, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS last_value, arg_min(value, event_id) AS first_value FROM events GROUP BY 1, 2""",
)
def dedupe_keep_last(t):
    rows = t.events.select(
        (F.expr("user_id div 15") + 10000).cast("string").alias("code"),
        F.to_date("ts").alias("date"),
        "event_id",
        "value",
    )
    last = merge.dedupe(rows, ["code", "date"], F.col("event_id"))
    first = merge.dedupe(rows, ["code", "date"], F.col("event_id"), keep="first")
    last = last.select("code", "date", F.col("value").alias("last_value"))
    return last.join(first.select("code", "date", F.col("value").alias("first_value")), ["code", "date"])


@query(
    "W21_latest_per_period",
    """WITH newest AS (SELECT code, issue_period, max(date) AS date, arg_max(predictor, date) AS predictor FROM series_pentad WHERE issue_date GROUP BY 1, 2)
    SELECT code, issue_period, date, predictor FROM newest WHERE year(date) >= (SELECT max(year(date)) FROM newest) - 1""",
    "predictor:r6",
)
def latest_per_period(t):
    rows = t.series("pentad").where("issue_date").select("code", "issue_period", "date", "predictor")
    return merge.latest_per_period(rows, "pentad", "issue_period")


@query(
    "W22_latest_forecasts",
    """WITH newest AS (SELECT code, pentad_in_year, model_short, max(date) AS date, arg_max(forecasted_discharge, date) AS q FROM forecasts GROUP BY 1, 2, 3)
    SELECT code, pentad_in_year, model_short, date, round_even(round(q, 9), 3) AS forecasted_discharge FROM newest WHERE year(date) >= (SELECT max(year(date)) FROM newest) - 1""",
    "forecasted_discharge:r6",
)
def latest_forecasts(t):
    return merge.latest_forecasts(
        t.forecasts.select("code", "pentad_in_year", "model_short", "date", "forecasted_discharge"), "pentad"
    )


@query(
    "W23_nulled_stale_rows",
    """SELECT code, date, CASE WHEN date >= make_date((SELECT max(year(date)) FROM daily), 1, 1) - 5 THEN discharge END AS discharge FROM daily""",
)
def nulled_stale_rows(t):
    return merge.null_stale_rows(t.daily, ["discharge"])


@query(
    "W24_last_n_per_group",
    "SELECT code, date, discharge FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM daily) AS r WHERE rn <= 17",
)
def last_n_per_group(t):
    return merge.last_n_per_group(t.daily, ["code"], "date", 17)


def _bfill(w):
    mean = f"CASE WHEN count(discharge) OVER {_frame(w)} = {w} THEN avg(discharge) OVER {_frame(w)} END AS m{w}"
    fill = f"first_value(m{w} IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS discharge_mean_{w}"
    return mean, fill


BFILL = [_bfill(w) for w in (3, 5, 10)]


@query(
    "W25_rolling_mean_bfill",
    f"SELECT code, date, {', '.join(f for _, f in BFILL)} FROM (SELECT code, date, {', '.join(m for m, _ in BFILL)} FROM daily) AS m",
    "discharge_mean_3:r6 discharge_mean_5:r6 discharge_mean_10:r6",
)
def rolling_mean_bfill(t):
    return win.rolling_mean_bfill(t.daily, "discharge").drop("discharge")


LAST = "last_value(discharge IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LATER = "first_value(discharge IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "W26_forward_fill",
    f"SELECT code, date, {LAST} AS filled, CASE WHEN {LATER} IS NULL THEN {LAST} ELSE discharge END AS tail_filled FROM holes",
)
def forward_fill(t):
    both = t.holes.withColumns({"filled": F.col("discharge"), "tail_filled": F.col("discharge")}).drop("discharge")
    return win.ffill(win.ffill(both, "filled"), "tail_filled", trailing_only=True)


@query(
    "W27_target_future_mean",
    """SELECT code, date, CASE WHEN count(*) OVER e = 1 AND count(discharge) OVER w >= 7 THEN avg(discharge) OVER w END AS target FROM holes
    WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 6 FOLLOWING AND 15 FOLLOWING), e AS (PARTITION BY code ORDER BY date ROWS BETWEEN 15 FOLLOWING AND 15 FOLLOWING)""",
    "target:r6",
)
def target_future_mean(t):
    return win.target_future_mean(t.holes, "discharge", 10, 15).drop("discharge")


@query(
    "W30_trailing_nulls",
    "SELECT h.code, count(*) FILTER (WHERE last IS NULL OR date > last) AS trailing_nulls FROM holes AS h JOIN (SELECT code, max(date) FILTER (WHERE discharge IS NOT NULL) AS last FROM holes GROUP BY 1) AS l ON h.code = l.code GROUP BY 1",
    "trailing_nulls:l",
)
def trailing_nulls(t):
    return win.trailing_nulls(t.holes)


@query(
    "W31_hindcast_start",
    """SELECT max(start) AS start_date FROM (SELECT start FROM (SELECT CAST(max(date) + 1 AS DATE) AS start FROM daily GROUP BY code
      UNION ALL SELECT DISTINCT DATE '1999-01-01' FROM registry WHERE code NOT IN (SELECT code FROM daily)) AS s ORDER BY start LIMIT 2) AS two""",
)
def hindcast_start(t):
    last = t.daily.groupBy("code").agg(F.max("date").alias("last_date"))
    return win.hindcast_start(last, t.registry, "1999-01-01")


FILL = """SELECT h.code, h.date, coalesce(h.discharge, f.q) AS discharge FROM holes AS h
  LEFT JOIN (SELECT code, date, arg_max(q, fd) AS q FROM (SELECT code, date, forecast_date AS fd, max(Q50) AS q FROM daily_ml GROUP BY 1, 2, 3) AS u GROUP BY 1, 2) AS f ON h.code = f.code AND h.date = f.date"""


@query(
    "W32_fill_from_previous_forecast",
    f"WITH patched AS ({FILL}) {interpolated('patched', 'discharge', None, False, False)}",
    "discharge:r6",
)
def fill_from_previous_forecast(t):
    forecasts = t.daily_ml.groupBy("code", "date", "forecast_date").agg(F.max("Q50").alias("Q50"))
    return win.fill_from_previous_forecast(t.holes, forecasts)

