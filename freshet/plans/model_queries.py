"""R rows: regressions, feature tables and per-station models."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, features, models, pca, regression, selection
from ..session import cut_lineage
from .registry import query
from .aggregate_queries import FEATURES, _features
from .selection_queries import _selection
from .series_queries import _frame
from .sql import columns, fit, interpolated, sig

FIT_SHAPE = "slope:r5 intercept:r5 rsquared:r5 q_mean:r6 q_std_sigma:r6 delta:r6"
KNOWN = "discharge IS NOT NULL AND predictor IS NOT NULL AND discharge_avg IS NOT NULL"


for _h in ("pentad", "decad"):

    @query(
        f"R1_fit_{_h}" if _h == "decad" else "R1_fit_period_regression",
        f"SELECT code, issue_period, {columns(fit('discharge_avg', 'predictor'))} FROM series_{_h} WHERE {KNOWN} GROUP BY 1, 2",
        FIT_SHAPE,
    )
    def fit_period_regression(t, h=_h):
        return regression.fit_period_regression(t.series(h), complete=["discharge", "predictor", "discharge_avg"])


@query(
    "R1_forecast_one_period",
    f"""SELECT s.code, date, predictor, slope * predictor + intercept AS forecasted_discharge FROM (SELECT * FROM series_pentad WHERE issue_period = 36) AS s
    LEFT JOIN (SELECT code, {columns(fit('discharge_avg', 'predictor'))} FROM series_pentad WHERE issue_period = 36 AND {KNOWN} GROUP BY 1) AS f ON s.code = f.code""",
    "predictor:r6 forecasted_discharge:r5",
)
def forecast_one_period(t):
    rows = regression.forecast_period(t.series("pentad"), 36)
    return rows.select("code", "date", "predictor", "forecasted_discharge")


def _hindcast(h, upto):
    over = f" OVER (PARTITION BY code, issue_period ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"
    x, y = (f"CASE WHEN {KNOWN} THEN {c} END" for c in ("predictor", "discharge_avg"))
    return f"""SELECT code, date, issue_period, slope, intercept, rsquared, q_mean, q_std_sigma, delta, slope * predictor + intercept AS forecasted_discharge
      FROM (SELECT code, date, issue_period, predictor, {columns(fit(f'({y})', f'({x})', over))} FROM series_{h} WHERE issue_date) AS f"""


HIND_SHAPE = "slope:r4 intercept:r4 rsquared:r5 q_mean:r6 q_std_sigma:r5 delta:r5 forecasted_discharge:r4"

for _name, _h, _parity in (
    ("R2_hindcast_regression", "pentad", False),
    ("R2_hindcast_decad", "decad", False),
    ("R2_hindcast_parity", "pentad", True),
):

    @query(_name, _hindcast(_h, "CURRENT ROW" if _parity else "1 PRECEDING"), HIND_SHAPE)
    def hindcast(t, h=_h, parity=_parity):
        rows = regression.hindcast_regression(t.series(h), parity=parity)
        return rows.select("code", "date", "issue_period", *regression.FITTED, "forecasted_discharge")


@query(
    "R3_point_selected_regression",
    f"""SELECT code, issue_period, {columns(fit('discharge_avg', 'predictor'))} FROM series_pentad
    WHERE issue_date AND (issue_period % 2 = 1 OR year(date) % 2 = 1) AND predictor IS NOT NULL AND discharge_avg IS NOT NULL GROUP BY 1, 2""",
    FIT_SHAPE,
)
def point_selected_regression(t):
    rows = t.series("pentad").where("issue_date").select("code", "date", "issue_period", "predictor", "discharge_avg")
    return regression.point_selected_regression(rows, _selection(t))


def _text(x):
    return (
        f"CASE WHEN {x} < 0 THEN ' ' WHEN {x} = 0 THEN '0' WHEN {x} < 10 THEN CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR) "
        f"WHEN {x} < 100 THEN CAST(CAST({x} AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST(CAST({x} AS DECIMAL(18,0)) AS VARCHAR) END"
    )


def _site_forecast(today):
    return f"""SELECT code, predictor, fc_qexp, q_norm, CASE WHEN fc_qexp / q_norm * 100 BETWEEN 0 AND 500 THEN CAST(CAST(round_even(fc_qexp / q_norm * 100, 0) AS INTEGER) AS VARCHAR) ELSE ' ' END AS perc_norm,
      CASE WHEN lo IS NULL OR (lo = 0 AND hi = 0) THEN ' ' ELSE {_text('lo')} END AS fc_qmin, CASE WHEN lo IS NULL OR (lo = 0 AND hi = 0) THEN ' ' ELSE {_text('hi')} END AS fc_qmax
    FROM (SELECT *, CASE WHEN fc_qexp - delta < 0 THEN 0 ELSE fc_qexp - delta END AS lo, CASE WHEN fc_qexp + delta < 0 THEN 0 ELSE fc_qexp + delta END AS hi FROM (
      SELECT code, predictor, delta, {sig('raw_q')} AS fc_qexp, q_norm FROM (
      SELECT s.code, s.predictor, delta, CASE WHEN slope * s.predictor + intercept < 0 THEN 0 ELSE slope * s.predictor + intercept END AS raw_q, q_norm
      FROM {today} AS s LEFT JOIN fits AS f ON s.code = f.code AND s.issue_period = f.issue_period
        LEFT JOIN (SELECT code, issue_period, avg(discharge_avg) AS q_norm FROM series_pentad GROUP BY 1, 2) AS n ON s.code = n.code AND s.issue_period = n.issue_period) AS u) AS a) AS b"""


ONE_DATE = f"(SELECT code, issue_period, {sig('predictor')} AS predictor FROM series_pentad WHERE date = DATE '1999-06-25')"
SOME_DATES = f"""(SELECT code, issue_period, {sig('p')} AS predictor FROM (SELECT code, arg_max(issue_period, date) AS issue_period, avg(predictor) AS p
    FROM series_pentad WHERE date IN (DATE '1999-06-15', DATE '1999-06-20', DATE '1999-06-25') GROUP BY 1) AS d)"""


for _name, _dates, _today in (
    ("R4_site_forecast", "1999-06-25", ONE_DATE),
    ("R4_site_forecast_over_dates", ["1999-06-15", "1999-06-20", "1999-06-25"], SOME_DATES),
):

    @query(_name, _site_forecast(_today), "predictor:r6 fc_qexp:r5 q_norm:r6")
    def site_forecast(t, dates=_dates):
        series = t.series("pentad")
        norms = aggregates.period_norms(series, "issue_period")
        rows = regression.site_forecast(series, t.fits, norms, dates)
        return rows.select("code", "predictor", "fc_qexp", "q_norm", "perc_norm", "fc_qmin", "fc_qmax")


AS_OF = "2001-06-15"


def _targets(t):
    return _features(t).withColumnRenamed("discharge", "target")


for _kind in ("linear", "ridge", "lasso"):

    @query(f"R5_monthly_regression_{_kind}", None, "Q:r2 r2:r6")
    def monthly_regression(t, kind=_kind):
        return models.monthly_regression(_targets(t), FEATURES, AS_OF, kind=kind, alpha=0.5)


R6_SPECS = {"discharge": [("mean", [3, 15]), ("slope", [7])], "P": [("sum", [7])]}


def _roll(c, fn, w, name, shape=False):
    need = max(1, min(int(w * 0.5), 15))
    gate = f"count({c}) OVER {_frame(w)} >= {need}"
    if shape:
        gate += f" AND count({c}) OVER {_frame(w)} >= 2 AND count({c}) OVER {_frame(w)} = count(*) OVER {_frame(w)}"
    return f"CASE WHEN {gate} THEN {fn} OVER {_frame(w)} END AS {c}_roll_{name}_{w}"


R6_SQL = ", ".join(
    [
        _roll("discharge", "avg(discharge)", 3, "mean"),
        _roll("discharge", "avg(discharge)", 15, "mean"),
        _roll("discharge", "regr_slope(discharge, rn)", 7, "slope", True),
        _roll("P", "sum(P)", 7, "sum"),
        "lag(discharge, 1) OVER (PARTITION BY code ORDER BY date) AS discharge_lag_1",
        "sin(2 * pi() * dayofyear(date) / 365) AS day_of_year_sin",
        "cos(2 * pi() * dayofyear(date) / 365) AS day_of_year_cos",
        "CASE WHEN count(*) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 10 FOLLOWING AND 10 FOLLOWING) = 1 AND count(discharge) OVER w >= 7 THEN avg(discharge) OVER w END AS target",
    ]
)


@query(
    "R6_feature_table",
    f"""SELECT code, date, discharge, P, T, {R6_SQL} FROM (SELECT h.code, h.date, discharge, P, T, row_number() OVER (PARTITION BY h.code ORDER BY h.date) AS rn
      FROM holes AS h JOIN forcing AS f ON h.code = f.code AND h.date = f.date) AS r WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""",
    "discharge_roll_mean_3:r6 discharge_roll_mean_15:r6 discharge_roll_slope_7:r6 P_roll_sum_7:r6 day_of_year_sin:r6 day_of_year_cos:r6 target:r6",
)
def feature_table(t):
    rows = t.holes.join(t.forcing, ["code", "date"])
    table = features.feature_table(rows, R6_SPECS, {"discharge": [1]}, "discharge", 10, 10)
    return table.drop("week_sin", "week_cos", "month_sin", "month_cos")


@query(
    "R7_impute_mean",
    "SELECT code, date, coalesce(discharge, (SELECT avg(discharge) FROM holes)) AS discharge FROM holes",
    "discharge:r6",
)
def impute_mean(t):
    return features.impute_mean(t.holes, ["discharge"])


NEAREST = """WITH x AS (SELECT h.code, h.date, discharge, P, CASE WHEN T >= -1 THEN T END AS T FROM holes AS h JOIN forcing AS f ON h.code = f.code AND h.date = f.date),
  far AS (SELECT a.code, a.date, b.date AS other, b.discharge AS v, (coalesce((a.P - b.P) * (a.P - b.P), 0) + coalesce((a.T - b.T) * (a.T - b.T), 0)) * 3.0
      / (CASE WHEN a.P - b.P IS NULL THEN 0 ELSE 1 END + CASE WHEN a.T - b.T IS NULL THEN 0 ELSE 1 END) AS d
    FROM x AS a JOIN x AS b ON a.code = b.code AND month(a.date) = month(b.date) WHERE a.discharge IS NULL AND b.discharge IS NOT NULL),
  near AS (SELECT code, date, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY d, other) AS n FROM far) AS r WHERE n <= 5 GROUP BY 1, 2)
  SELECT x.code, x.date, coalesce(discharge, v) AS discharge, P, T FROM x LEFT JOIN near AS n ON x.code = n.code AND x.date = n.date"""


@query("R7_impute_knn", NEAREST, "discharge:r6 P:r6 T:r6")
def impute_knn(t):
    rows = t.holes.join(t.forcing, ["code", "date"]).withColumn("T", F.when(F.col("T") >= -1, F.col("T")))
    return features.impute_knn(rows, ["discharge", "P", "T"], ["discharge"]).select("code", "date", "discharge", "P", "T")


@query("R8_pca_groups")
def pca_groups(t):
    rows = features.pca_groups(_features(t), {"P": ["P_1", "P_2"], "T": ["T_1", "T_2"]})
    # the sign of a component is arbitrary
    return rows.select("code", "date", *[F.round(F.abs(c), 6).alias(c) for c in rows.columns if "_pc" in c])


@query("R9_select_k_best", "SELECT x.code, x.date, discharge AS target, P AS P_1, P * P AS P_2 FROM daily AS x JOIN forcing AS f ON x.code = f.code AND x.date = f.date", "P_1:r6 P_2:r6")
def select_k_best(t):
    # built once for the two passes of the scores and for the result
    rows = cut_lineage(_targets(t))
    return rows.select("code", "date", "target", *features.select_k_best(rows, FEATURES, "target", 2))


FOREST = {"numTrees": 5, "maxDepth": 3, "seed": 7}


@query("R10_leave_one_year_out")
def leave_one_year_out(t):
    return models.leave_one_year_out(_targets(t), FEATURES, "target", "linear")


@query("R10_leave_one_year_out_cascade")
def leave_one_year_out_cascade(t):
    return models.leave_one_year_out(_targets(t), FEATURES, "target", "random_forest", FOREST, cascade=True)


@query("R11_fit_on_all")
def fit_on_all(t):
    rows = _targets(t)
    model = models.fit_on_all(rows, FEATURES, "target", "random_forest", FOREST)
    return model.transform(rows).select("code", "date", "target", "prediction")


@query("R12_feature_importance")
def feature_importance(t):
    model = models.fit_on_all(_targets(t), FEATURES, "target", "random_forest", FOREST)
    return models.feature_importance(model, FEATURES, t.spark)


@query("R13_hyper_parameter_search")
def hyper_parameter_search(t):
    grid = {"maxDepth": [2, 4]}
    return models.search_parameters(_targets(t), FEATURES, "target", "random_forest", grid).select("params", "rmse")


@query("R13_random_trials")
def random_trials(t):
    space = {"maxDepth": (2, 5), "numTrees": [3, 6], "minInstancesPerNode": (1, 50, "log")}
    return models.search_parameters(_targets(t), FEATURES, "target", "random_forest", space=space, trials=4, seed=11)


END = "DATE '2001-06-15'"
SPAN = f"(SELECT code, CAST(unnest(generate_series({END} - 61, {END}, INTERVAL 1 DAY)) AS DATE) AS date FROM holes GROUP BY code)"
INPUT = f"""WITH span AS (SELECT s.code, s.date, discharge FROM {SPAN} AS s LEFT JOIN holes AS h ON s.code = h.code AND s.date = h.date),
  known AS (SELECT code, date, arg_max(q, fd) AS fc FROM (SELECT code, date, forecast_date AS fd, max(Q50) AS q FROM daily_ml WHERE model = 'TFT' GROUP BY 1, 2, 3) AS u GROUP BY 1, 2),
  first_bad AS (SELECT code, nulls > 20 OR tail >= 3 AS bad FROM (SELECT s.code, count(*) FILTER (WHERE discharge IS NULL) AS nulls, least(count(*) FILTER (WHERE discharge IS NULL AND (last IS NULL OR date > last)), 20) AS tail
    FROM span AS s JOIN (SELECT code, max(date) FILTER (WHERE discharge IS NOT NULL) AS last FROM span WHERE date > {END} - 60 GROUP BY 1) AS l ON s.code = l.code WHERE date > {END} - 60 GROUP BY 1) AS a),
  patched AS (SELECT s.code, s.date, CASE WHEN bad THEN discharge ELSE coalesce(discharge, fc) END AS discharge FROM span AS s JOIN first_bad AS f ON s.code = f.code LEFT JOIN known AS k ON s.code = k.code AND s.date = k.date),
  second_bad AS (SELECT code, nulls > 20 OR tail >= 3 AS bad FROM (SELECT s.code, count(*) FILTER (WHERE discharge IS NULL) AS nulls, least(count(*) FILTER (WHERE discharge IS NULL AND (last IS NULL OR date > last)), 20) AS tail
    FROM patched AS s JOIN (SELECT code, max(date) FILTER (WHERE discharge IS NOT NULL) AS last FROM patched WHERE date > {END} - 60 GROUP BY 1) AS l ON s.code = l.code WHERE date > {END} - 60 GROUP BY 1) AS a),
  done AS ({interpolated('patched', 'discharge', None, False, False)})
  SELECT p.code, p.date, CASE WHEN bad THEN p.discharge ELSE d.discharge END AS discharge, CAST(bad AS INTEGER) AS flag FROM patched AS p JOIN second_bad AS b ON p.code = b.code JOIN done AS d ON p.code = d.code AND p.date = d.date"""


@query("R14_model_input_window", f"SELECT * FROM ({INPUT}) AS i", "discharge:r6")
def model_input_window(t):
    forecasts = t.daily_ml.where("model = 'TFT'").groupBy("code", "date", "forecast_date").agg(F.max("Q50").alias("Q50"))
    return features.model_input_window(t.holes, forecasts, AS_OF, 60, 20, 3)


MODELS = ("TFT", "TIDE", "TSMIXER")


@query(
    "R14_model_input_window_all_models",
    " UNION ALL ".join(f"SELECT *, '{m}' AS model FROM ({INPUT.replace(chr(39) + 'TFT' + chr(39), chr(39) + m + chr(39))}) AS i" for m in MODELS),
    "discharge:r6",
)
def model_input_window_all(t):
    """Each model's input, its nulls filled with that model's earlier forecasts."""
    def one(model):
        made = t.daily_ml.where(F.col("model") == model).groupBy("code", "date", "forecast_date").agg(F.max("Q50").alias("Q50"))
        return features.model_input_window(t.holes, made, AS_OF, 60, 20, 3).withColumn("model", F.lit(model))

    return reduce(DataFrame.unionByName, [one(m) for m in MODELS])


ISSUED = "DATE '1997-03-10'"
MADE = f"""(SELECT code, date, model, Q5, Q50, CASE WHEN Q50 < 48 THEN Q95 END AS Q95 FROM daily_ml WHERE forecast_date = {ISSUED}) AS m"""


@query(
    "R14_forecast_flags",
    " UNION ALL ".join(
        f"""SELECT code, date, model, Q5, Q50, Q95, CASE WHEN bool_or(Q95 IS NULL) OVER (PARTITION BY code) THEN 1 ELSE 0 END AS flag, {ISSUED} AS forecast_date FROM {MADE} WHERE model = '{m}'
        UNION ALL SELECT code, {ISSUED}, '{m}', NULL, NULL, NULL, 2, {ISSUED} FROM registry WHERE code NOT IN (SELECT code FROM {MADE} WHERE model = '{m}')"""
        for m in MODELS
    ),
    "flag:i",
)
def forecast_flags(t):
    values = ["Q5", "Q50", "Q95"]
    day = "1997-03-10"
    made = t.daily_ml.where(F.col("forecast_date") == F.lit(day).cast("date")).withColumn("Q95", F.when(F.col("Q50") < 48, F.col("Q95")))

    def one(model):
        rows = made.where(F.col("model") == model).select("code", "date", *values)
        return features.forecast_flags(t.registry, rows, values, day).withColumn("model", F.lit(model))

    rows = reduce(DataFrame.unionByName, [one(m) for m in MODELS])
    return rows.select("code", "date", "model", *values, "flag", "forecast_date")


@query(
    "R14_hindcast_flags",
    "SELECT code, model, forecast_date, date, Q5, Q50, CASE WHEN Q50 < 40 THEN Q95 END AS Q95, CASE WHEN Q50 < 40 THEN 4 ELSE 3 END AS flag FROM daily_ml",
    "flag:i",
)
def hindcast_flags(t):
    rows = t.daily_ml.withColumn("Q95", F.when(F.col("Q50") < 40, F.col("Q95")))
    keep = ["code", "model", "forecast_date", "date", "Q5", "Q50", "Q95"]
    return features.hindcast_flags(rows.select(*keep), ["Q5", "Q50", "Q95"])


def _readings_predictor(mean):
    total = "coalesce(total, 0) + coalesce(last, 0)"
    n = "(known + CASE WHEN last IS NULL THEN 0 ELSE 1 END)"
    value = f"({total}) / {n}" if mean else f"CASE WHEN held + 1 < 3 THEN ({total}) + ({total}) / {n} ELSE {total} END"
    return f"""SELECT code, CASE WHEN {n} > 0 THEN {value} END AS predictor FROM (
      SELECT d.code, CASE WHEN rows_in > 0 THEN rows_in ELSE 1 END AS held, CASE WHEN rows_in > 0 THEN sum_in ELSE newest END AS total,
        CASE WHEN rows_in > 0 THEN n_in ELSE CASE WHEN newest IS NULL THEN 0 ELSE 1 END END AS known, coalesce(m, newest) AS last
      FROM (SELECT code, count(*) FILTER (WHERE date >= DATE '2024-01-13') AS rows_in, count(v) FILTER (WHERE date >= DATE '2024-01-13') AS n_in,
          sum(v) FILTER (WHERE date >= DATE '2024-01-13') AS sum_in, arg_max(v, date) AS newest
        FROM (SELECT code, CAST(date + 8122 AS DATE) AS date, {sig('discharge')} AS v FROM raw) AS q WHERE date < DATE '2024-01-15' AND date >= DATE '2024-01-13' - 20 GROUP BY 1) AS d
      LEFT JOIN (SELECT code, {sig('q')} AS m FROM (SELECT code, arg_max(value, ts) AS q FROM readings WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1) AS r) AS e ON d.code = e.code) AS x"""


def _shifted(t):
    """The discharge record moved next to the given readings."""
    return t.raw.withColumn("date", F.date_add("date", 8122))


for _kind, _mean in (("sum", False), ("mean", True)):

    @query(f"R15_predictor_from_readings_{_kind}", _readings_predictor(_mean), "predictor:r6")
    def predictor_from_readings(t, mean=_mean):
        return regression.predictor_from_readings(_shifted(t), t.readings, "2024-01-15", mean=mean)


def _climatology_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """A user model: quantiles of the same calendar month, ten days ahead."""
    last = pd.Timestamp(pdf["date"].iloc[-1])
    days = pd.date_range(last + pd.Timedelta(days=1), periods=10)
    month = pd.to_datetime(pdf["date"]).dt.month
    rows = [pdf["discharge"][month == d.month].quantile([0.05, 0.5, 0.95]).tolist() for d in days]
    out = pd.DataFrame(rows, columns=["Q5", "Q50", "Q95"])
    return out.assign(code=pdf["code"].iloc[0], date=days.date)[["code", "date", "Q5", "Q50", "Q95"]]


@query(
    "R16_user_model_hook",
    """SELECT f.code, f.date, quantile_cont(discharge, 0.05) AS Q5, quantile_cont(discharge, 0.5) AS Q50, quantile_cont(discharge, 0.95) AS Q95
    FROM (SELECT code, CAST(unnest(generate_series(max(date) + 1, max(date) + 10, INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY code) AS f
      JOIN daily AS d ON d.code = f.code AND month(d.date) = month(f.date) GROUP BY 1, 2""",
    "Q5:r6 Q50:r6 Q95:r6",
)
def user_model_hook(t):
    return models.apply_model(t.daily, _climatology_model, "code string, date date, Q5 double, Q50 double, Q95 double")


X_SQL = """(SELECT d.code, d.date, discharge AS target, P AS P_1, P * P AS P_2, T AS T_1, T * T AS T_2 FROM daily AS d JOIN forcing AS f ON d.code = f.code AND d.date = f.date) AS x"""
SAME_DAY = f"(SELECT * FROM {X_SQL} WHERE month(date) = 6 AND day(date) = 15 AND date <= DATE '{AS_OF}') AS y"
PAST = f"(SELECT * FROM {SAME_DAY} WHERE date < DATE '{AS_OF}') AS z"
ONE_FIT = " UNION ALL ".join(
    f"""SELECT code, '{f}' AS feature, abs(corr({f}, target)) AS c, count(*) AS n, regr_slope(target, {f}) AS b, regr_intercept(target, {f}) AS a, regr_r2(target, {f}) AS r,
      (SELECT max(k.{f}) FROM {SAME_DAY.replace(' AS y', ' AS k')} WHERE k.code = z.code AND k.date = DATE '{AS_OF}') AS v FROM {PAST} GROUP BY code"""
    for f in FEATURES
)


@query(
    "R5_monthly_regression_one_feature",
    f"""SELECT code, arg_max(feature, c) AS features, arg_max(CASE WHEN n >= 2 AND v IS NOT NULL THEN greatest(a + b * v, 0) END, c) AS Q,
      arg_max(CASE WHEN n >= 2 AND v IS NOT NULL THEN r END, c) AS r2 FROM ({ONE_FIT}) AS o WHERE isfinite(c) AND v IS NOT NULL GROUP BY 1""",
    "Q:r2 r2:r6",
)
def monthly_regression_one(t):
    rows = models.monthly_regression(_targets(t), FEATURES, AS_OF, num_features=1)
    return rows.where(F.col("Q").isNotNull())


LOYO = f"""SELECT x.code, x.date, target, P_1 * s.b + s.a AS prediction FROM {X_SQL} JOIN (
    SELECT y.y AS y, regr_slope(target, P_1) AS b, regr_intercept(target, P_1) AS a FROM {X_SQL.replace(') AS x', ') AS t')} JOIN (SELECT DISTINCT year(date) AS y FROM daily) AS y ON year(t.date) <> y.y GROUP BY 1) AS s
  ON year(x.date) = s.y"""


@query("R10_leave_one_year_out_one_feature", LOYO, "target:r6 prediction:r5")
def leave_one_year_out_one(t):
    return models.leave_one_year_out(_targets(t), ["P_1"], "target", "linear")


#: Every year beside the rows of the others; two features in closed form, ``ridge`` added to both variances.
TRAIN = f"{X_SQL} JOIN (SELECT DISTINCT year(date) AS y FROM daily) AS folds ON year(x.date) <> y"


def _two_features(scaled, ridge):
    s1, s2, st = (f"coalesce(nullif(stddev_samp({c}), 0), 1)" if scaled else "1" for c in ("P_1", "T_1", "target"))
    return f"""SELECT x.code, x.date, target, mt + st * (b1 * (P_1 - m1) / s1 + b2 * (T_1 - m2) / s2) AS prediction FROM {X_SQL} JOIN (
      SELECT *, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS b1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS b2 FROM (
        SELECT y, m1, m2, mt, s1, s2, st, v1 / (s1 * s1) + {ridge} AS v1, v2 / (s2 * s2) + {ridge} AS v2, v12 / (s1 * s2) AS v12, c1 / (s1 * st) AS c1, c2 / (s2 * st) AS c2 FROM (
          SELECT y, avg(P_1) AS m1, avg(T_1) AS m2, avg(target) AS mt, {s1} AS s1, {s2} AS s2, {st} AS st, count(*) * var_pop(P_1) AS v1, count(*) * var_pop(T_1) AS v2,
            count(*) * covar_pop(P_1, T_1) AS v12, count(*) * covar_pop(P_1, target) AS c1, count(*) * covar_pop(T_1, target) AS c2 FROM {TRAIN} GROUP BY 1) AS sums) AS own) AS fits
      ON year(x.date) = y"""


@query("R10_folds_two_features", _two_features(False, 0), "target:r6 prediction:r5")
def folds_two_features(t):
    return models.leave_one_year_out(_targets(t), ["P_1", "T_1"], "target", "linear")


@query("R10_cascade_first_stage", _two_features(True, 1.0), "target:r6 prediction:r5")
def cascade_first_stage(t):
    """What the cascade's ridge model predicts, its residual model left out."""
    return models.leave_one_year_out(_targets(t), ["P_1", "T_1"], "target", "ridge", scale="global")


GAPPY = X_SQL.replace("T AS T_1", "CASE WHEN T >= -1 THEN T END AS T_1")


@query(
    "R10_folds_imputed_per_basin",
    f"""WITH x AS (SELECT * FROM {GAPPY}), folds AS (SELECT DISTINCT year(date) AS y FROM x), train AS (
      SELECT y, code, target, coalesce(T_1, avg(T_1) OVER (PARTITION BY y)) AS f FROM x JOIN folds ON year(date) <> y),
    scales AS (SELECT y, code, avg(f) AS mf, coalesce(nullif(stddev_samp(f), 0), 1) AS sf, avg(target) AS mt, coalesce(nullif(stddev_samp(target), 0), 1) AS st FROM train GROUP BY 1, 2),
    fits AS (SELECT t.y, sum((f - mf) / sf * (target - mt) / st) / (sum((f - mf) / sf * (f - mf) / sf) + 2.5) AS b FROM train AS t JOIN scales AS s ON t.y = s.y AND t.code = s.code GROUP BY 1),
    fills AS (SELECT y, avg(T_1) AS fill FROM x JOIN folds ON year(date) <> y GROUP BY 1)
    SELECT x.code, x.date, target, mt + st * b * (coalesce(T_1, fill) - mf) / sf AS prediction FROM x JOIN fits AS f ON year(x.date) = f.y JOIN fills AS i ON f.y = i.y JOIN scales AS s ON s.y = f.y AND s.code = x.code""",
    "target:r6 prediction:r5",
)
def folds_imputed_per_basin(t):
    rows = _targets(t).withColumn("T_1", F.when(F.col("T_1") >= -1, F.col("T_1")))
    return models.leave_one_year_out(rows, ["T_1"], "target", "ridge", alpha=2.5, impute=True, scale="basin")


@query(
    "R11_fit_on_all_linear",
    f"SELECT code, date, target, P_1 * (SELECT regr_slope(target, P_1) FROM {X_SQL}) + (SELECT regr_intercept(target, P_1) FROM {X_SQL}) AS prediction FROM {X_SQL.replace(') AS x', ') AS q')}",
    "target:r6 prediction:r5",
)
def fit_on_all_linear(t):
    rows = _targets(t)
    return models.fit_on_all(rows, ["P_1"], "target", "linear").transform(rows).select("code", "date", "target", "prediction")


def _first_component(a, b):
    """First principal axis of two columns in closed form."""
    lead = "(va + vb) / 2 + sqrt(((va - vb) / 2) * ((va - vb) / 2) + cab * cab)"
    return f"""SELECT cab / sqrt(cab * cab + (l - va) * (l - va)) AS wa, (l - va) / sqrt(cab * cab + (l - va) * (l - va)) AS wb FROM (
      SELECT *, {lead} AS l FROM (SELECT var_samp({a}) AS va, var_samp({b}) AS vb, covar_samp({a}, {b}) AS cab FROM {X_SQL}) AS c) AS e"""


@query(
    "R8_pca_first_components",
    f"SELECT code, date, abs(P_1 * p.wa + P_2 * p.wb) AS P_pc1, abs(T_1 * t.wa + T_2 * t.wb) AS T_pc1 FROM {X_SQL} CROSS JOIN ({_first_component('P_1', 'P_2')}) AS p CROSS JOIN ({_first_component('T_1', 'T_2')}) AS t",
    "P_pc1:r5 T_pc1:r5",
)
def pca_first_components(t):
    rows = features.pca_groups(_features(t), {"P": ["P_1", "P_2"], "T": ["T_1", "T_2"]})
    return rows.select("code", "date", F.abs("P_pc1").alias("P_pc1"), F.abs("T_pc1").alias("T_pc1"))


CHOSEN = f"""z AS (SELECT * FROM {SAME_DAY}), corrs AS ({' UNION ALL '.join(f"SELECT code, '{f}' AS feature, abs(corr({f}, target)) AS c FROM z WHERE date < DATE '{AS_OF}' GROUP BY 1" for f in FEATURES)}),
  best AS (SELECT code, split_part(feature, '_', 1) AS v, arg_max(feature, c) AS feature, max(c) AS c FROM corrs WHERE isfinite(c) GROUP BY 1, 2)"""


def _two_best(ridge):
    fit = "(v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS w1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS w2"
    return f"""WITH {CHOSEN}, wide AS (SELECT code, max(feature) FILTER (v = 'P') AS p, max(feature) FILTER (v = 'T') AS t, max(c) FILTER (v = 'P') AS cp, max(c) FILTER (v = 'T') AS ct FROM best GROUP BY 1),
    seen AS (SELECT z.code, date, target, p, t, cp, ct, CASE p WHEN 'P_1' THEN P_1 ELSE P_2 END AS a, CASE t WHEN 'T_1' THEN T_1 ELSE T_2 END AS b FROM z JOIN wide AS w ON z.code = w.code WHERE p IS NOT NULL AND t IS NOT NULL),
    sums AS (SELECT code, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(target) AS my, count(*) * var_pop(a) AS s1, count(*) * var_pop(b) AS s2, count(*) * covar_pop(a, b) AS v12,
      count(*) * covar_pop(a, target) AS c1, count(*) * covar_pop(b, target) AS c2, count(*) * var_pop(target) AS yy FROM seen WHERE date < DATE '{AS_OF}' GROUP BY 1),
    fits AS (SELECT *, {fit} FROM (SELECT *, s1 + {ridge} AS v1, s2 + {ridge} AS v2 FROM sums) AS r WHERE n >= 4)
    SELECT f.code, CASE WHEN cp > ct THEN p || ', ' || t ELSE t || ', ' || p END AS features, greatest(my + w1 * (a - ma) + w2 * (b - mb), 0) AS Q,
      1 - (yy - 2 * (w1 * c1 + w2 * c2) + w1 * w1 * s1 + 2 * w1 * w2 * v12 + w2 * w2 * s2) / yy AS r2
    FROM fits AS f JOIN seen AS s ON f.code = s.code AND s.date = DATE '{AS_OF}'"""


for _kind, _ridge in (("linear", 0), ("ridge", 0.5)):

    @query(f"R5_two_features_{_kind}", _two_best(_ridge), "Q:r2 r2:r5")
    def monthly_regression_two(t, kind=_kind):
        rows = models.monthly_regression(_targets(t), FEATURES, AS_OF, 2, kind, alpha=0.5)
        return rows.where(F.col("Q").isNotNull() & F.col("features").contains(","))


def _one_best(weight):
    value = " ".join(f"WHEN '{f}' THEN {f}" for f in FEATURES)
    return f"""WITH {CHOSEN}, one AS (SELECT code, arg_max(feature, c) AS features FROM best GROUP BY 1),
    seen AS (SELECT z.code, date, target, features, CASE features {value} END AS a FROM z JOIN one AS w ON z.code = w.code),
    sums AS (SELECT code, count(*) AS n, avg(a) AS ma, avg(target) AS my, count(*) * var_pop(a) AS v, count(*) * covar_pop(a, target) AS c, count(*) * var_pop(target) AS yy FROM seen WHERE date < DATE '{AS_OF}' GROUP BY 1)
    SELECT f.code, features, greatest(my + w * (a - ma), 0) AS Q, 1 - (yy - 2 * w * c + w * w * v) / yy AS r2
    FROM (SELECT *, {weight} AS w FROM sums WHERE n >= 2) AS f JOIN seen AS s ON f.code = s.code AND s.date = DATE '{AS_OF}'"""


for _kind, _weight in (("ridge", "c / (v + 0.5)"), ("lasso", "sign(c) * greatest(abs(c) - 0.5 * n, 0) / v")):

    @query(f"R5_one_feature_{_kind}", _one_best(_weight), "Q:r2 r2:r5")
    def monthly_regression_penalty(t, kind=_kind):
        rows = models.monthly_regression(_targets(t), FEATURES, AS_OF, 1, kind, alpha=0.5)
        return rows.where(F.col("Q").isNotNull())


SPLIT_YEAR = 1997


def _held_out_component(a, b):
    """Mean and first axis of two columns of the earlier years, its largest loading positive."""
    lead = "(va + vb) / 2 + sqrt(((va - vb) / 2) * ((va - vb) / 2) + cab * cab)"
    return f"""SELECT ma, mb, s * wa AS wa, s * wb AS wb FROM (SELECT *, CASE WHEN abs(wa) >= abs(wb) THEN sign(wa) ELSE sign(wb) END AS s FROM (
      SELECT ma, mb, cab / sqrt(cab * cab + (l - va) * (l - va)) AS wa, (l - va) / sqrt(cab * cab + (l - va) * (l - va)) AS wb FROM (
        SELECT *, {lead} AS l FROM (SELECT avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) AS va, var_samp({b}) AS vb, covar_samp({a}, {b}) AS cab FROM {X_SQL} WHERE year(date) < {SPLIT_YEAR}) AS c) AS e) AS u) AS w"""


@query(
    "R8_fit_and_apply",
    f"""SELECT code, date, (P_1 - p.ma) * p.wa + (P_2 - p.mb) * p.wb AS P_PC1, (T_1 - t.ma) * t.wa + (T_2 - t.mb) * t.wb AS T_PC1
    FROM {X_SQL} CROSS JOIN ({_held_out_component('P_1', 'P_2')}) AS p CROSS JOIN ({_held_out_component('T_1', 'T_2')}) AS t WHERE year(date) >= {SPLIT_YEAR}""",
    "P_PC1:r5 T_PC1:r5",
)
def fit_and_apply(t):
    """Components of the earlier years, stored, read back and applied to years they have not seen."""
    rows = _features(t)
    path = t.scratch("components")
    pca.GroupPCA({"P": ["P_1", "P_2"], "T": ["T_1", "T_2"]}).fit(rows.where(F.year("date") < SPLIT_YEAR)).save(t.spark, path)
    later = pca.GroupPCAModel.load(t.spark, path).transform(rows.where(F.year("date") >= SPLIT_YEAR))
    return later.select("code", "date", "P_PC1", "T_PC1")


def _binned(f):
    edges = f"(SELECT quantile_cont({f}, [{', '.join(str(i / 16) for i in range(1, 16))}]) FROM x)"
    return f"list_sum(list_transform({edges}, lambda e: CASE WHEN {f} > e THEN 1 ELSE 0 END))"


#: Features that correlate above 0.95 with an earlier one go.
KEPT_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature" + (" WHERE " + " AND ".join(f"(SELECT abs(corr({e}, {f})) FROM x) <= 0.95" for e in FEATURES[:i]) if i else "")
    for i, f in enumerate(FEATURES)
)
INFORMATION = f"""x AS (SELECT * FROM {X_SQL}), cells AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {_binned(f)} AS a, {_binned('target')} AS b FROM x" for f in FEATURES)}),
  counts AS (SELECT feature, a, b, count(*) AS c FROM cells WHERE feature IN ({KEPT_SQL}) GROUP BY 1, 2, 3),
  totals AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, a) AS ca, sum(c) OVER (PARTITION BY feature, b) AS cb FROM counts),
  told AS (SELECT feature, CAST(max(n) AS BIGINT) AS n, greatest(sum(c / n * ln(c * n / (ca * cb))) - (count(*) - count(DISTINCT a) - count(DISTINCT b) + 1) / (2 * max(n)), 0) AS mi FROM totals GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS rank FROM told)"""


@query("R9_mutual_information", f"WITH {INFORMATION} SELECT feature, n, mi, rank FROM ranked", "n:l mi:r6 rank:i")
def mutual_information(t):
    return selection.ranked_features(_targets(t), FEATURES, "target")


@query(
    "R9_select_by_information",
    f"""WITH {INFORMATION} SELECT code, date, target, feature, CASE feature {' '.join(f"WHEN '{f}' THEN {f}" for f in FEATURES)} END AS value FROM x JOIN ranked ON rank <= 2""",
    "value:r6",
)
def select_by_information(t):
    rows = _targets(t)
    best = selection.select_informative(rows, FEATURES, "target", 2)
    return rows.select("code", "date", "target", *best).unpivot(["code", "date", "target"], best, "feature", "value")
