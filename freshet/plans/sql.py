"""SQL text of the domain views and of the calendar, for side-by-side checks."""

from __future__ import annotations

import re

DAYS = {"pentad": 5, "decad": 10}
PER_MONTH = {"pentad": 6, "decad": 3}


def pim(d: str, h: str = "pentad") -> str:
    return f"CAST(least((day({d}) - 1) // {DAYS[h]} + 1, {PER_MONTH[h]}) AS INTEGER)"


def piy(d: str, h: str = "pentad") -> str:
    return f"CAST((month({d}) - 1) * {PER_MONTH[h]} + {pim(d, h)} AS INTEGER)"


def issue(d: str, h: str = "pentad") -> str:
    days = "5, 10, 15, 20, 25" if h == "pentad" else "10, 20"
    return f"(day({d}) IN ({days}) OR {d} = last_day({d}))"


def next_issue(d: str, h: str = "pentad") -> str:
    """End of the period that holds ``d``."""
    last = f"CASE WHEN {pim(d, h)} = {PER_MONTH[h]} THEN day(last_day({d})) ELSE {pim(d, h)} * {DAYS[h]} END"
    return f"CAST(date_trunc('month', {d}) AS DATE) + CAST({last} - 1 AS INTEGER)"


def finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def sig(x: str) -> str:
    """Three valid digits, half-even."""
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0.0001 THEN 0.0 WHEN {x} < 0.001 THEN round_even({x}, 6) "
        f"WHEN {x} < 0.01 THEN round_even({x}, 5) WHEN {x} < 0.1 THEN round_even({x}, 4) "
        f"WHEN {x} < 1 THEN round_even({x}, 3) WHEN {x} < 10 THEN round_even({x}, 2) "
        f"WHEN {x} < 100 THEN round_even({x}, 1) ELSE round_even({x}, 0) END"
    )


def interpolated(source: str, value: str, limit: int | None, both: bool, by_time: bool, keys: str = "code", keep: str = "") -> str:
    """Linear fill of null runs with a limit, as one SELECT over ``source``."""
    x = "dn" if by_time else "rn"
    reach = "TRUE"
    if limit is not None:
        reach = f"coalesce(rn - prn <= {limit}, FALSE)"
        if both:
            reach = f"({reach} OR coalesce(nrn - rn <= {limit}, FALSE))"
    ends = "coalesce(pv, nv)" if both else "pv"
    keep = f"{keep}, " if keep else ""
    return f"""SELECT {keys}, date, {keep}CASE WHEN {value} IS NOT NULL THEN {value} WHEN {reach} THEN
        CASE WHEN prn IS NOT NULL AND nrn IS NOT NULL THEN pv + (nv - pv) / (nx - px) * ({x} - px) ELSE {ends} END
      END AS {value}
    FROM (SELECT *, last_value(CASE WHEN {value} IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS prn,
        last_value(CASE WHEN {value} IS NOT NULL THEN {x} END IGNORE NULLS) OVER a AS px,
        last_value({value} IGNORE NULLS) OVER a AS pv,
        first_value(CASE WHEN {value} IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS nrn,
        first_value(CASE WHEN {value} IS NOT NULL THEN {x} END IGNORE NULLS) OVER b AS nx,
        first_value({value} IGNORE NULLS) OVER b AS nv
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS rn, date - DATE '1970-01-01' AS dn FROM {source}) AS numbered
      WINDOW a AS (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             b AS (PARTITION BY {keys} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS edges"""


def _next_avg(h: str) -> str:
    lengths = {"pentad": {28: 3, 29: 4, 31: 6}, "decad": {28: 8, 29: 9, 31: 11}}[h]
    day = {"pentad": 25, "decad": 20}[h]

    def mean(k: int) -> str:
        return f"avg(nxt) OVER (PARTITION BY code ORDER BY dn RANGE BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"

    cases = " ".join(
        f"WHEN day(date) = {day} AND day(last_day(date)) = {m} THEN {mean(k)}" for m, k in lengths.items()
    )
    return f"CASE WHEN NOT issue_date THEN NULL {cases} ELSE {mean(DAYS[h])} END"


def _series(h: str) -> str:
    if h == "pentad":
        predictor = "CASE WHEN issue_date THEN sum(discharge) OVER (PARTITION BY code ORDER BY dn RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) END"
        tail = f"SELECT code, date, discharge, issue_date, {predictor} AS predictor, {_next_avg(h)} AS discharge_avg FROM led"
    else:
        tail = f"""SELECT code, date, discharge, issue_date,
            CASE WHEN issue_date THEN lag(discharge_avg) OVER (PARTITION BY code, issue_date ORDER BY date) END AS predictor, discharge_avg
          FROM (SELECT *, {_next_avg(h)} AS discharge_avg FROM led) AS averaged"""
    return f"""WITH clean AS (SELECT code, date, CASE WHEN discharge >= 0 THEN discharge END AS discharge FROM raw),
      filled AS ({interpolated('clean', 'discharge', 3, True, False)}),
      rounded AS (SELECT code, date, {sig('discharge')} AS discharge FROM filled),
      led AS (SELECT *, {issue('date', h)} AS issue_date, date - DATE '1970-01-01' AS dn,
        lead(discharge) OVER (PARTITION BY code ORDER BY date) AS nxt FROM rounded),
      done AS ({tail})
      SELECT *, {piy('date', h)} AS issue_period, {piy('CAST(date + 1 AS DATE)', h)} AS target_period FROM done"""


def fit(y: str, x: str, over: str = "", n: str = "n") -> dict[str, str]:
    """Guarded least-squares line."""
    gate = f"regr_count({y}, {x}){over} > 2"
    return {
        "slope": f"CASE WHEN {gate} THEN {finite(f'regr_slope({y}, {x}){over}')} END",
        "intercept": f"CASE WHEN {gate} THEN {finite(f'regr_intercept({y}, {x}){over}')} END",
        "rsquared": f"CASE WHEN {gate} THEN {finite(f'regr_r2({y}, {x}){over}')} END",
        "q_mean": f"CASE WHEN {gate} THEN avg({y}){over} END",
        "q_std_sigma": f"CASE WHEN {gate} THEN stddev_pop({y}){over} END",
        "delta": f"CASE WHEN {gate} THEN 0.674 * stddev_pop({y}){over} END",
    }


def columns(items: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in items.items())


MODEL_SHORT = "CASE {m} WHEN 'LR' THEN 'LR' WHEN 'TFT' THEN 'TFT' WHEN 'TIDE' THEN 'TiDE' WHEN 'TSMIXER' THEN 'TSMixer' WHEN 'ARIMA' THEN 'ARIMA' WHEN 'RRAM' THEN 'RRAM' END"
MODEL_LONG = (
    "CASE {m} WHEN 'LR' THEN 'Linear regression (LR)' WHEN 'TFT' THEN 'Temporal-Fusion Transformer (TFT)' "
    "WHEN 'TIDE' THEN 'Time-Series Dense Encoder (TiDE)' WHEN 'TSMIXER' THEN 'Time-Series Mixer (TSMixer)' "
    "WHEN 'ARIMA' THEN 'AutoRegressive Integrated Moving Average (ARIMA)' "
    "WHEN 'RRAM' THEN 'Rainfall runoff assimilation model (RRAM)' END"
)

GAUGE = "CAST(10000 + l_suppkey // 10 AS VARCHAR)"
SHIP = "CAST(l_shipdate AS DATE)"

VIEWS = {
    "daily": f"SELECT {GAUGE} AS code, {SHIP} AS date, sum(l_quantity) AS discharge FROM lineitem GROUP BY 1, 2",
    "raw": "SELECT code, date, discharge - 12 AS discharge FROM daily",
    "holes": "SELECT code, date, CASE WHEN discharge >= 25 THEN discharge END AS discharge FROM daily",
    "readings": "SELECT CAST(10000 + user_id // 15 AS VARCHAR) AS code, ts, value FROM events",
    "registry": """SELECT CAST(10000 + s_suppkey // 10 AS VARCHAR) AS code,
        arg_min(n_name, s_suppkey) || ' - ' || arg_min(s_name, s_suppkey) AS name,
        arg_min(n_name, s_suppkey) AS river, arg_min(s_name, s_suppkey) AS place,
        arg_min(r_name, s_suppkey) AS basin, CAST(min(s_nationkey) AS DOUBLE) * 0.25 + 36 AS lat, CAST(max(s_nationkey) AS DOUBLE) * 0.5 + 66 AS lon,
        CAST(max(s_suppkey) AS INTEGER) AS bulletin_order, min(s_acctbal) + 20000 AS area,
        bool_or(s_acctbal > 8000) AS flag
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "forcing": f"""SELECT {GAUGE} AS code, {SHIP} AS date,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1000000 AS P,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) - 5 AS T FROM lineitem GROUP BY 1, 2""",
    "snow": f"""SELECT {GAUGE} AS code, {SHIP} AS date,
        CASE l_returnflag WHEN 'A' THEN 'SWE' WHEN 'N' THEN 'HS' ELSE 'ROF' END AS var,
        l_linenumber AS band, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4""",
    "bands": f"""SELECT {GAUGE} AS code, l_linenumber AS band, CAST(count(*) AS DOUBLE) AS area FROM lineitem GROUP BY 1, 2""",
    "daily_ml": f"""SELECT {GAUGE} AS code,
        CASE l_returnflag WHEN 'A' THEN 'TFT' WHEN 'N' THEN 'TIDE' ELSE 'TSMIXER' END AS model,
        {SHIP} AS forecast_date, CAST({SHIP} + l_linenumber AS DATE) AS date,
        sum(l_quantity) * 0.5 AS Q5, sum(l_quantity) * 0.75 AS Q25, sum(l_quantity) AS Q50,
        sum(l_quantity) * 1.25 AS Q75, sum(l_quantity) * 1.5 AS Q95,
        CASE WHEN min(l_linestatus) = 'F' THEN 1 ELSE 0 END AS flag
      FROM lineitem GROUP BY 1, 2, 3, 4""",
    "forecasts": f"""SELECT code, date, pentad_in_month, pentad_in_year, {MODEL_SHORT.format(m='model')} AS model_short,
        {MODEL_LONG.format(m='model')} AS model_long, forecasted_discharge FROM (
        SELECT code, date, {pim('CAST(date + 1 AS DATE)')} AS pentad_in_month, {piy('CAST(date + 1 AS DATE)')} AS pentad_in_year, model,
          CAST(sum(cents) AS DOUBLE) / count(*) / 598937 AS forecasted_discharge
        FROM (SELECT CAST(10000 + o_custkey // 150 AS VARCHAR) AS code, {next_issue('CAST(o_orderdate AS DATE)')} AS date,
            CASE left(o_orderpriority, 1) WHEN '1' THEN 'LR' WHEN '2' THEN 'TFT' WHEN '3' THEN 'TIDE' WHEN '4' THEN 'TSMIXER' ELSE 'ARIMA' END AS model,
            CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) AS issued
        GROUP BY ALL) AS labelled""",
    "meteo": f"""SELECT {GAUGE} AS code, CASE l_returnflag WHEN 'A' THEN 'Precipitation' WHEN 'N' THEN 'Temperature' ELSE 'Snow depth' END AS variable,
        {SHIP} AS date, CASE l_returnflag WHEN 'A' THEN 'mm' WHEN 'N' THEN 'C' ELSE 'cm' END AS unit,
        sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4""",
    "series_pentad": _series("pentad"),
    "series_decad": _series("decad"),
    "observed": f"""SELECT code, date, discharge_avg, 12.5 AS delta FROM series_pentad WHERE issue_date AND discharge_avg IS NOT NULL""",
    "fits": "SELECT code, issue_period, "
    + columns(fit("discharge_avg", "predictor"))
    + " FROM series_pentad WHERE discharge IS NOT NULL AND predictor IS NOT NULL AND discharge_avg IS NOT NULL GROUP BY 1, 2",
    "linreg": """SELECT s.code, s.date, s.discharge, s.issue_date, s.predictor, s.discharge_avg, s.issue_period, s.target_period,
        f.slope, f.intercept, f.rsquared, f.q_mean, f.q_std_sigma, f.delta, f.slope * s.predictor + f.intercept AS forecasted_discharge
      FROM series_pentad AS s JOIN fits AS f ON s.code = f.code AND s.issue_period = f.issue_period WHERE s.issue_date""",
    "gaps": """SELECT code, CAST(date + 1 AS DATE) AS gap_start, CAST(nxt - 1 AS DATE) AS gap_end FROM (
        SELECT code, date, lead(date) OVER (PARTITION BY code ORDER BY date) AS nxt FROM daily) AS d WHERE nxt > date + 1""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, view in VIEWS.items():
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in needed:
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed) + "\n" + body
