"""D and M rows: calendar, text, rounding and forcing arithmetic on every given row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import physics, rounding, text
from ..operators import features, forcing
from .registry import query
from .sql import DAYS, PER_MONTH, issue, next_issue, pim, piy

D = "CAST(o_orderdate AS DATE)"
ORDERS = f"(SELECT o_orderkey AS k, {D} AS d, o_totalprice, o_custkey FROM orders) AS o"


def _orders(t):
    return t.orders.select(
        F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_custkey"
    )


def _dated(t, **columns):
    return _orders(t).select("k", "d", *[c.alias(n) for n, c in columns.items()])


def _dated_sql(**columns):
    return f"SELECT k, d, {', '.join(f'{c} AS {n}' for n, c in columns.items())} FROM {ORDERS}"


def _calendar(suffix: str, h: str) -> None:
    n, start = piy("d", h), f"(({pim('d', h)} - 1) * {DAYS[h]} + 1)"
    first = f"CAST(date_trunc('month', d) AS DATE) + CAST({start} - 1 AS INTEGER)"
    end = next_issue("d", h)

    @query(f"D{suffix}_{h}_numbers", _dated_sql(in_month=pim("d", h), in_year=n))
    def numbers(t):
        return _dated(t, in_month=cal.period_in_month("d", h), in_year=cal.period_in_year("d", h))

    @query(f"D2c_{h}_in_month_of_year_number", _dated_sql(p=f"({n} - 1) % {PER_MONTH[h]} + 1"), "p:i")
    def in_month(t):
        return _dated(t, p=cal.period_in_month_of(cal.period_in_year("d", h), h))

    @query(f"D4_date_for_{h}", _dated_sql(start=first))
    def start_date(t):
        return _dated(t, start=cal.period_start(cal.period_in_year("d", h), F.year("d"), h))

    @query(f"D5_last_date_of_{h}", _dated_sql(last=end))
    def end_date(t):
        return _dated(t, last=cal.period_end(cal.period_in_year("d", h), F.year("d"), h))

    @query(f"D6_{h}_first_and_last_day", _dated_sql(a=start, b=f"day({end})"), "a:i b:i")
    def days(t):
        return _dated(t, a=cal.period_first_day("d", h), b=cal.period_last_day("d", h))

    @query(f"D7_{h}_start_day_of_year", _dated_sql(doy=f"dayofyear({first})"), "doy:i")
    def start_doy(t):
        return _dated(t, doy=cal.period_start_day_of_year(cal.period_in_year("d", h), F.year("d"), h))

    @query(
        f"D8_{h}_issue_date",
        _dated_sql(issued=f"CAST({first} - 1 AS DATE)", doy=f"dayofyear({first} - 1)"),
        "doy:i",
    )
    def issue_date(t):
        number = cal.period_in_year("d", h)
        return _dated(
            t,
            issued=cal.issue_date_of_period(number, F.year("d"), h),
            doy=cal.issue_day_of_year(number, F.year("d"), h),
        )

    inner = "[5, 10, 15, 20, 25" if h == "pentad" else "[10, 20"

    @query(f"D19_next_{h}_issue", _dated_sql(nxt=end, days=f"array_to_string({inner}, CAST(day(last_day(d)) AS INTEGER)], ',')"))
    def next_issue_date(t):
        return _dated(t, nxt=cal.next_issue_date("d", h), days=F.array_join(cal.issue_days("d", h).cast("array<string>"), ","))

    back = "2" if h == "pentad" else "CASE WHEN day(d) > 20 THEN day(d) % 20 - 1 ELSE 9 END"
    last_start = (PER_MONTH[h] - 1) * DAYS[h] + 1

    @query(
        f"D24_{h}_forecast_window",
        _dated_sql(
            predictor_start=f"CAST(d - CAST({back} AS INTEGER) AS DATE)",
            predictor_end="d",
            forecast_start="CAST(d + 1 AS DATE)",
            forecast_end=f"CAST(CASE WHEN day(d + 1) = {last_start} THEN last_day(d + 1) ELSE d + {DAYS[h]} END AS DATE)",
        ),
    )
    def window(t):
        return _dated(t, **cal.forecast_window("d", h))


for _s, _h in (("1", "pentad"), ("2", "decad")):
    _calendar(_s, _h)


@query("D2b_decad_for_date", _dated_sql(p=pim("d"), q=pim("d", "decad")))
def capped_periods(t):
    return _dated(t, p=cal.period_in_month("d", "pentad"), q=cal.period_in_month("d", "decad"))


@query("D2d_year_text", _dated_sql(y="CAST(year(d) AS VARCHAR)"))
def year_text(t):
    return _dated(t, y=cal.year_text("d"))


@query(
    "D3_predictor_decad",
    _dated_sql(p=f"CASE {pim('d', 'decad')} WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END"),
    "p:i",
)
def predictor_decad(t):
    return _dated(t, p=cal.predictor_decad(cal.period_in_month("d", "decad")))


LEAP = "(year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0))"


@query(
    "D9_leap_alignment",
    "SELECT k, d, day_of_year, shown_date FROM (SELECT k, d, "
    "dayofyear(CASE WHEN month(d) = 2 AND day(d) = 29 THEN d - 1 ELSE d END) - CASE WHEN year(d) = 2000 AND month(d) > 2 THEN 1 ELSE 0 END AS day_of_year, "
    "CASE WHEN year(d) = 2000 THEN CAST(d + INTERVAL 1 YEAR AS DATE) ELSE d END AS shown_date "
    f"FROM {ORDERS}) AS x",
    "day_of_year:i",
)
def leap_alignment(t):
    from ..operators.hydrograph import align_years

    return align_years(_orders(t).withColumnRenamed("d", "date"), 2001).select(
        "k", F.col("date").alias("d"), "day_of_year", "shown_date"
    )


@query("D10_normalized_day", _dated_sql(n=f"dayofyear(d) - CASE WHEN {LEAP} AND dayofyear(d) >= 60 THEN 1 ELSE 0 END"), "n:i")
def normalized_day(t):
    return _dated(t, n=cal.normalized_day("d"))


PRICE = "(o_totalprice / 1000000)"


@query(
    "D11_round_significant",
    f"""SELECT k, CASE WHEN x <= 0.0001 THEN 0.0 WHEN x < 0.001 THEN round_even(x, 6) WHEN x < 0.01 THEN round_even(x, 5)
      WHEN x < 0.1 THEN round_even(x, 4) WHEN x < 1 THEN round_even(x, 3) WHEN x < 10 THEN round_even(x, 2)
      WHEN x < 100 THEN round_even(x, 1) ELSE round_even(x, 0) END AS q FROM (SELECT k, o_totalprice / 7000 - 3 AS x FROM {ORDERS}) AS s""",
    "q:r6",
)
def round_significant(t):
    return _orders(t).select("k", rounding.round_significant(F.col("o_totalprice") / 7000 - 3).alias("q"))


@query(
    "D12_bulletin_rounding",
    """SELECT k,
      CASE WHEN x < 0 THEN ' ' WHEN x = 0 THEN '0' WHEN x < 10 THEN CAST(CAST(x AS DECIMAL(18,2)) AS VARCHAR)
        WHEN x < 100 THEN CAST(CAST(x AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST(CAST(x AS DECIMAL(18,0)) AS VARCHAR) END AS plain,
      CASE WHEN x <= 0.0001 THEN '0.0' WHEN x < 10 THEN CAST(CAST(x AS DECIMAL(18,2)) AS VARCHAR)
        WHEN x < 100 THEN CAST(CAST(x AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST(CAST(x AS DECIMAL(18,0)) AS VARCHAR) END AS bulletin
    FROM (SELECT o_orderkey AS k, round(o_totalprice / 700, 4) + 0.00003 - 50 AS x FROM orders) AS s""",
)
def bulletin_rounding(t):
    x = F.round(F.col("o_totalprice") / 700, 4) + 0.00003 - 50
    return t.orders.select(
        F.col("o_orderkey").alias("k"),
        rounding.discharge_text(x).alias("plain"),
        rounding.bulletin_text(x).alias("bulletin"),
    )


@query(
    "D12_bulletin_three_digits",
    """SELECT k, CASE WHEN x <= 0.0001 THEN '0.0' WHEN x < 0.001 THEN CAST(CAST(x AS DECIMAL(18,6)) AS VARCHAR)
      WHEN x < 0.01 THEN CAST(CAST(x AS DECIMAL(18,5)) AS VARCHAR) WHEN x < 0.1 THEN CAST(CAST(x AS DECIMAL(18,4)) AS VARCHAR)
      WHEN x < 1 THEN CAST(CAST(x AS DECIMAL(18,3)) AS VARCHAR) WHEN x < 10 THEN CAST(CAST(x AS DECIMAL(18,2)) AS VARCHAR)
      WHEN x < 100 THEN CAST(CAST(x AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST(CAST(x AS DECIMAL(18,0)) AS VARCHAR) END AS q
    FROM (SELECT o_orderkey AS k, round(o_totalprice / 1000, 4) / 100 + 0.0000000003 AS x FROM orders) AS s""",
)
def bulletin_three_digits(t):
    x = F.round(F.col("o_totalprice") / 1000, 4) / 100 + 0.0000000003
    return t.orders.select(F.col("o_orderkey").alias("k"), rounding.bulletin_text_three_digits(x).alias("q"))


MIXED = {0: "dd.MM.yyyy", 1: "yyyy-MM-dd", 2: "yyyy-MM-dd HH:mm:ss"}


def _text_dates(t):
    """Dates printed in three layouts, chosen by the key."""
    pick = F.col("o_orderkey") % 3
    printed = F.when(pick == 0, F.date_format("o_orderdate", MIXED[0]))
    printed = printed.when(pick == 1, F.date_format("o_orderdate", MIXED[1]))
    return t.orders.select(
        F.col("o_orderkey").alias("k"), printed.otherwise(F.date_format("o_orderdate", MIXED[2])).alias("d")
    )


@query("S23_read_csv_mixed_dates", f"SELECT o_orderkey AS k, {D} AS d FROM orders")
def read_csv_mixed_dates(t):
    from ..sources.readers import read_csv_mixed_dates as read

    return read(_text_dates(t), ["d"])


@query("D13_parse_dates_robust", f"SELECT o_orderkey AS k, {D} AS d FROM orders")
def parse_dates_robust(t):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return text.parse_dates_robust(rows, "d")


@query("D14_normalize_code", "SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS code FROM orders")
def normalize_code(t):
    code = F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(""))
    return t.orders.select(F.col("o_orderkey").alias("k"), text.normalize_code(code).alias("code"))


@query(
    "D15_valid_gregorian_date",
    """SELECT o_orderkey AS k, TRY_CAST(CAST(year(o_orderdate) AS VARCHAR) || '-02-' || CAST(27 + o_orderkey % 4 AS VARCHAR) AS DATE) IS NOT NULL AS ok FROM orders""",
)
def valid_date(t):
    made = F.concat_ws("-", F.year("o_orderdate").cast("string"), F.lit("02"), (27 + F.col("o_orderkey") % 4).cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("k"), text.is_gregorian(made).alias("ok"))


def _names(style, d="d"):
    return "CASE month(%s) %s END" % (d, " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(text.MONTHS[style], 1)))


@query(
    "D16_month_names",
    _dated_sql(
        **{s: _names(s) for s in text.MONTHS},
        predictor=_names("roman", "(d - INTERVAL 1 MONTH)"),
        number="CAST(month(d) AS INTEGER)",
    ),
)
def month_names(t):
    return _dated(
        t,
        **{s: text.month_name("d", s) for s in text.MONTHS},
        predictor=text.predictor_month("d"),
        number=F.month("d"),
    )


@query("D17_last_day_of_month", _dated_sql(last="last_day(d)"))
def month_end(t):
    return _dated(t, last=cal.month_end("d"))


@query(
    "D18_predictor_window",
    _dated_sql(
        a="CAST(d AS TIMESTAMP) + INTERVAL 12 HOURS - INTERVAL 60 HOURS", b="CAST(d AS TIMESTAMP) + INTERVAL 12 HOURS"
    ),
)
def predictor_window(t):
    w = cal.predictor_window("d", 2)
    return _dated(t, a=w["start"].cast("timestamp_ntz"), b=w["end"].cast("timestamp_ntz"))


PREVIOUS_END = "(CAST(date_trunc('month', d) AS DATE) - 1)"


@query(
    "D20_rerun_date",
    _dated_sql(
        rerun=f"""CASE WHEN day(d) < 10 THEN CAST({PREVIOUS_END} - 1 AS DATE)
          ELSE CAST(date_trunc('month', d) AS DATE) + CAST(CASE WHEN day({PREVIOUS_END}) - 1 < day(d) THEN day({PREVIOUS_END}) - 1
            WHEN 19 < day(d) THEN 19 ELSE 9 END - 1 AS INTEGER) END"""
    ),
)
def rerun_date(t):
    return _dated(t, rerun=cal.rerun_date("d"))


@query(
    "D21_split_name",
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS river,
      CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN '' ELSE p_brand END AS place
    FROM (SELECT p_partkey, replace(p_name, '-', ' ') AS p_name, replace(p_brand, '-', ' ') AS p_brand, replace(p_type, '-', ' ') AS p_type FROM part) AS p""",
)
def split_name(t):
    name, brand, kind = (F.regexp_replace(c, "-", " ") for c in ("p_name", "p_brand", "p_type"))
    slot = F.col("p_partkey") % 4
    full = F.when(slot == 0, F.concat(name, F.lit(" - "), kind)).when(slot == 1, F.concat(brand, F.lit(" -"), name))
    full = full.when(slot == 2, kind).otherwise(F.concat(kind, F.lit("-"), brand))
    parts = text.split_name(full)
    return t.part.select(F.col("p_partkey").alias("k"), parts["river"].alias("river"), parts["place"].alias("place"))


@query("D22_bracketed_name", "SELECT code, date, model_short, model_short AS short FROM forecasts")
def bracketed_name(t):
    return t.forecasts.select("code", "date", "model_short", text.bracketed("model_long").alias("short"))


@query("D23_name_accessors", "SELECT code, basin, place AS site_name, river AS river_name FROM registry")
def name_accessors(t):
    parts = text.split_name("name")
    return t.registry.select("code", "basin", parts["place"].alias("site_name"), parts["river"].alias("river_name"))


@query(
    "D25_request_windows",
    """SELECT event_id AS k, CAST(CAST(ts AS DATE) - 50 AS TIMESTAMP) + INTERVAL 20 HOURS AS a, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 20 HOURS AS b,
      CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 8 HOURS AS c, date_trunc('minute', ts) AS d FROM events""",
)
def request_windows(t):
    day, morning = cal.daily_request_window(F.to_date("ts"), 50), cal.morning_request_window("ts")
    return t.events.select(
        F.col("event_id").alias("k"),
        *[
            c.cast("timestamp_ntz").alias(n)
            for n, c in (("a", day["start"]), ("b", day["end"]), ("c", morning["start"]), ("d", morning["end"]))
        ],
    )


@query(
    "D26_bulletin_header",
    _dated_sql(
        period=pim("d"),
        month_roman=_names("roman"),
        month_name=_names("ru_genitive"),
        year="CAST(year(d) AS VARCHAR)",
        first_day=f"({pim('d')} - 1) * 5 + 1",
        last_day=f"day({next_issue('d')})",
    ),
    "first_day:i last_day:i",
)
def bulletin_header(t):
    return _dated(t, **text.bulletin_header("d", "pentad"))


@query(
    "D27_translate_labels",
    "SELECT code, date, model_short, CASE model_short WHEN 'LR' THEN 'Линейная регрессия (LR)' ELSE model_long END AS label FROM forecasts",
)
def translate_labels(t):
    catalogue = {"Linear regression (LR)": "Линейная регрессия (LR)"}
    return t.forecasts.select("code", "date", "model_short", text.translate("model_long", catalogue).alias("label"))


@query(
    "M1_linear_prediction",
    """SELECT s.code, s.date, slope * predictor + intercept AS q, CASE WHEN slope * predictor + intercept < 0 THEN 0.0 ELSE slope * predictor + intercept END AS site_q
    FROM series_pentad AS s LEFT JOIN fits AS f ON s.code = f.code AND s.issue_period = f.issue_period WHERE issue_date""",
    "q:r5 site_q:r5",
)
def linear_prediction(t):
    rows = t.series("pentad").where("issue_date").join(t.fits, ["code", "issue_period"], "left")
    return rows.select(
        "code",
        "date",
        physics.linear_prediction("slope", "predictor", "intercept").alias("q"),
        physics.linear_prediction("slope", "predictor", "intercept", clip=True).alias("site_q"),
    )


@query(
    "M2_percent_of_norm",
    """SELECT code, date, CASE WHEN discharge / norm * 100 BETWEEN 0 AND 500 THEN CAST(CAST(round_even(discharge / norm * 100, 0) AS INTEGER) AS VARCHAR) ELSE ' ' END AS pct
    FROM raw JOIN (SELECT code AS c, avg(discharge) AS norm FROM raw GROUP BY 1) AS n ON code = c""",
)
def percent_of_norm(t):
    norm = t.raw.groupBy("code").agg(F.avg("discharge").alias("norm"))
    return t.raw.join(norm, "code").select("code", "date", rounding.percent_of_norm("discharge", "norm").alias("pct"))


def _printed(x):
    return (
        f"CASE WHEN {x} = 0 THEN '0' WHEN {x} < 10 THEN CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR) "
        f"WHEN {x} < 100 THEN CAST(CAST({x} AS DECIMAL(18,1)) AS VARCHAR) ELSE CAST(CAST({x} AS DECIMAL(18,0)) AS VARCHAR) END"
    )


@query(
    "M3_discharge_range",
    f"""SELECT code, date, CASE WHEN lo = 0 AND hi = 0 THEN ' ' ELSE {_printed('lo')} END AS fc_qmin, CASE WHEN lo = 0 AND hi = 0 THEN ' ' ELSE {_printed('hi')} END AS fc_qmax
    FROM (SELECT code, date, greatest(discharge - 10, 0) AS lo, greatest(discharge + 10, 0) AS hi FROM raw) AS r""",
)
def discharge_range(t):
    bounds = rounding.discharge_range("discharge", F.lit(10.0))
    return t.raw.select("code", "date", *[c.alias(n) for n, c in bounds.items()])


def _parameters(t):
    flagged = t.registry.where("flag")
    return flagged.select(
        "code",
        F.lit(1.5).alias("a_p"), F.lit(0.5).alias("b_p"), F.lit(2.0).alias("wet_day"),
        F.lit(1.25).alias("a_t"), F.lit(0.96).alias("b_t"),
    )


MAPPED = """SELECT f.code, f.date, CASE WHEN flag THEN round_even(1.5 * pow(CASE WHEN P <= 2 THEN 0 ELSE P END, 0.5), 2) ELSE P END AS P,
      CASE WHEN flag THEN round_even(1.25 * pow(T + 273.15, 0.96) - 273.15, 2) ELSE T END AS T FROM forcing AS f LEFT JOIN registry AS r ON f.code = r.code"""


@query("M4_quantile_mapping", MAPPED, "P:r6 T:r6")
def quantile_mapping(t):
    return forcing.quantile_map(t.forcing, _parameters(t)).select("code", "date", "P", "T")


@query(
    "M5_discharge_depth",
    "SELECT d.code, date, discharge / area * 86400 * 1000 AS depth, discharge AS back FROM daily AS d JOIN registry AS r ON d.code = r.code",
    "depth:r3 back:r6",
)
def discharge_depth(t):
    depth = physics.discharge_to_depth("discharge", "area")
    rows = t.daily.join(t.registry.select("code", "area"), "code")
    return rows.select("code", "date", depth.alias("depth"), physics.depth_to_discharge(depth, "area").alias("back"))


@query(
    "M6_forecast_bounds",
    """SELECT code, date, discharge - 5 AS d_lower, discharge + 5 AS d_upper, 0.9 * discharge AS p_lower, 1.1 * discharge AS p_upper,
      least(discharge - 5, 0.9 * discharge) AS w_lower, greatest(discharge + 5, 1.1 * discharge) AS w_upper,
      greatest(discharge - 5, 0.9 * discharge) AS n_lower, least(discharge + 5, 1.1 * discharge) AS n_upper FROM daily""",
    "d_lower:r6 d_upper:r6 p_lower:r6 p_upper:r6 w_lower:r6 w_upper:r6 n_lower:r6 n_upper:r6",
)
def forecast_bounds(t):
    kinds = {
        "d": rounding.forecast_bounds("discharge", F.lit(5.0)),
        "p": rounding.forecast_bounds("discharge", F.lit(5.0), "percent", 10),
        "w": rounding.forecast_bounds("discharge", F.lit(5.0), "max", 10),
        "n": rounding.forecast_bounds("discharge", F.lit(5.0), "max", 10, wider=False),
    }
    return t.daily.select(
        "code", "date", *[c.alias(f"{k}_{n[3:]}") for k, b in kinds.items() for n, c in b.items()]
    )


PI2 = "(2 * pi() / 365 * dayofyear(date))"
DECL = f"(0.409 * sin({PI2} - 1.39))"
OMEGA = f"acos(greatest(-1, least(1, -tan(radians(lat)) * tan({DECL}))))"
RA = (
    f"(24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos({PI2})) * ({OMEGA} * sin(radians(lat)) * sin({DECL})"
    f" + cos(radians(lat)) * cos({DECL}) * sin({OMEGA})))"
)


@query(
    "M7_potential_evaporation",
    f"""SELECT f.code, date, CASE WHEN T + 5 > 0 THEN {RA} / 2.45 * (T + 5) / 100 ELSE 0.0 END AS pet
    FROM forcing AS f JOIN registry AS r ON f.code = r.code""",
    "pet:r6",
)
def potential_evaporation(t):
    rows = t.forcing.join(t.registry.select("code", "lat"), "code")
    return rows.select(
        "code", "date", physics.potential_evaporation("T", F.dayofyear("date"), "lat").alias("pet")
    )


@query(
    "M8_daylight_hours",
    f"SELECT f.code, date, {OMEGA} * 24 / pi() AS hours FROM forcing AS f JOIN registry AS r ON f.code = r.code",
    "hours:r6",
)
def daylight_hours(t):
    rows = t.forcing.join(t.registry.select("code", "lat"), "code")
    return rows.select("code", "date", physics.daylight_hours(F.dayofyear("date"), "lat").alias("hours"))


STATS = "SELECT code AS c, avg(discharge) AS m, stddev_samp(discharge) AS s, min(discharge) AS lo, max(discharge) AS hi FROM daily GROUP BY 1"


@query(
    "M9_scale_and_rescale",
    f"""SELECT code, date, (discharge - m) / s AS scaled, (discharge - lo) / (hi - lo) AS minmax, discharge AS back FROM daily JOIN ({STATS}) AS st ON code = c""",
    "scaled:r6 minmax:r6 back:r6",
)
def scale_and_rescale(t):
    stats = t.daily.groupBy("code").agg(
        F.lit("discharge").alias("feature"), F.avg("discharge").alias("mean"), F.stddev_samp("discharge").alias("std"),
        F.min("discharge").alias("min"), F.max("discharge").alias("max"),
    )
    standard = features.scale_with(t.daily, stats, ["discharge"]).withColumnRenamed("discharge", "scaled")
    minmax = features.scale_with(t.daily, stats, ["discharge"], "minmax").withColumnRenamed("discharge", "minmax")
    rows = standard.join(minmax, ["code", "date"]).join(stats.select("code", "mean", "std"), "code")
    return rows.select("code", "date", "scaled", "minmax", physics.rescaled("scaled", "mean", "std").alias("back"))


def _cycle(name, value, length):
    return {f"{name}_sin": f"sin(2 * pi() * {value} / {length})", f"{name}_cos": f"cos(2 * pi() * {value} / {length})"}


CYCLES = {**_cycle("day_of_year", "dayofyear(d)", 365), **_cycle("week", "weekofyear(d)", 52), **_cycle("month", "month(d)", 12)}


@query("M10_cyclic_features", _dated_sql(**CYCLES), " ".join(f"{n}:r6" for n in CYCLES))
def cyclic_features(t):
    return _dated(t, **physics.cyclic_features("d"))


@query("M12_valid_period", _dated_sql(valid_from="CAST(d + 11 AS DATE)", valid_to="CAST(d + 41 AS DATE)"))
def valid_period(t):
    return _dated(t, **cal.valid_dates("d", 30, 40))


@query("F8_forecast_flags", _dated_sql(pentad=issue("d"), decad=issue("d", "decad")))
def forecast_flags(t):
    return _dated(t, **cal.forecast_flags("d"))


@query(
    "M11_fourier_climatology",
    None,
    "discharge_climatology:r6 discharge_anomaly:r6",
)
def fourier_climatology(t):
    return features.fourier_climatology(t.daily, "discharge", 2)
