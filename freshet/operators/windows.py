"""Per-station time-series windows.

All of them run on one row per (code, date).  A station's window group is then bounded
by the calendar - a DATE column cannot hold more than 3.7 million days, a century is
36,525 rows - however many stations there are, so one window task never sees more than
that.  ``merge.one_row_per_day`` establishes that property for raw input with
map-side pre-aggregation.  Windows share one spec (partition by code, order by ``_day``),
so Spark plans one exchange and one sort for a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rounding import round_significant
from ..schemas import require_columns
from ..session import deal
from .quantiles import exact_quantiles

KEYS = ("code",)


def with_day(df: DataFrame, date: str = "date") -> DataFrame:
    """Add the integer day all windows are ordered by, unless a caller already did.

    Keeping one ``_day`` column through a chain lets Spark keep one sort for it.
    """
    return df if "_day" in df.columns else df.withColumn("_day", F.unix_date(F.col(date)))


def without_day(df: DataFrame, source: DataFrame) -> DataFrame:
    return df if "_day" in source.columns else df.drop("_day")


def by_day(keys=KEYS, tie: str | None = None):
    """By day; rows that share a day stand in the order of ``tie``."""
    return Window.partitionBy(*keys).orderBy("_day", *([tie] if tie else []))


def from_end(keys=KEYS, tie: str | None = None):
    """Rows from the station's last day up to the current one.

    "The next known value" is the last one seen in this direction.  A frame that ends
    at UNBOUNDED FOLLOWING would be re-read for every row, which is quadratic in the
    length of a record; this costs one more sort inside the same partition.
    """
    order = [F.col(c).desc() for c in ("_day", *([tie] if tie else []))]
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def non_negative(value) -> Column:
    """negative discharge is a missing value."""
    v = cal._col(value)
    return F.when(v >= 0, v)


def add_issue_date(df: DataFrame, horizon, date: str = "date") -> DataFrame:
    """F3/F4."""
    return df.withColumn("issue_date", cal.is_issue_date(date, horizon))


def three_day_sum(df: DataFrame, value: str = "discharge", out: str = "discharge_sum") -> DataFrame:
    """Sum over the day and the two days before, on issue dates only."""
    require_columns(df, "code", "date", "issue_date", value)
    total = F.sum(value).over(by_day().rangeBetween(-2, 0))
    return without_day(with_day(df).withColumn(out, F.when(F.col("issue_date"), total)), df)


# Length of the month's last period by month length, per horizon.
LAST_PERIOD_DAYS = {
    "pentad": {28: 3, 29: 4, 30: 5, 31: 6},
    "decad": {28: 8, 29: 9, 30: 10, 31: 11},
}


def next_period_avg(df: DataFrame, horizon, value: str = "discharge", out: str = "discharge_avg") -> DataFrame:
    """Mean of the days after an issue date, over the length of the next period.

    Each row contributes the *following* row's value, and the frame is a range of days
    starting at the issue date, so records with missing days keep the same members as
    the reference's reversed rolling window.
    """
    h = cal.horizon_of(horizon)
    require_columns(df, "code", "date", "issue_date", value)
    source = df
    df = with_day(df).withColumn("_next", F.lead(value).over(by_day()))
    before_last = F.dayofmonth("date") == (h.per_month - 1) * h.days
    length = F.dayofmonth(F.last_day("date"))

    def mean_of(days: int) -> Column:
        return F.avg("_next").over(by_day().rangeBetween(0, days - 1))

    picked = F.when(~F.col("issue_date"), None)
    for month_days, days in LAST_PERIOD_DAYS[h.name].items():
        if days != h.days:
            picked = picked.when(before_last & (length == month_days), mean_of(days))
    return without_day(df.withColumn(out, picked.otherwise(mean_of(h.days))).drop("_next"), source)


def previous_issue_value(df: DataFrame, value: str = "discharge_avg", out: str = "predictor") -> DataFrame:
    """Value of the issue date before, null values included."""
    earlier = by_day().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("issue_date"), F.struct(value)), ignorenulls=True).over(earlier)
    return without_day(with_day(df).withColumn(out, F.when(F.col("issue_date"), last[value])), df)


def interpolate(
    df: DataFrame,
    value: str,
    limit: int | None = None,
    both: bool = False,
    by_time: bool = False,
    keys=KEYS,
    date: str = "date",
    tie: str | None = None,
) -> DataFrame:
    """Linear fill of null runs, at most ``limit`` rows from each side.

    Forward mode fills from the left edge of a gap and carries the last value past the
    end; ``both`` also fills from the right edge and extends the start.  Distances are
    rows, or days with ``by_time``; between two values of one day the earlier one fills.
    ``tie`` orders rows that share a day.  The backward sort comes first, so later forward
    windows of a chain keep the order this one leaves.
    """
    source, day = df, F.col("_day").cast("double")
    backward = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in ("_day", *([tie] if tie else []))])

    def known(position: str) -> Column:
        row = F.struct(day.alias("x"), F.col(position).alias("row"), F.col(value).alias("v"))
        return F.when(F.col(value).isNotNull(), row)

    df = with_day(df, date).withColumn("_back", F.row_number().over(backward))
    df = df.withColumn("_foll", F.last(known("_back"), ignorenulls=True).over(from_end(keys, tie)))
    df = df.withColumn("_row", F.row_number().over(by_day(keys, tie)))
    seen = by_day(keys, tie).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_prev", F.last(known("_row"), ignorenulls=True).over(seen))
    prev, foll = F.col("_prev"), F.col("_foll")
    behind, ahead = F.col("_row") - prev["row"], F.col("_back") - foll["row"]
    if by_time:
        slope = F.coalesce(F.try_divide(foll["v"] - prev["v"], foll["x"] - prev["x"]), F.lit(0.0))
        inner = prev["v"] + slope * (day - prev["x"])
    else:
        inner = prev["v"] + (foll["v"] - prev["v"]) / (behind + ahead) * behind
    reach = F.lit(True)
    if limit is not None:
        reach = F.coalesce(behind <= limit, F.lit(False))
        if both:
            reach = reach | F.coalesce(ahead <= limit, F.lit(False))
    ends = prev["v"] if not both else F.coalesce(prev["v"], foll["v"])
    filled = F.when(prev.isNotNull() & foll.isNotNull(), inner).otherwise(ends)
    df = df.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).when(reach, filled))
    return without_day(df.drop("_row", "_back", "_prev", "_foll"), source)


def prepare_series(df: DataFrame, horizon) -> DataFrame:
    """Cleaned daily series with predictor, target and period numbers.

    ``issue_period`` is the period of the issue date itself, ``target_period`` the one
    it forecasts (that of the next day).
    """
    h = cal.horizon_of(horizon)
    require_columns(df, "code", "date", "discharge")
    df = with_day(df).withColumn("discharge", non_negative("discharge"))
    df = interpolate(df, "discharge", limit=3, both=True)
    df = df.withColumn("discharge", round_significant("discharge"))
    df = add_issue_date(df, h)
    if h is cal.PENTAD:
        df = next_period_avg(three_day_sum(df, out="predictor"), h)
    else:
        df = previous_issue_value(next_period_avg(df, h))
    return df.withColumns(
        {
            "issue_period": cal.period_in_year("date", h),
            "target_period": cal.period_in_year(F.date_add("date", 1), h),
        }
    ).drop("_day")


def daily_reindex(df: DataFrame, keys=KEYS, date: str = "date") -> DataFrame:
    """A row for every day between a station's first and last one.

    Each row explodes into the days up to the next row, so the record is neither scanned
    nor joined a second time and stays partitioned by station.
    """
    others = [c for c in df.columns if c not in (*keys, date)]
    following = F.lead(date).over(by_day(keys))
    last = F.greatest(F.date_sub(following, 1), F.col(date))
    rows = without_day(with_day(df.where(F.col(date).isNotNull()), date).withColumn("_until", last), df)
    days = rows.select(
        *keys, F.col(date).alias("_own"), *others, F.explode(F.sequence(date, "_until")).alias(date)
    )
    return days.select(
        *keys, date, *[F.when(F.col(date) == F.col("_own"), F.col(c)).alias(c) for c in others]
    )


def change_filter(df: DataFrame, value: str = "discharge", ratio: float = 3.0, keys=KEYS) -> DataFrame:
    """Drop jumps of more than ``ratio`` times the previous value."""
    prev = F.lag(value).over(by_day(keys))
    jump = F.abs(F.col(value) - prev) > ratio * F.abs(prev)
    kept = F.when(~F.coalesce(jump, F.lit(False)), F.col(value))
    return without_day(with_day(df).withColumn(value, kept), df)


def season(date) -> Column:
    """Meteorological season by month number; December belongs to its own calendar year."""
    names = F.array(F.lit("winter"), F.lit("spring"), F.lit("summer"), F.lit("autumn"))
    return F.element_at(names, (F.floor(F.month(cal._col(date)) % 12 / 3) + 1).cast("int"))


def _iqr_filter(df, keys, value, below, above, min_rows, raw: bool = False, tasks: int | None = None) -> DataFrame:
    """Quartiles over a station's season or variable.

    On one row per day the calendar bounds the group, so they are a window: with the input
    partitioned by station already, no exchange or join is added.  ``raw`` input may repeat days
    without bound: equal values are counted before the shuffle, ranked over range partitions, and the bounds are
    joined back, so no buffer holds a key's values.  ``tasks`` deals the rows by key for what follows.
    """
    group = Window.partitionBy(*keys)
    if raw:
        found = exact_quantiles(df, list(keys), value, {"_q1": 0.25, "_q3": 0.75}, tasks)
        bounds = found.select(*keys, F.array("_q1", "_q3").alias("_q"))
        if min_rows:
            bounds = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(bounds, list(keys), "left")
        known = df.dropna(subset=list(keys))
        df, counted = deal(known, tasks, *keys).join(bounds, list(keys), "left"), True
    else:
        quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
        df, counted = df.withColumn("_q", quartiles.over(group)), False
    low = F.col("_q")[0] - below * (F.col("_q")[1] - F.col("_q")[0])
    high = F.col("_q")[1] + above * (F.col("_q")[1] - F.col("_q")[0])
    keep = F.col(value).between(low, high)
    if min_rows:
        df = df if counted else df.withColumn("_n", F.count(F.lit(1)).over(group))
        keep = (F.col("_n") <= min_rows) | keep
    return df.withColumn(value, F.when(keep, F.col(value))).drop("_n", "_q")


def seasonal_iqr_filter(df: DataFrame, value: str = "discharge", date: str = "date", raw: bool = False) -> DataFrame:
    """Null outside [Q1 - 2.0 IQR, Q3 + 6.5 IQR] of a station's season with > 10 rows."""
    df = df.where(F.col("code").isNotNull()).withColumn("_season", season(date))
    return _iqr_filter(df, ("code", "_season"), value, 2.0, 6.5, 10, raw).drop("_season")


def rough_outlier_filter(df: DataFrame, value: str = "discharge", order: str | None = None) -> DataFrame:
    """Seasonal filter, keep-first per day, daily calendar, short-gap fill, jump filter, fill."""
    from .merge import dedupe

    if order:
        df = seasonal_iqr_filter(df, value, raw=True)
        df = dedupe(df, ["code", "date"], F.col(order), keep="first").drop(order)
    else:
        df = seasonal_iqr_filter(df.repartition("code"), value)  # one exchange for the whole chain
    df = interpolate(with_day(daily_reindex(df)), value, limit=2, by_time=True)
    return interpolate(change_filter(df, value), value, limit=2, by_time=True).drop("_day")


def station_iqr_filter(df: DataFrame, value: str = "value", order: str | None = None, tasks: int | None = None) -> DataFrame:
    """1.5 IQR on both sides per (code, variable), short-gap fill, keep-last per day.

    ``tasks`` deals the rows of raw input to so many tasks.
    """
    from .merge import dedupe

    keys = ("code", "variable")
    df = _iqr_filter(df.dropna(subset=list(keys)), keys, value, 1.5, 1.5, 0, raw=order is not None, tasks=tasks)
    df = interpolate(df, value, limit=2, by_time=True, keys=keys, tie=order)
    return dedupe(df, [*keys, "date"], F.col(order)).drop(order) if order else df


def detect_gaps(df: DataFrame, as_of, max_age_days: int = 730, date: str = "date") -> DataFrame:
    """Runs of missing days per station, clipped to the last ``max_age_days``."""
    days = df.select("code", F.to_date(date).alias("date")).dropna().distinct()
    cutoff = F.date_sub(F.lit(as_of).cast("date"), max_age_days)
    following = F.lead("date").over(Window.partitionBy("code").orderBy("date"))
    start = F.greatest(F.date_add("date", 1), cutoff)
    return (
        days.withColumn("_next", following)
        .select("code", start.alias("gap_start"), F.date_sub("_next", 1).alias("gap_end"))
        .where(F.col("gap_start") <= F.col("gap_end"))
    )


def gap_islands(gaps: DataFrame) -> DataFrame:
    """Merge gaps that overlap or touch across all stations into islands.

    Gaps are first reduced to one row per start day (map-side maximum of the end), so the
    unpartitioned window sees at most one row per calendar day, however many stations
    there are.
    """
    starts = gaps.groupBy("gap_start").agg(F.max("gap_end").alias("_end"))
    w = Window.orderBy("gap_start")
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("gap_start") > F.date_add("_reach", 1), F.lit(True)).cast("int")
    islands = starts.withColumn("_reach", reach).withColumn("island", F.sum(opens).over(w))
    return gaps.join(islands.select("gap_start", "island"), "gap_start")


def group_gaps(gaps: DataFrame, batch_size: int = 30, block_digits: int = 3) -> DataFrame:
    """Request batches - one row per (island, batch) with span and at most
    ``batch_size`` stations.

    Stations are numbered per island without sorting an island in one task: codes that
    differ in the last ``block_digits`` digits form a block (at most 10**digits of them),
    blocks are numbered by cumulated counts, stations inside their own block.
    """
    per_site = gap_islands(gaps).groupBy("island", "code").agg(
        F.min("gap_start").alias("start"), F.max("gap_end").alias("end")
    )
    block = F.expr(f"left(code, greatest(length(code) - {block_digits}, 0))")
    per_site = per_site.withColumn("_len", F.length("code")).withColumn("_block", block)
    blocks = per_site.groupBy("island", "_len", "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("island").orderBy("_len", "_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("island", "_len", "_block").orderBy("code"))
    numbered = per_site.withColumn("_i", inside).join(blocks, ["island", "_len", "_block"])
    batch = F.floor((F.col("_ahead") + F.col("_i") - 1) / batch_size).cast("int")
    return (
        numbered.withColumn("batch", batch)
        .groupBy("island", "batch")
        .agg(
            F.min("start").alias("start_date"),
            F.max("end").alias("end_date"),
            F.array_sort(F.collect_list("code")).alias("sites"),
        )
    )


def forecast_gaps(df: DataFrame, limit: int = 1, keys=KEYS) -> DataFrame:
    """Consecutive forecast dates of a station (or of ``keys``) more than ``limit`` days apart."""
    days = df.select(*keys, "forecast_date").distinct()
    prev = F.lag("forecast_date").over(Window.partitionBy(*keys).orderBy("forecast_date"))
    return (
        days.withColumn("gap_start", prev)
        .where(F.datediff("forecast_date", "gap_start") > limit)
        .select(*keys, "gap_start", F.col("forecast_date").alias("gap_end"))
    )


def min_periods(window: int) -> int:
    return max(1, min(int(window * 0.5), 15))


def array_median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return (
        F.element_at(s, F.floor((n + 1) / 2).cast("int"))
        + F.element_at(s, F.floor(n / 2 + 1).cast("int"))
    ) / 2


def rolling(value: str, op: str, window: int, keys=KEYS, row: str = "_row") -> Column:
    """One rolling statistic as a column (needs ``_day``, and ``_row`` for shape ones).

    Shape statistics (slope, peak-to-peak, deviation, distance) are null when the frame
    holds a null value.
    """
    frame = by_day(keys).rowsBetween(-(window - 1), 0)
    n, rows = F.count(value).over(frame), F.count(F.lit(1)).over(frame)
    enough = n >= min_periods(window)
    plain = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}
    if op in plain:
        return F.when(enough, plain[op](value).over(frame))
    full = enough & (n == rows)
    if op == "slope":
        slope = F.regr_slope(F.col(value), F.col(row)).over(frame)
        return F.when(full & (n >= 2), slope)
    if op == "peak_to_peak":
        return F.when(full, F.max(value).over(frame) - F.min(value).over(frame))
    if op == "median_abs_deviation":
        values = F.collect_list(value).over(frame)
        median = array_median(values)
        return F.when(full, array_median(F.transform(values, lambda v: F.abs(v - median))))
    if op == "time_distance_from_peak":
        peak = F.max(F.struct(F.col(value).alias("v"), (-F.col(row)).alias("r"))).over(frame)
        return F.when(full, F.col(row) + peak["r"] + 1)
    raise ValueError(f"unsupported operation {op!r}")


def with_row(df: DataFrame, keys=KEYS, date: str = "date") -> DataFrame:
    return with_day(df, date).withColumn("_row", F.row_number().over(by_day(keys)))


def rolling_features(df: DataFrame, specs: dict[str, list[tuple[str, list[int]]]], keys=KEYS) -> DataFrame:
    """W16-W18 for many columns: ``{column: [(op, [windows])]}``."""
    df = with_row(df, keys)
    columns = {
        f"{column}_roll_{op}_{w}": rolling(column, op, w, keys)
        for column, ops in specs.items()
        for op, windows in ops
        for w in windows
    }
    return df.withColumns(columns).drop("_day", "_row")


def lag_features(df: DataFrame, column: str, lags: list[int], keys=KEYS) -> DataFrame:
    """Positive numbers lag, negative ones lead."""
    w = by_day(keys)
    named = {
        f"{column}_{'lag' if n > 0 else 'lead'}_{abs(n)}": F.lag(column, n).over(w) for n in lags
    }
    return with_day(df).withColumns(named).drop("_day")


def rolling_mean_bfill(df: DataFrame, column: str, windows=(3, 5, 10), keys=KEYS) -> DataFrame:
    """Mean of full windows, the leading nulls filled from the first known mean."""
    df = with_day(df)
    for n in windows:
        frame = by_day(keys).rowsBetween(-(n - 1), 0)
        mean = F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))
        df = df.withColumn(f"{column}_mean_{n}", mean)
    named = [f"{column}_mean_{n}" for n in windows]
    return df.withColumns(
        {c: F.last(c, ignorenulls=True).over(from_end(keys)) for c in named}
    ).drop("_day")


def ffill(df: DataFrame, column: str, keys=KEYS, date: str = "date", trailing_only: bool = False) -> DataFrame:
    """Carry the last value forward inside a station; optionally past the end only."""
    w = by_day(keys)
    filled = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if trailing_only:
        last = F.max(F.when(F.col(column).isNotNull(), F.col("_day"))).over(Window.partitionBy(*keys))
        filled = F.when(F.col("_day") > last, filled).otherwise(F.col(column))
    return with_day(df, date).withColumn(column, filled).drop("_day")


def target_future_mean(df: DataFrame, column: str, horizon: int, offset: int, out: str = "target", keys=KEYS) -> DataFrame:
    """Mean of ``horizon`` rows ending ``offset`` rows ahead."""
    need = max(1, min(int(horizon * 0.75), 15))
    frame = by_day(keys).rowsBetween(offset - horizon + 1, offset)
    exists = F.count(F.lit(1)).over(by_day(keys).rowsBetween(offset, offset)) == 1
    mean = F.when(exists & (F.count(column).over(frame) >= need), F.avg(column).over(frame))
    return with_day(df).withColumn(out, mean).drop("_day")


def trailing_nulls(df: DataFrame, value: str = "discharge") -> DataFrame:
    """Nulls after a station's last known value."""
    last = df.groupBy("code").agg(F.max(F.when(F.col(value).isNotNull(), F.col("date"))).alias("_last"))
    after = F.col("_last").isNull() | (F.col("date") > F.col("_last"))
    return df.join(last, "code").groupBy("code").agg(F.count_if(after).alias("trailing_nulls"))


def fill_from_previous_forecast(daily: DataFrame, forecasts: DataFrame, value: str = "Q50") -> DataFrame:
    """Null days take the newest earlier forecast made for them, then gaps are
    interpolated and the end is carried forward."""
    known = forecasts.groupBy("code", "date").agg(F.max_by(value, "forecast_date").alias("_fc"))
    df = daily.join(known, ["code", "date"], "left")
    df = df.withColumn("discharge", F.coalesce("discharge", "_fc")).drop("_fc")
    return interpolate(df, "discharge")


def hindcast_start(last_dates: DataFrame, sites: DataFrame | None = None, default_start=None) -> DataFrame:
    """The second-earliest next date over all gauges, so one stale gauge cannot
    pull the start back.  New gauges together count once, with the default start, and
    without a default give no date.  The two smallest values come from a distributed
    top-2, never from a global sort.
    """
    default = F.lit(default_start).cast("date")
    starts = last_dates.select(F.date_add("last_date", 1).alias("start"))
    known = F.lit(True)
    if sites is not None:
        new = sites.select("code").join(last_dates, "code", "left_anti").limit(1)
        if default_start is None:
            known = new.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
        else:
            starts = starts.unionByName(new.select(default.alias("start")))
    second = starts.orderBy("start").limit(2).agg(F.max("start").alias("start_date"))
    return second.select(F.when(known, F.coalesce("start_date", default)).alias("start_date"))
