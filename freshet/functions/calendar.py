"""Pentad / decad calendar as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Horizon:
    name: str
    days: int  # nominal length of one period
    per_month: int

    @property
    def per_year(self) -> int:
        return 12 * self.per_month

    @property
    def in_month(self) -> str:
        return f"{self.name}_in_month"

    @property
    def in_year(self) -> str:
        return f"{self.name}_in_year"


PENTAD = Horizon("pentad", 5, 6)
DECAD = Horizon("decad", 10, 3)
HORIZONS = {h.name: h for h in (PENTAD, DECAD)}


def horizon_of(horizon: str | Horizon) -> Horizon:
    return horizon if isinstance(horizon, Horizon) else HORIZONS[horizon]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_in_month(date, horizon) -> Column:
    """Number of the period inside its month; the last one runs to month end."""
    h = horizon_of(horizon)
    slot = F.floor((F.dayofmonth(_col(date)) - 1) / h.days).cast("int") + 1
    return F.least(slot, F.lit(h.per_month))


def period_in_year(date, horizon) -> Column:
    h = horizon_of(horizon)
    return (F.month(_col(date)) - 1) * h.per_month + period_in_month(date, h)


def period_in_month_of(number, horizon) -> Column:
    """1..72 -> 1..6, 1..36 -> 1..3."""
    return F.pmod(_col(number) - 1, F.lit(horizon_of(horizon).per_month)).cast("int") + 1


def year_text(date) -> Column:
    return F.year(_col(date)).cast("string")


def predictor_decad(decad) -> Column:
    """D3: the decad before the given one, inside a month cycle of three."""
    return F.pmod(_col(decad) + 1, F.lit(3)).cast("int") + 1


def period_start(number, year, horizon) -> Column:
    """First day of period ``number`` of ``year``."""
    h = horizon_of(horizon)
    month = F.floor((_col(number) - 1) / h.per_month).cast("int") + 1
    day = (period_in_month_of(number, h) - 1) * h.days + 1
    return F.make_date(_col(year), month, day)


def period_end(number, year, horizon) -> Column:
    """Last day of period ``number`` of ``year``."""
    h = horizon_of(horizon)
    start = period_start(number, year, h)
    is_last = period_in_month_of(number, h) == h.per_month
    return F.when(is_last, F.last_day(start)).otherwise(F.date_add(start, h.days - 1))


def period_first_day(date, horizon) -> Column:
    """First day-of-month of the period that holds ``date``."""
    h = horizon_of(horizon)
    return (period_in_month(date, h) - 1) * h.days + 1


def period_last_day(date, horizon) -> Column:
    h = horizon_of(horizon)
    p = period_in_month(date, h)
    return F.when(p == h.per_month, F.dayofmonth(F.last_day(_col(date)))).otherwise(p * h.days)


def period_start_day_of_year(number, year, horizon) -> Column:
    """D7."""
    return F.dayofyear(period_start(number, year, horizon))


def issue_date_of_period(number, year, horizon) -> Column:
    """A period is forecast on the day before it starts."""
    return F.date_sub(period_start(number, year, horizon), 1)


def issue_day_of_year(number, year, horizon) -> Column:
    return F.dayofyear(issue_date_of_period(number, year, horizon))


def is_issue_date(date, horizon) -> Column:
    """issue dates are exactly the last days of periods."""
    d = _col(date)
    return F.dayofmonth(d) == period_last_day(d, horizon)


def next_issue_date(date, horizon) -> Column:
    """The first issue date on or after ``date`` - the end of its own period."""
    d = _col(date)
    return F.date_add(d, period_last_day(d, horizon) - F.dayofmonth(d))


def issue_days(date, horizon) -> Column:
    """Issue day numbers of the month of ``date`` as an array."""
    h = horizon_of(horizon)
    inner = [F.lit(h.days * i) for i in range(1, h.per_month)]
    return F.array(*inner, F.dayofmonth(F.last_day(_col(date))))


def is_leap_year(year) -> Column:
    y = _col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def forecast_flags(date) -> dict[str, Column]:
    """F8: which horizons are due on a date."""
    return {h.name: is_issue_date(date, h) for h in HORIZONS.values()}


def aligned_day_of_year(date, as_of_year) -> Column:
    """Day of year of last-year rows shifted so both years line up after February."""
    d, y = _col(date), _col(as_of_year)
    prior = F.year(d) == y - 1
    shift = (
        F.when(prior & (F.month(d) > 2) & ~is_leap_year(y) & is_leap_year(y - 1), -1)
        .when(prior & (F.month(d) > 2) & is_leap_year(y) & ~is_leap_year(y - 1), 1)
        .otherwise(0)
    )
    return F.dayofyear(leap_clipped(d, y)) + shift


def leap_clipped(date, as_of_year) -> Column:
    """Feb 29 is shown on Feb 28 when only last year is a leap year."""
    d, y = _col(date), _col(as_of_year)
    feb29 = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    return F.when(feb29 & ~is_leap_year(y) & is_leap_year(y - 1), F.date_sub(d, 1)).otherwise(d)


def normalized_day(date) -> Column:
    """Day of year on a 365-day axis; Feb 29 shares day 59 with Feb 28."""
    d = _col(date)
    doy = F.dayofyear(d)
    after = is_leap_year(F.year(d)) & (doy >= 60)
    return F.when(after, doy - 1).otherwise(doy)


def calendar_days_of(normalized, as_of_year) -> Column:
    """D10 inverse: the day(s) of year a normalised day stands for, as an array.

    In a leap year day 59 stands for Feb 28 and Feb 29.
    """
    n = _col(normalized)
    leap = is_leap_year(_col(as_of_year))
    return (
        F.when(leap & (n == 59), F.array(F.lit(59), F.lit(60)))
        .when(leap & (n > 59), F.array(n + 1))
        .otherwise(F.array(n))
    )


def month_end(date) -> Column:
    """D17."""
    return F.last_day(_col(date))


def predictor_window(date, days) -> Column:
    """[noon - (days and 12 h), noon] of the issue date."""
    noon = _col(date).cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    start = noon - F.make_dt_interval(F.lit(days), F.lit(12))
    return F.struct(start.alias("start"), noon.alias("end"))


def rerun_date(last_run) -> Column:
    """The day before the latest decadal issue date, seen from the last run.

    Runs on days 1..9 fall back to the end of the previous month; later runs to the
    9th, the 19th or the day before the previous month's end, whichever is the latest
    one strictly before the run's own day.
    """
    d = _col(last_run)
    previous_end = F.date_sub(F.trunc(d, "month"), 1)
    tail = F.dayofmonth(previous_end) - 1
    day = F.dayofmonth(d)
    picked = F.when(tail < day, tail).when(F.lit(19) < day, 19).otherwise(9)
    early = F.date_add(F.trunc(previous_end, "month"), tail - 1)
    return F.when(day < 10, early).otherwise(F.date_add(F.trunc(d, "month"), picked - 1))


def forecast_window(date, horizon) -> dict[str, Column]:
    """Predictor and forecast bounds around an issue date, for display."""
    h = horizon_of(horizon)
    d = _col(date)
    if h is PENTAD:
        back = F.lit(2)
    else:
        back = F.when(F.dayofmonth(d) > 20, F.dayofmonth(d) % 20 - 1).otherwise(9)
    start = F.date_add(d, 1)
    end = F.when(
        F.dayofmonth(start) == (h.per_month - 1) * h.days + 1, F.last_day(start)
    ).otherwise(F.date_add(d, h.days))
    return {
        "predictor_start": F.date_sub(d, back),
        "predictor_end": d,
        "forecast_start": start,
        "forecast_end": end,
    }


def daily_request_window(date, window_days: int = 50) -> Column:
    """20:00 UTC to 20:00 UTC around the last ``window_days`` local days."""
    cut = F.make_dt_interval(F.lit(0), F.lit(20))
    first = F.date_sub(_col(date), window_days).cast("timestamp") + cut
    return F.struct(first.alias("start"), (_col(date).cast("timestamp") + cut).alias("end"))


def morning_request_window(now) -> Column:
    """From 08:00 of the day to the current minute."""
    day = F.to_date(_col(now)).cast("timestamp")
    first = day + F.make_dt_interval(F.lit(0), F.lit(8))
    return F.struct(first.alias("start"), F.date_trunc("minute", _col(now)).alias("end"))


def valid_dates(issue_date, horizon_days: int, offset_days: int | None = None) -> dict[str, Column]:
    """The span a forecast issued on ``issue_date`` is valid for."""
    shift = (offset_days or horizon_days) - horizon_days
    first = F.date_add(_col(issue_date), 1 + shift)
    return {"valid_from": first, "valid_to": F.date_add(first, horizon_days)}
