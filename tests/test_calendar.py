import calendar
import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.functions import calendar as cal
from freshet.functions import rounding, text


@pytest.fixture(scope="module")
def days(spark):
    span = F.sequence(F.lit("1999-01-01").cast("date"), F.lit("2001-12-31").cast("date"))
    return spark.range(1).select(F.explode(span).alias("d"))


def last_day(d):
    return calendar.monthrange(d.year, d.month)[1]


@pytest.mark.parametrize("name,length,count", [("pentad", 5, 6), ("decad", 10, 3)])
def test_period_numbers_and_bounds(days, name, length, count):
    n = cal.period_in_year("d", name)
    rows = days.select(
        "d",
        cal.period_in_month("d", name).alias("p"),
        n.alias("n"),
        cal.period_start(n, F.year("d"), name).alias("start"),
        cal.period_end(n, F.year("d"), name).alias("end"),
        cal.is_issue_date("d", name).alias("issue"),
        cal.next_issue_date("d", name).alias("next"),
        cal.issue_date_of_period(n, F.year("d"), name).alias("issued"),
    ).collect()
    for r in rows:
        p = min((r.d.day - 1) // length + 1, count)
        first = r.d.replace(day=(p - 1) * length + 1)
        end = r.d.replace(day=last_day(r.d) if p == count else p * length)
        assert (r.p, r.n) == (p, (r.d.month - 1) * count + p)
        assert (r.start, r.end, r.next) == (first, end, end)
        assert r.issue == (r.d == end)
        assert r.issued == first - dt.timedelta(days=1)


def test_first_period_is_issued_in_the_year_before(days):
    row = days.select(cal.issue_date_of_period(F.lit(1), F.lit(2001), "pentad").alias("d")).first()
    assert row.d == dt.date(2000, 12, 31)


def test_leap_days_share_the_28th(days):
    rows = {r.d: r.n for r in days.select("d", cal.normalized_day("d").alias("n")).collect()}
    assert rows[dt.date(2000, 2, 29)] == rows[dt.date(2000, 2, 28)] == 59
    assert rows[dt.date(2000, 3, 1)] == rows[dt.date(2001, 3, 1)] == 60
    assert rows[dt.date(2000, 12, 31)] == 365


def test_leap_alignment_lines_up_both_years(frame):
    # last year 2000 is a leap year, the shown year 2001 is not
    df = frame([(dt.date(2000, 2, 29),), (dt.date(2000, 3, 10),), (dt.date(2001, 3, 10),)], "d date")
    rows = df.select(cal.aligned_day_of_year("d", F.lit(2001)).alias("n")).collect()
    assert [r.n for r in rows] == [59, 69, 69]
    # and the other way round
    df = frame([(dt.date(2023, 3, 10),), (dt.date(2024, 3, 10),)], "d date")
    rows = df.select(cal.aligned_day_of_year("d", F.lit(2024)).alias("n")).collect()
    assert [r.n for r in rows] == [70, 70]


def test_rerun_date(frame):
    cases = {(2024, 3, 5): (2024, 2, 28), (2024, 3, 10): (2024, 3, 9), (2024, 3, 25): (2024, 3, 19), (2024, 3, 30): (2024, 3, 28)}
    df = frame([(dt.date(*k),) for k in cases], "d date")
    got = {tuple(r.d.timetuple()[:3]): tuple(r.r.timetuple()[:3]) for r in df.select("d", cal.rerun_date("d").alias("r")).collect()}
    assert got == cases


@pytest.mark.parametrize(
    "value,expected",
    [(0.0, 0.0), (-3.0, 0.0), (0.00005, 0.0), (0.12345, 0.123), (0.012345, 0.0123), (0.0062315, 0.00623),
     (1.089, 1.09), (1.238, 1.24), (10.123, 10.1), (100.123, 100.0), (1005.123, 1005.0), (None, None)],
)
def test_round_significant(frame, value, expected):
    df = frame([(value,)], "q double")
    assert df.select(rounding.round_significant("q").alias("q")).first().q == expected


def test_printed_discharge(frame):
    df = frame([(-1.0,), (0.0,), (0.123,), (9.876,), (10.123,), (1000.123,)], "q double")
    rows = df.select(rounding.discharge_text("q").alias("a"), rounding.bulletin_text("q").alias("b")).collect()
    assert [r.a for r in rows] == [" ", "0", "0.12", "9.88", "10.1", "1000"]
    assert [r.b for r in rows] == ["0.0", "0.0", "0.12", "9.88", "10.1", "1000"]


def test_percent_of_norm_and_range(frame):
    df = frame([(50.0, 100.0, 5.0), (600.0, 100.0, 700.0), (1.0, 0.0, None)], "q double, n double, d double")
    bounds = rounding.discharge_range("q", "d")
    rows = df.select(rounding.percent_of_norm("q", "n").alias("p"), *[c.alias(k) for k, c in bounds.items()]).collect()
    assert [r.p for r in rows] == ["50", " ", " "]
    assert [(r.fc_qmin, r.fc_qmax) for r in rows] == [("45.0", "55.0"), ("0", "1300"), (" ", " ")]


@pytest.mark.parametrize(
    "name,river,place",
    [("Chu - Kochkor", "Chu", "Kochkor"), ("Chu -Kochkor", "Chu", "Kochkor"), ("Chu- Kochkor", "Chu", "Kochkor"),
     ("Chu-Kochkor", "Chu", "Kochkor"), ("Ala-Archa-mouth", "Ala-Archa", "mouth"),
     ("Ala-Archa-Kara-Suu", "Ala-Archa", "Kara-Suu"), ("Chu", "Chu", "")],
)
def test_split_name(frame, name, river, place):
    row = frame([(name,)], "n string").select(text.split_name("n").alias("s")).first().s
    assert (row.river, row.place) == (river, place)


def test_dates_are_parsed_by_one_layout(frame):
    df = frame([("13/02/2024",), ("05/02/2024",)], "date string")
    rows = text.parse_dates_robust(df, "date").collect()
    assert [r.date for r in rows] == [dt.date(2024, 2, 13), dt.date(2024, 2, 5)]


def test_unreadable_dates_fail(frame):
    with pytest.raises(Exception, match="no date layout fits"):
        text.parse_dates_robust(frame([("soon",), ("later",)], "date string"), "date").collect()
