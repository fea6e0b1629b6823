"""Streams with Spark's state: the same answer for every split, after restarts, with late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freshet.streaming import jobs, keyed

D, T = dt.date, dt.datetime
SCHEMA = "code string, ts timestamp, value double, arrival int"
#: Corrections and late rows of any age.
ROWS = [
    ("1", T(2024, 1, 31, 5), 1.0, 0), ("1", T(2024, 1, 25, 5), 2.0, 1), ("1", T(2024, 1, 25, 9), 5.0, 2),
    ("1", T(2023, 1, 1), 9.0, 3), ("2", T(2024, 1, 28), 4.0, 4), ("3", T(2024, 1, 31, 23), None, 5),
]


@pytest.fixture
def feed(frame, folder):
    """Append files to a streamed folder."""

    def add(name, parts):
        for part in parts:
            frame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}/events.parquet")
        return f"{folder}/{name}"

    return add


def stream(spark, path, files=None):
    source = spark.readStream.schema(SCHEMA)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    return source.parquet(f"{path}/events.parquet")


def answers(rows, path):
    dated = rows.select("code", F.to_date("ts").alias("date"), F.col("value").alias("discharge"), "arrival")
    found = (
        jobs.daily_mean(rows, f"{path}/x1"), jobs.newest(dated, f"{path}/x2"), jobs.three_day_sum(rows, f"{path}/x3"),
        jobs.silences(jobs.active_stretches(rows, 2, f"{path}/x4"), 2),
    )
    return [sorted((tuple(r) for r in f.collect()), key=str) for f in found]


def plain_silences(rows, days):
    """Every stretch without data, from the whole record."""
    active = {}
    for code, ts, *_ in rows:
        active.setdefault(code, set()).add(ts.date())
    end, out = max(d for found in active.values() for d in found), []
    for code, found in active.items():
        ordered = sorted(found)
        for a, b in zip(ordered, ordered[1:], strict=False):
            if (b - a).days - 1 >= days:
                out.append((code, a, b, (b - a).days - 1, False))
        if (end - ordered[-1]).days >= days:
            out.append((code, ordered[-1], end, (end - ordered[-1]).days, True))
    return sorted(out, key=str)


def test_answers_do_not_depend_on_batches(spark, feed):
    whole = answers(stream(spark, feed("one", [ROWS])), feed("one", []))
    many = feed("many", [[r] for r in reversed(ROWS)])
    assert whole == answers(stream(spark, many, 1), many)
    mean, newest, sums, silent = whole
    assert ("1", D(2024, 1, 25), 3.5) in mean and ("3", D(2024, 1, 31), None) in mean
    assert ("1", D(2024, 1, 25), 5.0) in newest and ("1", D(2023, 1, 1), 9.0) in newest
    assert ("1", D(2024, 1, 27), 7.0) in sums and ("3", D(2024, 2, 2), None) in sums
    assert silent == plain_silences(ROWS, 2)


def test_a_stopped_job_goes_on_where_it_was(spark, feed):
    path = feed("again", [ROWS[:2]])
    answers(stream(spark, path), path)
    feed("again", [ROWS[2:4]])
    answers(stream(spark, path), path)
    feed("again", [ROWS[4:]])
    again = answers(stream(spark, path), path)
    one = feed("once", [ROWS])
    assert again == answers(stream(spark, one), one)


def test_state_holds_one_row_a_day_and_reads_reduce_nothing(spark, feed, folder):
    rows = [("1", T(2024, 1, 1 + i % 3, i % 24), float(i), i) for i in range(60)]
    path = feed("state", [rows[i::4] for i in range(4)])
    got = jobs.daily_mean(stream(spark, path, 1), f"{path}/x1")
    assert got.count() == 3
    state = spark.read.format("statestore").load(f"{path}/x1/checkpoint")
    assert state.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    # of a part at most two versions stay
    assert max(len(v) for v in keyed._versions(f"{path}/x1").values()) <= keyed.KEPT


def test_timers_report_and_arrivals_clear(spark, feed):
    path = feed("timers", [[("a", T(2024, 1, 1), 1.0, 0), ("b", T(2024, 1, 3), 1.0, 0)]])

    def state():
        rows = jobs.active_stretches(stream(spark, path), 5, f"{path}/x4").where("open").collect()
        return {r.code: (r.last_date, r.silent) for r in rows}

    assert state() == {"a": (D(2024, 1, 1), False), "b": (D(2024, 1, 3), False)}
    feed("timers", [[("b", T(2024, 1, 6), 1.0, 0)]])
    # nothing of station a arrives: its timer alone reports it
    assert state() == {"a": (D(2024, 1, 1), True), "b": (D(2024, 1, 6), False)}
    feed("timers", [[("a", T(2024, 1, 5), 1.0, 0)]])
    assert state() == {"a": (D(2024, 1, 5), False), "b": (D(2024, 1, 6), False)}


def test_random_silences_equal_the_whole_record(spark, feed):
    rng = random.Random(5)
    rows = [(str(rng.randint(0, 5)), T(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 60 * 24)), 1.0, i) for i in range(90)]
    path = feed("random", [rows[i::5] for i in range(5)])
    got = jobs.silences(jobs.active_stretches(stream(spark, path, 2), 3, f"{path}/x4"), 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_silences(rows, 3)


def test_a_replayed_batch_changes_nothing(spark, frame, folder):
    schema = "code string, date date, discharge double"
    first = frame([("1", D(2024, 1, 1), 1.0), ("1", D(2024, 2, 1), 2.0)], schema)
    second = frame([("1", D(2024, 1, 1), 3.0), (None, None, 4.0)], schema)
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        keyed.upsert(batch, number, folder, ["code", "date"], keyed.month_of("date"))
    got = sorted((tuple(r) for r in keyed.current(spark, folder, first.schema).collect()), key=str)
    assert got == [("1", D(2024, 1, 1), 3.0), ("1", D(2024, 2, 1), 2.0), (None, None, 4.0)]


def test_a_day_before_the_end_of_the_record(spark, feed):
    path = feed("as_of", [ROWS])
    stretches = jobs.active_stretches(stream(spark, path), 1, f"{path}/x4")
    got = jobs.silences(stretches, 1, "2024-01-28").where("open").collect()
    assert sorted((r.code, r.last_date, r.silent_days) for r in got) == [("1", D(2024, 1, 25), 3)]


def test_stream_without_files_gives_an_empty_table(spark, frame, folder):
    frame([], "code string, ts timestamp, value double").write.parquet(f"{folder}/empty")
    rows = spark.readStream.schema("code string, ts timestamp, value double").option("pathGlobFilter", "*.none").parquet(f"{folder}/empty")
    assert jobs.daily_mean(rows).collect() == []
    assert jobs.silences(jobs.active_stretches(rows)).collect() == []
    with pytest.raises(Exception, match="PATH|not"):
        jobs.read_stream(spark, f"{folder}/nowhere", "events")
