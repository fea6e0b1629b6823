"""X rows: the incremental jobs, run to completion over the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import query
from .views import gauge


def _readings(t):
    events = jobs.read_stream(t.spark, t.folder, "events")
    return events.select(gauge("user_id", 15).alias("code"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("X1_stream_daily_mean", "SELECT code, CAST(ts AS DATE) AS date, avg(value) AS discharge FROM readings GROUP BY 1, 2", "discharge:r6")
def stream_daily_mean(t):
    return jobs.daily_mean(_readings(t))


@query(
    "X2_stream_upsert",
    "SELECT CAST(10000 + user_id // 15 AS VARCHAR) AS code, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS discharge FROM events GROUP BY 1, 2",
)
def stream_upsert(t):
    events = jobs.read_stream(t.spark, t.folder, "events")
    rows = events.select(
        gauge("user_id", 15).alias("code"), F.to_date("ts").alias("date"), F.col("event_id").alias("arrival"),
        F.col("value").alias("discharge"),
    )
    return jobs.newest(rows)


@query(
    "X3_stream_three_day_sum",
    """SELECT code, CAST(day + k AS DATE) AS date, sum(value) AS discharge_sum FROM (SELECT code, CAST(ts AS DATE) AS day, value FROM readings) AS r
    CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS k) AS shift GROUP BY 1, 2""",
    "discharge_sum:r4",
)
def stream_three_day_sum(t):
    return jobs.three_day_sum(_readings(t))


@query(
    "X4_stream_silence",
    """SELECT code, d AS last_date, coalesce(following, newest) AS until, CAST(coalesce(following - 1, newest) - d AS INTEGER) AS silent_days, following IS NULL AS open
    FROM (SELECT *, lead(d) OVER (PARTITION BY code ORDER BY d) AS following, max(d) OVER () AS newest FROM (SELECT DISTINCT code, CAST(ts AS DATE) AS d FROM readings) AS days) AS s
    WHERE coalesce(following - 1, newest) - d >= 1""",
)
def stream_silence(t):
    return jobs.silences(jobs.active_stretches(_readings(t), 1), 1)
