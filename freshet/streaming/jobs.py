"""Incremental ingest as Structured Streaming.

What must be remembered between batches is Spark's own state (RocksDB, saved in the shared folder with the
checkpoint): one aggregate per (station, day), for silences the active days of a station and
its timer.  Batches pass on the rows they changed, which ``keyed`` puts into a table that is read as it stands.
No row is dropped for its age: late rows and corrections always count, and the answer is the
same however rows fall into batches and wherever a job was stopped and started again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import shared_folder
from . import keyed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's parquet table as a file stream, whether it is one file or a directory of files."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):
        # a stream reads directories: take the single file out of its folder
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; a query copies the session's settings when it starts."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_available(result: DataFrame, keys: list[str], part: Column, base: str | None = None) -> DataFrame:
    """Process what is there and return the table of current rows below ``base``.

    ``result`` is a streaming table whose updates hold whole rows.  A later call with the same ``base`` goes on
    where the one before stopped.
    """
    spark = result.sparkSession
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with rocksdb(spark):
        query = (
            result.writeStream.outputMode("update")
            .foreachBatch(lambda batch, number: keyed.upsert(batch, number, base, keys, part))
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return keyed.current(spark, base, result.schema)


DAY = ["code", "date"]


def daily_mean(readings: DataFrame, base: str | None = None) -> DataFrame:
    """Readings (code, ts, value) -> mean per (code, UTC day); null where no reading has a value."""
    rows = readings.groupBy("code", F.to_date("ts").alias("date")).agg(F.avg("value").alias("discharge"))
    return run_available(rows, DAY, keyed.month_of("date"), base)


def newest(rows: DataFrame, base: str | None = None) -> DataFrame:
    """(code, date, discharge, arrival) -> the value that arrived last; a correction wins whatever its age."""
    held = rows.groupBy("code", "date").agg(F.max_by("discharge", "arrival").alias("discharge"))
    return run_available(held, DAY, keyed.month_of("date"), base)


def three_day_sum(readings: DataFrame, base: str | None = None) -> DataFrame:
    """Readings -> sum over each day and the two before it."""
    day = F.to_date("ts")
    days = F.explode(F.array(*[F.date_add(day, k) for k in range(3)]))
    rows = readings.select("code", days.alias("date"), "value").groupBy("code", "date")
    return run_available(rows.agg(F.sum("value").alias("discharge_sum")), DAY, keyed.month_of("date"), base)


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (code, date) of each batch, before rows are sent to their station."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["code", "date"]).aggregate([])
        yield from table.select(["code", "date"]).to_batches()


EPOCH = dt.date(1970, 1, 1)
DAY_MS = 86_400_000
STRETCHES = "code string, last_date date, until date, open boolean, silent boolean"


def merged(runs: list[tuple[int, int]], days: list[int]) -> list[tuple[int, int]]:
    """Stretches of successive days, those of ``days`` added."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*runs, *((d, d) for d in days)]):
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Silence(StatefulProcessor):
    """Per station its stretches of active days and an event-time timer, ``days`` days after the last.

    Arrivals move the timer and clear a silence that it has reported; late days close or split older ones.  Each
    change passes on all of the station's stretches.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("active", "starts array<int>, ends array<int>")

    def _runs(self) -> list[tuple[int, int]]:
        return list(zip(*self.state.get(), strict=True)) if self.state.exists() else []

    def _rows(self, code: str, runs: list[tuple[int, int]], silent: bool) -> pd.DataFrame:
        def date(number):
            return EPOCH + dt.timedelta(days=int(number))

        following = [date(start) for start, _ in runs[1:]]
        return pd.DataFrame({
            "code": code, "last_date": [date(end) for _, end in runs], "until": [*following, None],
            "open": [False] * len(following) + [True], "silent": [True] * len(following) + [silent],
        })

    def handleInputRows(self, key, rows, timerValues):
        days = [(d - EPOCH).days for part in rows for d in part["date"]]
        runs = merged(self._runs(), days)
        self.state.update(tuple(list(x) for x in zip(*runs, strict=True)))
        due = (runs[-1][1] + self.days) * DAY_MS
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        silent = due <= timerValues.getCurrentWatermarkInMs()
        if not silent:
            self.handle.registerTimer(due)
        yield self._rows(key[0], runs, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._rows(key[0], self._runs(), True)

    def close(self) -> None:
        pass


def active_stretches(readings: DataFrame, days: int = 1, base: str | None = None) -> DataFrame:
    """``code, last_date, until, open, silent``: where a station's active days end and go on again.

    ``silent`` of the newest stretch is set by a timer as soon as the newest reading of any station is ``days`` days
    later, and cleared by an arrival.  Readings without code or time do not count.
    """
    # the time column goes before rows are grouped: its watermark drives the timers but drops no late row
    timed = readings.where("code is not null and ts is not null").withWatermark("ts", "0 seconds")
    rows = timed.select("code", F.to_date("ts").alias("date")).mapInArrow(_active, "code string, date date")
    found = rows.groupBy("code").transformWithStateInPandas(Silence(days), STRETCHES, "update", "eventTime")
    return run_available(found, ["code"], keyed.bucket_of("code"), base)


def silences(stretches: DataFrame, days: int = 1, as_of=None) -> DataFrame:
    """Silences of at least ``days`` days, the one still open included.

    An open silence runs from a station's last day to ``as_of`` (else the newest day of all stations).  Without
    ``as_of`` the timers decide whether it is one.
    """
    end = F.lit(as_of).cast("date") if as_of is not None else stretches.agg(F.max("last_date").alias("d")).scalar()
    rows = stretches.where(F.col("last_date") <= end).withColumn("_end", end)
    open_ = F.col("open") if as_of is None else F.col("open") | (F.col("until") > F.col("_end"))
    until = F.when(open_, F.col("_end")).otherwise(F.col("until"))
    rows = rows.withColumns({
        "_open": open_, "_until": until, "silent_days": F.date_diff(until, "last_date") - F.when(open_, 0).otherwise(1)
    })
    kept = F.col("silent_days") >= days
    if as_of is None:
        kept = F.when(F.col("open"), F.col("silent")).otherwise(kept)
    return rows.where(kept).select("code", "last_date", F.col("_until").alias("until"), "silent_days", F.col("_open").alias("open"))
