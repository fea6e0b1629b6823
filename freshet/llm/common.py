"""Helpers of the operators: written tables, batch sizes, null-safe columns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder

#: Bytes of one slice of a long text, and where it may be cut.
SLICE = 1 << 22
BLANK = re.compile(rb"[\x20\x09-\x0D]")

#: Rows in one Arrow batch of whole texts; long texts then stay far below a worker's memory.
TEXT_ROWS = 256


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, in one folder a value of the columns ``by``."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint; Spark's cleaner removes it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


@contextmanager
def _settings(spark: SparkSession, keys: dict[str, str]):
    """Settings for what runs inside; the session's come back."""
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def small_batches(spark: SparkSession, rows: int = 1024, size: str = "16m"):
    """Arrow batches of at most so many rows and bytes for what runs inside; the session's settings come back."""
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size})


def shuffles_freed(spark: SparkSession):
    """Shuffle files of a query run inside go when it ends, not when the driver happens to collect its garbage.

    For queries that end in a written table: one that is run again would have to shuffle again.
    """
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def sample_by_hash(rows: DataFrame, group: str, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``group``, the least by hash of ``keys``.

    Large groups are first thinned by the same hash to about four times that, so ranking them
    moves a bounded number of rows however many there are.  The groups are few, as labels are.
    """
    unit = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    thin = rows.join(F.broadcast(sizes), group).where(unit < F.lit(4.0 * most + 100) / F.col("_rows")).drop("_rows")
    by = Window.partitionBy(group).orderBy(unit, *keys)
    return thin.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= most).drop("_rank")


def slices(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text cut at blanks into parts of about ``size`` bytes (else ``SLICE``), so that no list of words grows with it."""
    at, size = 0, size or SLICE
    while len(text) - at > size:
        blank = BLANK.search(text, at + size)
        if blank is None:
            break
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:] if at else text
