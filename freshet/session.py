"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # daily records are small in bytes but heavy in window work: keep tasks small
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("freshet")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may fall back to a machine-local folder; on a cluster a
    missing setting is an error, because other executors could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="freshet-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows one task of a large aggregate or sort should hold.
ROWS_PER_TASK = 200_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions that keep a task near ``ROWS_PER_TASK`` rows; None where the cluster's cores are enough."""
    n = -(-rows // ROWS_PER_TASK)
    return n if n > spark.sparkContext.defaultParallelism else None


def deal(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt by key to so many tasks, whatever number of shuffle partitions the session has.

    Adaptive execution merges partitions by their compressed bytes, which says little about the memory a task needs for them;
    a number given here stays.
    """
    return df.repartition(tasks, *keys) if tasks else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
