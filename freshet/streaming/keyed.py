"""A keyed table that a stream keeps up to date: the newest rows of each key, stored once.

Every micro-batch brings whole current rows of the keys it changed.  It rewrites the parts (months, or
buckets of keys) that hold them, in a folder named by the batch; a part is read from the newest finished batch that
has it.  So a read is a plain scan, its cost does not grow with the number of batches, and a batch
replayed after a failure overwrites its own folder with the same rows.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.writers import file_store

#: Versions of a part that stay: the one in use and the one a replayed batch starts from.
KEPT = 2
PART = "_part"


def month_of(date: str) -> Column:
    """Parts of a table of days; days without a date are one part."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def bucket_of(key: str, buckets: int = 64) -> Column:
    """Parts of a table of stations."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


def _versions(base: str) -> dict[str, list[tuple[int, str]]]:
    """For each part its finished batches, the newest first, and their folders."""
    store, root = file_store(base)
    found: dict[str, list[tuple[int, str]]] = {}
    for batch in store.get_file_info(fs.FileSelector(f"{root}/table", allow_not_found=True)):
        names = store.get_file_info(fs.FileSelector(batch.path))
        if batch.base_name.startswith("batch=") and any(n.base_name == "_SUCCESS" for n in names):
            for part in names:
                if part.base_name.startswith(f"{PART}="):
                    at = f"{base}/table/{batch.base_name}/{part.base_name}"
                    found.setdefault(part.base_name.removeprefix(f"{PART}="), []).append((int(batch.base_name[6:]), at))
    return {part: sorted(batches, reverse=True) for part, batches in found.items()}


def _scan(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """All keys' current rows; empty before the first batch."""
    return _scan(spark, schema, [batches[0][1] for batches in _versions(base).values()])


def upsert(batch: DataFrame, batch_id: int, base: str, keys: list[str], part: Column) -> None:
    """Put a batch's rows in the place of all rows with their keys."""
    spark, schema = batch.sparkSession, batch.schema
    staged = f"{base}/changed/batch={batch_id}"
    # the state is read once, however many jobs follow
    batch.withColumn(PART, part).write.mode("overwrite").parquet(staged)
    changed = spark.read.schema(StructType([*schema.fields, StructField(PART, StringType())])).parquet(staged)
    # the calendar or the number of buckets bounds the parts
    parts = {r[0] for r in changed.select(PART).distinct().collect()}
    if not parts:
        return
    before = {p: [b for b in batches if b[0] < batch_id] for p, batches in _versions(base).items() if p in parts}
    held = _scan(spark, schema, [batches[0][1] for batches in before.values() if batches])
    same = [held[k].eqNullSafe(F.col(f"_new.{k}")) for k in keys]
    named = changed.select(*keys).distinct().alias("_new")
    rest = held.join(named, same, "left_anti").withColumn(PART, part)
    rows = rest.unionByName(changed).repartition(PART)
    rows.write.mode("overwrite").partitionBy(PART).parquet(f"{base}/table/batch={batch_id}")
    store, root = file_store(base)
    for batches in before.values():
        for _, path in batches[KEPT - 1 :]:
            store.delete_dir(file_store(path)[1])
    store.delete_dir(f"{root}/changed/batch={batch_id}")
