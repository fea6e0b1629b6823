"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets of about ``BUCKET`` rows, the longest first.  A first
round holds every query against the longest bucket and leaves it with a score that its k-th best
cannot fall below.  With it a (query, bucket) pair has a local cosine threshold: the score over the
query's length and the bucket's greatest length.  Above 1 the bucket is pruned before the
shuffle.  In a task, each query with a high local threshold cuts by coordinates (a candidate's
largest query coordinate must lie in a feasible interval), one with a low threshold by length
alone; all that is left is multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .near_dedup import runs
from .vectors import matrix, one_per_id, widened

BUCKET = 8192
#: Queries of one block.
QUERIES = 1024
#: From this local cosine threshold on, coordinates are worth looking at.
COORDINATES = 0.8

_PART = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while they are exact, else in Python integers, kept in 64 bits."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if bound < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) @ np.array(
        [[int(v) for v in row] for row in x], object
    ).reshape(x.shape).T
    return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in whole], np.int64).reshape(whole.shape)


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1))


def _candidates(q: np.ndarray, x: np.ndarray, units: np.ndarray, length: np.ndarray, floor: float) -> np.ndarray:
    """Rows of a bucket, longest first, that can reach ``floor`` with the query."""
    own = float(np.sqrt((q * q).sum()))
    if floor <= 0 or not np.isfinite(own) or own == 0 or not np.isfinite(length).all():
        return np.arange(len(x))
    slack = 1 - 1e-9
    rows = np.flatnonzero(own * length >= floor * slack)
    if not len(rows):
        return rows
    local = floor * slack / (own * length[rows[0]])
    if local < COORDINATES:
        return rows
    focus = int(np.abs(q).argmax())
    at = q[focus] / own
    spread = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - at * at))
    low = -1.0 if -at >= local else at * local - spread
    high = 1.0 if at >= local else at * local + spread
    inside = units[rows, focus]
    return rows[(inside >= low - 1e-9) & (inside <= high + 1e-9)]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tasks, table in runs(batches, 1):
            cuts = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(a, b - a)
                asks = part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                ids = part.column("vec_id").to_numpy()
                floor = part.column("floor").to_numpy(zero_copy_only=False)
                every = matrix(part.column("embedding"))
                q, x = every[asks], every[~asks]
                names, owners = ids[~asks], ids[asks]
                if not len(q) or not len(x):
                    continue
                length = _lengths(x)
                order = np.argsort(-length, kind="stable")
                x, names, length = x[order], names[order], length[order]
                units = x / np.where(length > 0, length, 1)[:, None]
                out = []
                for query, owner, least in zip(q, owners, floor[asks], strict=True):
                    rows = _candidates(query, x, units, length, least)
                    rows = rows[names[rows] != owner]
                    score = exact_scores(query[None], x if len(rows) == len(x) else x[rows])[0]
                    good = np.lexsort((names[rows], -score))[:k] if len(rows) <= 4 * k else _best(names[rows], score, k)
                    # below the floor nothing can be among the k best
                    good = good[score[good] >= least]
                    out.append((np.full(len(good), owner), names[rows][good], score[good]))
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PART)

    return run


def _best(names: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    least = np.partition(score, len(score) - k)[len(score) - k]
    rows = np.flatnonzero(score >= least)
    return rows[np.lexsort((names[rows], -score[rows]))[:k]]


def _leading(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best among all other ids.

    Components become floor(scale * x).  Queries are the ids divisible by ``every``.  Ties go to
    the smaller vec_id.  Vectors that are null, empty or hold null or non-finite components take no
    part, neither do rows without an id; of rows that repeat an id the least usable vector counts;
    shorter vectors count as filled up with zeros; sums beyond 64 bits are held at the limits.
    Other columns are ignored.
    """
    spark = rows.sparkSession
    # a double of 2^52 or more is whole already, and may be beyond the longs that floor returns
    whole = F.transform(
        "embedding", lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale)
    )
    data = one_per_id(rows).where("embedding is not null").select("vec_id", whole.alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    data = written(data.withColumn("norm", norm), "norms")
    count = data.count()
    # buckets of like length: ids break ties, so equal lengths are split as well
    buckets = max(1, -(-count // BUCKET))
    dealt = data.repartitionByRange(buckets, F.col("norm").desc(), F.xxhash64("vec_id")).withColumn(
        "bucket", F.spark_partition_id()
    )
    dealt = written(dealt, "buckets")
    lengths = dealt.groupBy("bucket").agg(F.max("norm").alias("longest")).orderBy("bucket").collect()
    tops = spark.createDataFrame([(r.bucket, float(r.longest)) for r in lengths], "bucket int, longest double")
    asked = data.where(F.col("vec_id") % every == 0).withColumn("floor", F.lit(float("-inf")))
    blocks = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(max(1, -(-count // (every * QUERIES))))).cast("int")
    asked = asked.withColumn("block", blocks)
    groups = max(1, -(-count // (every * QUERIES)))
    first = lengths[0].bucket if lengths else 0

    def held(queries: DataFrame, bucket_rows: DataFrame, width: int) -> DataFrame:
        task = F.col("bucket").cast("long") * groups + F.col("block")
        asks = queries.select(task.alias("task"), F.lit(True).alias("asks"), "vec_id", "floor", "embedding")
        spread = bucket_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        rest = spread.select(
            task.alias("task"), F.lit(False).alias("asks"), "vec_id", F.lit(0.0).alias("floor"), "embedding"
        )
        both = asks.unionByName(rest).repartition(width, "task").sortWithinPartitions("task")
        return both.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    start = held(asked.withColumn("bucket", F.lit(first)), dealt.where(F.col("bucket") == first), min(groups, 4096))
    start = written(_leading(start, k).drop("rank"), "first")
    floors = start.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("low")
    )
    asked = asked.drop("floor").join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn(
        "floor", F.coalesce("low", F.lit(float("-inf")))
    )
    later = asked.join(F.broadcast(tops.where(F.col("bucket") != first)), F.col("norm") * F.col("longest") >= F.col("floor") * (1 - 1e-9))
    rest = held(later, dealt.where(F.col("bucket") != first), max(1, min(groups * len(lengths), 4096)))
    return _leading(start.unionByName(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
