"""Exact quantiles for groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, deal


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], tasks: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles without holding a group in one task.

    Built-in ``percentile`` keeps a group's distinct values in one buffer, which is right
    when the calendar bounds a group.  Here the groups are unbounded: equal values are
    counted first, the counts are range-partitioned by (key, value) - which splits a hot
    key over many partitions - and each partition's start rank comes from the totals of
    the partitions before it.  Only a partition's first and last key can go on in another
    one, so those totals are a few rows.  The range partitioning is checkpointed so partition
    numbers cannot change between its two uses.  Rows without a key do not count.

    ``tasks`` deals each step to so many tasks; equal values still meet before the shuffle
    by range, in one row per task of the input, and of a key's rows only those go on that hold a wanted rank.
    """
    rows = df.where(F.col(value).isNotNull()).dropna(subset=keys).select(*keys, value)
    if tasks:
        rows = deal(rows.withColumn("_from", F.spark_partition_id()), tasks, *keys, value, "_from")
        counts = rows.groupBy(*keys, value, "_from").agg(F.count(F.lit(1)).alias("_n"))
        # equal values stand in one partition, so this needs no exchange of its own
        counts = counts.repartitionByRange(tasks, *keys, value).groupBy(*keys, value).agg(F.sum("_n").alias("_n"))
    else:
        counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*keys, value)
    placed = cut_lineage(counts.withColumn("_part", F.spark_partition_id()))
    key = F.struct(*keys)
    ends = placed.groupBy("_part").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("k")).distinct().select("k.*")
    totals = placed.join(F.broadcast(ends), keys, "left_semi").groupBy(*keys, "_part").agg(F.sum("_n").alias("_t"))
    ordered = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_part", F.sum("_t").over(ordered).alias("_before"), F.sum("_t").over(Window.partitionBy(*keys)).alias("_whole")
    )
    here = Window.partitionBy(*keys, "_part")
    ranked = deal(placed, tasks, *keys, "_part").withColumns({
        "_hi": F.sum("_n").over(here.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_size": F.sum("_n").over(here),
    })
    ranked = ranked.join(F.broadcast(offsets), [*keys, "_part"], "left").withColumns({
        "_hi": F.col("_hi") + F.coalesce("_before", F.lit(0)), "_size": F.coalesce("_whole", "_size"),
    })
    low, high = F.col("_hi") - F.col("_n"), F.col("_hi") - 1
    wanted = {
        f"_{side}_{name}": (lambda at: (low <= at) & (at <= high))(f((F.col("_size") - 1) * p))
        for name, p in probs.items()
        for side, f in (("lo", F.floor), ("up", F.ceil))
    }
    if tasks:
        ranked = deal(ranked.where(reduce(or_, wanted.values())), tasks, *keys)
    out = ranked.groupBy(*keys).agg(
        F.max("_size").alias("_size"), *[F.max(F.when(c, F.col(value))).alias(name) for name, c in wanted.items()]
    )
    pos = {name: (F.col("_size") - 1) * F.lit(p) for name, p in probs.items()}
    return out.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}")
                + (F.col(f"_up_{n}") - F.col(f"_lo_{n}")) * (pos[n] - F.floor(pos[n]))
            ).alias(n)
            for n in probs
        ],
    )
