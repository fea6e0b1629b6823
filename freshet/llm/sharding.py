"""Shards by extendible hashing.

A row's place is the leading bits of the MD5 of its id.  The directory starts with one bucket;
only buckets beyond the byte limit split on one more bit.  Sums are taken over cells of
``STEP`` bits, so one pass decides ``STEP`` levels of the directory at once; only cells that are
still too large go on to the next bits.  Rows of one id that alone exceed the limit are split by a
directory of their own, on the MD5 of a number that each of them gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Levels decided in one pass, and the most bits: the 60 that a long holds.
STEP, BITS = 12, 60
ADDED = ("depth", "prefix", "part", "shard_bytes", "part_bytes")


def place(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(c: str, bits) -> Column:
    return F.expr(f"shiftright({c}, {BITS} - {bits})")


def directory(sized: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``depth, prefix, shard_rows, shard_bytes`` of the final buckets of ``place, bytes`` rows.

    With columns ``by`` every value of these has a directory of its own.

    A bucket splits while it is too large and holds more than one place.  Places are summed
    first, so a place with very many rows is one row from then on.
    """
    left = cut(sized.groupBy(*by, "place").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")))
    done, low = None, 0
    while low < BITS:
        high = min(low + STEP, BITS)
        first = low + 1 if low else 0
        cells = left.groupBy(*by, prefix("place", high).alias("cell")).agg(
            F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("place").alias("a"), F.max("place").alias("z")
        )
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(high)))).withColumn(
            "prefix", F.expr(f"shiftright(cell, {high} - depth)")
        )
        buckets = levels.groupBy(*by, "depth", "prefix").agg(
            F.sum("n").alias("shard_rows"), F.sum("bytes").alias("shard_bytes"), (F.min("a") == F.max("z")).alias("one")
        )
        fits = (F.col("shard_bytes") <= limit) | F.col("one") | (F.col("depth") == BITS)
        # of the buckets that need no split, those whose parent (one bit less) is split
        whole = buckets.where(fits)
        split = buckets.where(~fits).select(*by, (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        new = whole.withColumn("above", F.expr("shiftright(prefix, 1)")).join(split, [*by, "depth", "above"], "left_semi")
        if first == 0:
            new = new.unionByName(whole.where("depth = 0").withColumn("above", F.lit(0).cast("long")))
        else:
            # every cell that came here was split at the level before
            new = new.unionByName(whole.where(F.col("depth") == first).withColumn("above", F.expr("shiftright(prefix, 1)")))
        new = new.select(*by, "depth", "prefix", "shard_rows", "shard_bytes")
        done = cut(new.distinct() if done is None else done.unionByName(new).distinct())
        open_ = buckets.where(~fits & (F.col("depth") == high)).select(*by, F.col("prefix").alias("cell"))
        left = cut(left.withColumn("cell", prefix("place", high)).join(open_, [*by, "cell"], "left_semi").drop("cell"))
        if not left.limit(1).count():
            break
        low = high
    return done


def shards(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``rows`` with ``depth``, ``prefix``, ``part``, ``shard_bytes`` and ``part_bytes``: each row's shard.

    Columns that ``rows`` has under these names are replaced.

    ``size`` gives a row's bytes (null counts 0).  Shards hold at most ``limit`` bytes, but for a single
    row that is larger by itself.  Rows of one key cannot be told apart by their hash: where they
    alone exceed the limit they get numbers and are split further by the hash of these.  ``part`` is
    then 2^bits + leading bits of that hash, else 0; ``part_bytes`` is what the part holds, and
    ``shard_bytes`` what all parts of the bucket hold.  Every row, also with a null key, gets a
    shard; other columns stay.
    """
    own = [c for c in rows.columns if c not in ADDED]
    sized = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), place(F.col(key)).alias("place"),
        F.coalesce(size, F.lit(0)).cast("long").alias("bytes"),
    )
    found = directory(sized.select("place", "bytes"), limit)
    depths = [r.depth for r in found.select("depth").distinct().orderBy("depth").collect()]
    # a row meets the directory at every depth in use, at most BITS; just one of these is a bucket
    places = sized.select("place").distinct().withColumn("at", F.explode(_tried("place", depths)))
    mine = places.select("place", "at.depth", "at.prefix").join(found, ["depth", "prefix"])
    out = sized.join(mine, "place")
    # only a shard of one key can still be over the limit with several rows
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    whole = out.withColumn("part", F.lit(0).cast("long")).withColumn("part_bytes", F.col("shard_bytes"))
    if not found.where(over).limit(1).count():
        return whole.select("row.*", *ADDED)
    # stored, so that a repeated task cannot number its rows anew
    hot = written(out.where(over).withColumn("n", F.monotonically_increasing_id()), "hot")
    salted = hot.select("n", F.col("place").alias("key"), place(F.col("n")).alias("place"), "bytes")
    split = directory(salted.select("key", "place", "bytes"), limit, ("key",)).select(
        "key", "depth", "prefix", F.col("shard_bytes").alias("part_bytes")
    )
    deep = [r.depth for r in split.select("depth").distinct().orderBy("depth").collect()]
    parts = salted.select("n", "key", F.explode(_tried("place", deep)).alias("at")).select("n", "key", "at.depth", "at.prefix")
    parts = parts.join(split, ["key", "depth", "prefix"]).select(
        "n", F.expr("shiftleft(1L, cast(depth as int)) + prefix").alias("part"), "part_bytes"
    )
    dealt = hot.join(parts, "n")
    return whole.where(~over).select("row.*", *ADDED).unionByName(dealt.select("row.*", *ADDED))


def _tried(c: str, depths: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("depth"), prefix(c, d).alias("prefix")) for d in depths or [0]])
