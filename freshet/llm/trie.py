"""Prefix trie of whole conversations, built from collapsed sequences.

A task reads its conversations turn by turn, in order, and names every prefix by a running 128-bit
digest, so a conversation of any length needs the memory of one batch.  Conversations with equal
last digests are one sequence with a weight and a list of ends; only the least conversation of each
sequence goes on.  Sequences whose digest is a proper prefix of another are dropped by an anti-join
and what remains are the leaves.  All numbers of a node are sums or minima over the weighted
prefixes, which combine before the shuffle: neither a third of all conversations being copies nor
a first turn that all of them share puts many rows into one task.

Saved tokens need each node once, though many sequences pass through it.  A node belongs to the
least conversation below it; going down a sequence, once a node is its own all later ones are.  So
what a sequence adds below a node, counted once, is the smaller of the bytes that follow on it and of the
bytes of its own nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Name of the prefix without turns.
ROOT = bytes(16)
#: Ends of one block; blocks are put in order and digested as a stream.
BLOCK = 512

_PREFIX = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()),
    ("before", pa.int64()), ("last", pa.bool_()),
])
_PREFIX_SQL = "conv_id long, depth long, key binary, parent binary, bytes long, before long, last boolean"


def in_order(rows: DataFrame) -> DataFrame:
    """``conv_id, place, mark, bytes`` of every turn: its number from 1, a digest of role and text, the text's bytes.

    ``rows`` has conv_id, turn, role, text.  Turns are ordered by number, null first; equal numbers by role, then by
    digest.  Null roles and texts are empty.  Rows without conv_id are left out, repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text), 256)).alias("mark"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "mark")
    return marked.select("conv_id", F.row_number().over(by).cast("long").alias("place"), "mark", "bytes")


def shared_turns(conv_id: Column) -> Column:
    """h: how many turns a rebuilt conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % 5 before its own turns after the h-th.

    Returns the turns and the ids (a conversation may lose all its turns).  ``%`` has the sign of c, as in SQL.
    """
    ids = written(turns.select("conv_id").distinct(), "ids")
    taken = ids.select(
        F.col("conv_id").alias("to"), (F.col("conv_id") - F.col("conv_id") % 5).alias("conv_id"), shared_turns(F.col("conv_id")).alias("h")
    )
    first = turns.where("place <= 8").join(taken, "conv_id").where("place <= h")
    own = turns.where(F.col("place") > shared_turns(F.col("conv_id")))
    return first.select(F.col("to").alias("conv_id"), "place", "mark", "bytes").unionByName(own), ids


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations that arrive in order; the newest row waits until it is known to be the last or not."""
    held, depth, key, before = None, 0, ROOT, 0
    for batch in batches:
        out = []
        for conv, mark, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    out.append((*held, True))
                depth, key, before = 0, ROOT, 0
            else:
                out.append((*held, False))
            # a turn without a mark stands for the empty beginning
            if mark is None:
                held = (conv, 0, ROOT, None, 0, 0)
                continue
            parent, depth = key, depth + 1
            key = blake2b(parent + mark, digest_size=16).digest()
            held = (conv, depth, key, parent, size, before)
            before += size
        yield _rows(out)
    if held is not None:
        yield _rows([(*held, True)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PREFIX)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PREFIX, strict=True)], schema=_PREFIX)


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one included; ``last`` marks whole conversations."""
    begin = ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("bytes"))
    rows = begin.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.select("conv_id", "mark", "bytes").mapInArrow(_chain, _PREFIX_SQL)


def end_lists(whole: DataFrame) -> DataFrame:
    """``key, block, ends``: the ids that end at a node, ascending and joined by commas, in blocks in order."""
    blocks = whole.groupBy("key", F.floor(F.col("conv_id") / BLOCK).alias("block"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    return blocks.agg(F.array_join(ids, ",").alias("ends"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        keys, digests = [], []
        for own, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own == key:
                state.update(b",")
            else:
                if key is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = own, sha256()
            state.update(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def end_digests(whole: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the end lists of each node digested block after block, never held whole."""
    rows = end_lists(whole).repartition("key").sortWithinPartitions("key", "block").select("key", "ends")
    return rows.mapInArrow(_digest, "key binary, ends_sha256 string")


def sequences(found: DataFrame) -> DataFrame:
    """``key, conv_id, weight, length, total, leaf``: distinct whole conversations from written prefixes."""
    whole = found.where("last").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("depth").alias("length"),
        F.first(F.col("before") + F.col("bytes")).alias("total"),
    )
    whole = written(whole, "sequences")
    inner = found.where("not last").join(whole.select("conv_id"), "conv_id", "left_semi").select("key").distinct()
    leaves = whole.join(inner, "key", "left_anti").select("key", F.lit(True).alias("leaf"))
    return whole.join(leaves, "key", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``ids`` with the ordered ``turns``.

    Returns ``key, parent_key`` (128-bit digests), ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``; see ``sequences`` and ``end_lists`` for the ends themselves.  Without
    conversations there is no node.  A conversation passes through a task as a stream, however long.
    """
    found = written(prefixes(turns, ids), "prefixes")
    whole = sequences(found)
    paths = found.drop("last").join(whole.drop("key"), "conv_id")
    paths = written(paths.withColumn("rest", F.col("total") - F.col("before")), "paths")
    nodes = paths.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent_key"),
        F.first("bytes").alias("bytes"), F.sum("weight").alias("n_convs"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.col("weight") * F.col("rest")).alias("held"),
    )
    nodes = written(nodes, "nodes")
    own = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("own"))
    once = paths.join(own, "conv_id").groupBy("key").agg(F.sum(F.least("rest", "own")).alias("once"))
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    no_ends = sha256().hexdigest()
    return (
        nodes.join(once, "key").join(children, "key", "left").join(end_digests(found.where("last")), "key", "left")
        .join(parents, "parent_key", "left")
        .select(
            "key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
            (F.col("held") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(no_ends)).alias("ends_sha256"),
        )
    )
