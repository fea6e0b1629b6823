"""Best-fit packing of token sequences by a grouping genetic algorithm.

Whole texts are tokenized once; the pieces with their ids are kept as a table.  The search below sees
items and lengths alone, and the ids join its result at the end.
Pieces of full length are sequences of their own.  The others are dealt out to shards of about
``SHARD`` pieces; on every shard several islands evolve packings.  A crossover injects well-filled
bins of one parent into another, removes the bins that hold an injected piece, and best-fits the
pieces this displaces, the longest first.  After each epoch every island of a shard receives the
best packing of its neighbour.  The best packing's bins filled to ``FULL`` or more are final; the
pieces of the others go to the next round, on fewer shards, until one shard is left or a round
brings no more.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, written

LIMIT = 2048
END = 0
#: Pieces of a shard, islands on it, epochs with a migration after each, crossovers of an epoch.
SHARD, ISLANDS, EPOCHS, CROSSOVERS = 2048, 2, 2, 12
POPULATION = 4
FULL = 0.995

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())),
    ]
)
#: Ids in one batch of pieces, but for those of a single longer text.
IDS = 1 << 20
#: Texts of these characters are split alike by both libraries of the same vocabulary.
_COMMON = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")


@lru_cache(maxsize=4)
def tokenizer(path: str, special_as_text: bool = True):
    """The library's tokenizer.

    By default the strings of special tokens are ordinary text, the use that the vocabularies' README gives, so no document
    can write a control token; otherwise the library's own default holds and such a string becomes its token.
    """
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    if special_as_text:
        found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def special(path: str) -> tuple[str, ...]:
    """The strings of special tokens, which ranks do not know."""
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def ranks(path: str):
    """The same vocabulary as ranks, several times as fast for common characters."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str, path: str, rank_path: str | None, special_as_text: bool = True) -> np.ndarray:
    """The text's ids and the end mark; a lone surrogate counts as a question mark."""
    known = special_as_text or not any(t in text for t in special(path))
    if rank_path and known and not _COMMON.search(text):
        ids = ranks(rank_path).encode_ordinary(text)
    else:
        ids = tokenizer(path, special_as_text).encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
    return np.array([*ids, END], "<u4")


def pieces(docs: DataFrame, path: str, rank_path: str | None = None, limit: int = LIMIT, special_as_text: bool = True) -> DataFrame:
    """Cut documents longer than ``limit``; only the first piece of one may be shorter.

    ``ids`` holds a piece's tokens, the last piece's with the end mark.
    """
    text_batches(docs.sparkSession)

    def made(out: list[list], ids: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=False)]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            parts: list[np.ndarray] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "", path, rank_path, special_as_text)
                if held and held + len(ids) > IDS:
                    yield made(out, parts)
                    out, parts, held = [[], [], [], [], []], [], 0
                held += len(ids)
                first = len(ids) % limit or limit
                for n, start in enumerate([0, *range(first, len(ids), limit)]):
                    part = ids[start : first if n == 0 else start + limit]
                    parts.append(part)
                    for c, v in zip(out, (doc_id.as_py(), n, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        c.append(v)
            yield made(out, parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def digested(packed: DataFrame) -> DataFrame:
    """``packed`` with ``ids_crc32`` taken anew from ``ids``, which go."""
    text_batches(packed.sparkSession)
    names = [c for c in packed.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zlib.crc32(v.values.to_numpy().astype("<u4").tobytes()) for v in batch.column("ids")]
            columns = [pa.array(found, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return packed.mapInArrow(run, packed.drop("ids").schema)


class Packing:
    """One individual: the bin of every item and the room left in every bin."""

    __slots__ = ("bin", "room")

    def __init__(self, bin_: np.ndarray, sizes: np.ndarray, limit: int):
        names, self.bin = np.unique(bin_, return_inverse=True)
        self.room = limit - np.bincount(self.bin, sizes, minlength=len(names)).astype(np.int64)

    def fitness(self, limit: int) -> tuple[int, float]:
        fill = 1 - self.room / limit
        return -len(self.room), float((fill * fill).sum())


def best_fit(items: np.ndarray, sizes: np.ndarray, bin_: np.ndarray, room: dict[int, int], limit: int) -> None:
    """Put items, in the order given, each into the bin with the least room that takes it."""
    space = sorted((r, b) for b, r in room.items() if r > 0)
    fresh = max(room, default=-1) + 1
    for i in items:
        size = int(sizes[i])
        at = bisect_left(space, (size, -1))
        if at == len(space):
            left, name = limit, fresh
            fresh += 1
        else:
            left, name = space.pop(at)
        bin_[i] = name
        if left > size:
            insort(space, (left - size, name))


def falling(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return items[np.argsort(-sizes[items], kind="stable")]


def first_packing(sizes: np.ndarray, limit: int, random: np.random.Generator, noise: float) -> Packing:
    """Best fit in falling order of size; ``noise`` disturbs the order so that individuals differ."""
    bin_ = np.empty(len(sizes), np.int64)
    order = falling(np.arange(len(sizes)), sizes * (1 + noise * random.random(len(sizes))))
    best_fit(order, sizes, bin_, {}, limit)
    return Packing(bin_, sizes, limit)


def crossover(to: Packing, of: Packing, sizes: np.ndarray, limit: int, random: np.random.Generator) -> Packing:
    """Inject some of the donor's fullest bins, drop the bins they overlap, best-fit what is displaced."""
    full = np.flatnonzero(of.room <= (1 - FULL) * limit)
    if not len(full):
        full = np.argsort(of.room, kind="stable")[: max(1, len(of.room) // 4)]
    chosen = np.zeros(len(of.room), bool)
    chosen[random.choice(full, max(1, len(full) // 3), replace=False)] = True
    injected = chosen[of.bin]
    broken = np.zeros(len(to.room), bool)
    broken[to.bin[injected]] = True
    # of the rest, some badly filled bins are given up as well
    poor = np.flatnonzero((to.room > (1 - FULL) * limit) & ~broken)
    if len(poor):
        broken[random.choice(poor, max(1, len(poor) // 4), replace=False)] = True
    bin_ = to.bin.copy()
    displaced = broken[to.bin] & ~injected
    bin_[injected] = len(to.room) + of.bin[injected]
    room = {int(b): int(to.room[b]) for b in np.flatnonzero(~broken)}
    room |= {len(to.room) + int(b): int(of.room[b]) for b in np.flatnonzero(chosen)}
    best_fit(falling(np.flatnonzero(displaced), sizes), sizes, bin_, room, limit)
    return Packing(bin_, sizes, limit)


def evolve(sizes: np.ndarray, limit: int, seed: int, best: np.ndarray | None, guest: np.ndarray | None) -> np.ndarray:
    """One epoch of an island: the bins of its best packing."""
    random = np.random.Generator(np.random.PCG64(seed))
    given = [Packing(b, sizes, limit) for b in (best, guest) if b is not None]
    group = given or [first_packing(sizes, limit, random, 0.0)]
    group += [first_packing(sizes, limit, random, 0.3) for _ in range(POPULATION - len(group))]
    least = -(-int(sizes.sum()) // limit)
    for _ in range(CROSSOVERS):
        group.sort(key=lambda p: p.fitness(limit), reverse=True)
        if len(group[0].room) == least:
            break
        a, b = random.choice(len(group) - 1, 2, replace=len(group) < 3) if len(group) > 1 else (0, 0)
        group[-1] = crossover(group[a], group[b if b != a else -1], sizes, limit, random)
    return max(group, key=lambda p: p.fitness(limit)).bin


def _epoch(limit: int, epoch: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        sizes = rows["length"].to_numpy()
        own = rows["bin"].to_numpy() if epoch else None
        guest = rows["guest"].to_numpy() if epoch else None
        seed = (epoch * 1009 + int(rows["island"].iloc[0])) * 1_000_003 + int(rows["shard"].iloc[0]) % 1_000_003
        found = evolve(sizes, limit, seed, own, guest)
        fill = Packing(found, sizes, limit)
        score = fill.fitness(limit)
        return rows[["shard", "island", "item", "length"]].assign(
            bin=found.astype(np.int64), room=fill.room[fill.bin], bins=len(fill.room), score=score[1]
        )

    return run


_ISLAND = "shard long, island int, item long, length long, bin long, room long, bins long, score double"


def _round(items: DataFrame, shards: int, limit: int, number: int) -> DataFrame:
    """Evolve all islands of all shards: ``shard, item, length, bin, room`` of each shard's best packing."""
    shard = F.pmod(F.xxhash64("item", F.lit(number)), F.lit(shards))
    rows = items.select(shard.alias("shard"), "item", "length")
    rows = rows.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    rows = rows.withColumn("bin", F.lit(0).cast("long")).withColumn("guest", F.lit(0).cast("long"))
    for epoch in range(EPOCHS):
        rows = written(rows.groupBy("shard", "island").applyInPandas(_epoch(limit, epoch), _ISLAND), "islands")
        if epoch < EPOCHS - 1:
            # the elite of every island visits the next one of its shard
            guests = rows.select(
                "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "item", F.col("bin").alias("guest")
            )
            rows = rows.select("shard", "island", "item", "length", "bin").join(guests, ["shard", "island", "item"])
    best = rows.groupBy("shard").agg(
        F.min(F.struct("bins", -F.col("score"), "island")).alias("best")
    ).select("shard", F.col("best.island").alias("island"))
    return rows.join(best, ["shard", "island"], "left_semi").select("shard", "item", "length", "bin", "room")


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (a ``length`` column of 1 to ``limit``).

    All columns stay.  Repeated rows and rows without a doc_id are pieces like others; an empty
    table gives an empty one.
    """
    table = written(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    done = [table.where(F.col("length") >= limit).select("item", F.col("item").alias("sequence_id"))]
    left = table.where(F.col("length") < limit).select("item", "length")
    count, number = left.count(), 0
    while count:
        shards = max(1, -(-count // SHARD))
        found = written(_round(left, shards, limit, number), "round")
        last = shards == 1
        final = F.lit(True) if last else F.col("room") <= (1 - FULL) * limit
        # a sequence is named by one of its items
        done.append(_named(found.where(final)))
        left = found.where(~final).select("item", "length")
        before, count, number = count, left.count(), number + 1
        if count > 0.9 * before:
            done.append(_named(found.where(~final)))
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    placed = written(every.join(table.select("item", "length"), "item"), "placed")
    inside = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("held"))
    offsets = inside.select("sequence_id", F.explode(_offsets()).alias("at")).select(
        F.col("at.item").alias("item"), "sequence_id", F.col("at.offset").alias("offset")
    )
    return table.join(offsets, "item").drop("item")


def _named(rows: DataFrame) -> DataFrame:
    names = rows.groupBy("shard", "bin").agg(F.min("item").alias("sequence_id"))
    return rows.join(names, ["shard", "bin"]).select("item", "sequence_id")


def _offsets():
    """Running sums inside a sequence, which holds at most ``limit`` pieces."""
    before = lambda x, i: F.aggregate(F.slice("held", F.lit(1), i), F.lit(0).cast("long"), lambda a, h: a + h["length"])
    return F.transform("held", lambda x, i: F.struct(x["item"].alias("item"), before(x, i).alias("offset")))
