"""MinHash near-duplicates by a multi-index Hamming join.

Every text gets a signature of ``K`` coordinates, 16 bits of a MinHash each.  The first
``INDEXED`` coordinates are cut into chunks of ``CHUNK``; two signatures that differ in at most
``DISTANCE`` of them must, by the pigeonhole principle, differ in at most one coordinate of
some chunk (10 chunks x 2 differences > 19).  So each chunk is indexed once for every allowed
error position, by the coordinates that remain: every pair within the distance meets in at
least one bucket.  At a similarity of 0.75 a pair lies beyond that distance with probability 2e-6.

Pairs that meet are held against the whole signature and against the ratio of their set sizes,
inside the task; what passes joins texts to loose groups.  Within a group the full shingle sets
are compared.  Tasks return spanning forests, never all pairs of a group: a link is left out only
where its two texts are already joined by others, so components lose nothing.  Groups beyond
``BLOCK`` rows are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import text_batches, written
from .graph import components

K = 64
INDEXED = 30
CHUNK = 3
DISTANCE = 19
#: Differences allowed over all K coordinates; missed at similarity 0.75 with probability 3e-8.
CONFIRM = 36
BLOCK = 512

_SIGNED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.binary()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sig", pa.binary()),
])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = sh.permutations(K)
    for batch in batches:
        sizes, keys, sigs = [], [], []
        for text in batch.column(3):
            found = sh.words(text.as_py())
            own = sh.shingle_set(found)
            sizes.append(len(own))
            keys.append(sh.class_key(found) if found else None)
            sigs.append(sh.signature(own, a, b).tobytes() if found else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
            schema=_SIGNED,
        )


def text_mark() -> Column:
    """A digest of the text as it stands; null without text."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """``row, doc_id, mark, n_shingles, cls, sig`` of every row; ``cls`` and ``sig`` are null without words.

    ``row`` numbers the rows; write the table before it is used, so that the numbers stay.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_mark().alias("mark"), F.col("text").cast("string")
    )
    return rows.mapInArrow(_sign, "row long, doc_id long, mark binary, n_shingles long, cls binary, sig binary")


def index_keys(sig: Column) -> Column:
    """The bucket keys of a signature: per chunk, the coordinates left when one is given up."""
    keys = []
    for chunk in range(0, INDEXED, CHUNK):
        for skip in range(CHUNK):
            kept = [chunk + i for i in range(CHUNK) if i != skip]
            parts = [F.substring(sig, 2 * i + 1, 2) for i in kept]
            keys.append(F.xxhash64(F.lit(chunk), F.lit(skip), F.concat(*parts)))
    return F.array(*keys)


def in_blocks(rows: DataFrame, group: str, size: Column, by: str) -> DataFrame:
    """Deal groups beyond ``BLOCK`` rows out as pairs of blocks, in the column ``task``.

    A group of one block stays one task; with n blocks a row goes to the n tasks of its own.
    """
    blocks = F.ceil(size / BLOCK).cast("int")
    rows = rows.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(F.col(by)), F.col("_n")).cast("int"))
    task = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda j: F.xxhash64(F.col(group), F.least("_b", j), F.greatest("_b", j)),
    )
    return rows.withColumn("task", F.explode(task)).drop("_n", "_b")


def runs(batches: Iterator[pa.RecordBatch], most: int = 16384, most_bytes: int = 1 << 25) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Whole runs of equal ``task`` from rows sorted by it, many small runs at a time."""
    kept: list[pa.RecordBatch] = []
    held = size = 0

    def ready(table: pa.Table, whole: bool) -> tuple[pa.Table, pa.Table]:
        tasks = table.column("task").to_numpy()
        at = len(tasks) if whole else int(np.searchsorted(tasks, tasks[-1], "left"))
        return table.slice(0, at), table.slice(at)

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            held, size = held + batch.num_rows, size + batch.nbytes
        if held >= most or size >= most_bytes:
            table, rest = ready(pa.Table.from_batches(kept), False)
            if len(table):
                yield table.column("task").to_numpy(), table
            kept, held = rest.combine_chunks().to_batches(), 0
            size = 0
    if kept:
        table = pa.Table.from_batches(kept)
        yield table.column("task").to_numpy(), table


class Forest:
    """Union-find over rows; remembers the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        out = self.up[rows]
        while True:
            above = self.up[out]
            if (above == out).all():
                return out
            out = above


def _bounds(tasks: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1], True])
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]


def _near(sig: np.ndarray, size: np.ndarray, x: int, rest: np.ndarray) -> np.ndarray:
    """Of the rows ``rest`` those whose signature and set size allow a similarity of 0.75 with row x."""
    low, high = np.minimum(size[x], size[rest]), np.maximum(size[x], size[rest])
    rest = rest[100 * low >= 75 * high]
    return rest[(sig[rest] != sig[x]).sum(axis=1) <= CONFIRM]


def _emit(forest: Forest, ids: np.ndarray) -> pa.RecordBatch:
    pairs = np.array(forest.edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], schema=_EDGES)


def _table(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = table.column("rep").to_numpy()
    size = table.column("n_shingles").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, K)
    return ids, size, sig


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: a spanning forest of the pairs that their signatures allow."""
    for tasks, table in runs(batches):
        ids, size, sig = _table(table)
        # the same two texts meet in many buckets: one tree over all of this slice's buckets
        whole, row = np.unique(ids, return_inverse=True)
        forest = Forest(len(whole))
        bounds = _bounds(tasks)
        two = np.array([a for a, b in bounds if b - a == 2], np.int64)
        if len(two):
            low = np.minimum(size[two], size[two + 1])
            high = np.maximum(size[two], size[two + 1])
            near = (100 * low >= 75 * high) & ((sig[two] != sig[two + 1]).sum(axis=1) <= CONFIRM)
            for x in two[near]:
                forest.link(row[x], row[x + 1])
        for a, b in bounds:
            if b - a > 2:
                for x in range(a, b - 1):
                    rest = np.arange(x + 1, b)
                    rest = rest[forest.roots(row[rest]) != forest.find(row[x])]
                    for y in _near(sig, size, x, rest) if len(rest) else ():
                        forest.link(row[x], row[y])
        yield _emit(forest, whole)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per loose group: a spanning forest of the links, each confirmed on full shingle sets."""
    for tasks, table in runs(batches, 2 * BLOCK):
        ids, size, sig = _table(table)
        texts = table.column("text")
        forest = Forest(len(ids))
        for a, b in _bounds(tasks):
            sets = [sh.shingle_set(sh.words(texts[i].as_py())) for i in range(a, b)]
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            full = [len(s) for s in sets]
            ends = np.cumsum(full)
            own = np.split(flat, ends[:-1])
            mark = np.zeros(len(names), bool)
            for x in range(a, b - 1):
                rest = np.arange(x + 1, b)
                rest = rest[forest.roots(rest) != forest.find(x)]
                rest = _near(sig, size, x, rest) if len(rest) else rest
                if not len(rest):
                    continue
                mark[own[x - a]] = True
                for y in rest:
                    both = int(mark[own[y - a]].sum())
                    if 100 * both >= 75 * (full[x - a] + full[y - a] - both) > 0:
                        forest.link(x, y)
                mark[own[x - a]] = False
        yield _emit(forest, ids)


def classes(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``cls, component, first_id`` from the written signatures of ``docs``: texts of equal words are one class.

    Classes are compared and linked by their own number, never by doc_id: ids may be null or shared by other texts.
    ``component`` names what links connect, ``first_id`` is the least doc_id of a class.
    """
    reps = signed.where("cls is not null").groupBy("cls").agg(
        F.min("row").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
        F.min_by("mark", "row").alias("mark"), F.min("doc_id").alias("first_id"),
    )
    keys = reps.select("rep", F.explode(index_keys(F.col("sig"))).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = in_blocks(keys.join(shared, "key"), "key", F.col("n"), "rep").select("task", "rep")
    hits = hits.join(reps.select("rep", "n_shingles", "sig"), "rep").repartition("task").sortWithinPartitions("task")
    loose = components(hits.select("task", "rep", "n_shingles", "sig").mapInArrow(_meet, "u long, v long"))

    members = reps.join(loose, F.col("rep") == F.col("node")).select("mark", "rep", "n_shingles", "sig", "component")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = in_blocks(members.join(sizes, "component"), "component", F.col("n"), "rep").drop("component", "n")
    # one text of each class, whatever its copies and their ids
    texts = docs.where("text is not null").select(text_mark().alias("mark"), F.col("text").cast("string").alias("text"))
    texts = texts.groupBy("mark").agg(F.first("text").alias("text"))
    asked = members.join(texts, "mark").select("task", "rep", "n_shingles", "sig", "text")
    asked = asked.repartition("task").sortWithinPartitions("task")
    found = components(asked.mapInArrow(_confirm, "u long, v long"))
    return reps.join(found, F.col("rep") == F.col("node"), "left").select(
        "cls", F.coalesce("component", "rep").alias("component"), "first_id"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text, ...).

    Linked are texts whose distinct 5-word shingles have a Jaccard similarity of at least 0.75.
    Null or wordless texts have no shingle and no link.  Texts of equal words form a class that is
    compared once.  ``component_id`` is the least doc_id of all texts that links connect with the row's own text; other
    texts under the same doc_id have their own.  It is null where no such row has a doc_id; of rows without doc_id
    only those are kept.  Rows that repeat a doc_id are returned each.  Other columns are ignored.
    """
    signed = written(signatures(docs), "signatures")
    found = written(classes(docs, signed), "classes")
    least = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = found.join(least, "component").select("cls", "component_id")
    out = signed.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.equal_null("doc_id", component).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with its columns as they are; wordless rows stay all.

    Of a group the row of the least doc_id stays, an id before none, then that of the least text digest; of rows that
    are equal in both one stays.
    """
    signed = written(signatures(docs), "signatures")
    found = classes(docs, signed).select("cls", "component")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    kept = signed.join(found, "cls").groupBy("component").agg(F.min(place).alias("p")).select("p.id", "p.mark")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_id"), text_mark().alias("_mark"))
    has_words = F.coalesce(F.col("_row.text").cast("string").rlike("[^ \\x09-\\x0D]"), F.lit(False))
    named = rows.where(has_words).join(kept, (F.col("_mark") == F.col("mark")) & F.col("_id").eqNullSafe(F.col("id")), "left_semi")
    named = named.groupBy("_id", "_mark").agg(F.first("_row").alias("_row"))
    return named.select("_row.*").unionByName(rows.where(~has_words).select("_row.*"))
