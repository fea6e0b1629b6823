"""Embedding near-duplicates: exact threshold pairs by a dual traversal of cover trees.

On the unit sphere a cosine of at least c is a distance of at most sqrt(2 - 2c).  A tree of
nested levels, each with half the radius of the one above, is grown over a bounded sample
(``SAMPLE`` vectors, the least by hash); every vector then goes to its nearest leaf centre and the
covering radius of each leaf is the largest distance over all vectors.  Leaves in tree order are
dealt out as blocks of about ``BLOCK`` rows.  Two nodes whose centres are farther apart than both
radii and the threshold together hold no pair and are pruned, with all below them; this is done
for blocks before anything is shuffled and once more inside each task, where a tree over the
block's own rows is traversed against the other's.  What remains is multiplied in single
precision with a margin, and decided in double precision.

Tasks return degrees and spanning forests, so a group of thousands of copies costs rows in
proportion to its size.  Equal vectors are one class with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .graph import components
from .near_dedup import Forest, runs
from .vectors import matrix, one_per_id, widened

#: Vectors that the shared tree is grown on, and the most leaves it gets.
SAMPLE, LEAVES = 4096, 512
#: Rows of a block, and rows of a node below which the traversal multiplies.
BLOCK, BRUTE = 8192, 512
#: A block's number is its group times PARTS plus its place there; a task's number holds two of BITS bits.
PARTS, BITS = 1 << 20, 31

_OUT = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit rows, never too small by more than the slack added in ``prunable``."""
    x, y = widened(x, y)
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def grow(x: np.ndarray, leaves: int) -> np.ndarray:
    """Rows chosen as leaf centres, in tree order.

    Level by level the radius is halved; each level keeps the centres above it and adds rows
    that none of them covers.  A new centre hangs below its nearest older one, and the order is
    that of a walk through the tree.
    """
    centres, parent, reach = [0], [-1], distances(x, x[:1])[:, 0]
    near = np.zeros(len(x), int)
    radius = 2.0
    while len(centres) < min(leaves, len(x)) and reach.max() > 1e-6:
        far = int(reach.argmax())
        while radius > 1e-6 and reach[far] <= radius:
            radius /= 2
        parent.append(int(near[far]))
        centres.append(far)
        own = distances(x, x[far : far + 1])[:, 0]
        closer = own < reach
        near[closer], reach = len(centres) - 1, np.where(closer, own, reach)
    below: dict[int, list[int]] = {}
    for i, p in enumerate(parent):
        below.setdefault(p, []).append(i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += reversed(below.get(i, []))
    return np.array(centres)[order]


class Node:
    """A node of a local tree: rows, centre, covering radius and, if it is large, its children."""

    __slots__ = ("rows", "centre", "radius", "children")

    def __init__(self, x: np.ndarray, rows: np.ndarray, radius: float):
        self.rows = rows
        own = x[rows]
        middle = own.mean(axis=0)
        self.centre = own[int((own @ middle).argmax())]
        away = distances(own, self.centre[None])[:, 0]
        self.radius = float(away.max())
        self.children: list[Node] = []
        while len(rows) > BRUTE and radius > 0.05 and self.radius <= radius:
            radius /= 2
        if len(rows) > BRUTE and radius > 0.05:
            picked = grow(own, 8)
            to = distances(own, own[picked]).argmin(axis=1)
            parts = [rows[to == i] for i in range(len(picked))]
            parts = [p for p in parts if len(p)]
            if len(parts) > 1:
                self.children = [Node(x, p, radius / 2) for p in parts]


def prunable(gap: np.ndarray | float, radii: np.ndarray | float, reach: float):
    return gap > radii + reach + 1e-6


def dual(a: Node, b: Node, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row sets that may hold a pair; each pair of nodes once when a is b."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if p is not q:
            gap = float(np.sqrt(max(0.0, 2.0 - 2.0 * float(p.centre @ q.centre))))
            if prunable(gap, p.radius + q.radius, reach):
                continue
        if p is q and p.children:
            own = p.children
            stack += [(own[i], own[j]) for i in range(len(own)) for j in range(i, len(own))]
        elif p is not q and p.children and (len(p.rows) >= len(q.rows) or not q.children):
            stack += [(c, q) for c in p.children]
        elif p is not q and q.children:
            stack += [(p, c) for c in q.children]
        else:
            yield p.rows, q.rows


def _pairs_of(task: int, ids, blocks, copies, x, threshold):
    """Links within one block or between the two blocks of a task: forest and degrees."""
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
    names = np.unique(blocks)
    if len(names) < 2 and task >> BITS != task & (1 << BITS) - 1:
        return forest, links
    trees = [Node(x, np.flatnonzero(blocks == n), 2.0) for n in names]
    margin = np.float32(threshold - 1e-5 - 1e-7 * x.shape[1])
    small = x.astype(np.float32)
    for rows, others in dual(trees[0], trees[-1], reach):
        same = rows is others
        for start in range(0, len(rows), 1024):
            part = rows[start : start + 1024]
            i, j = np.nonzero(small[part] @ small[others].T >= margin)
            i, j = part[i], others[j]
            if same:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            for cut in range(0, len(i), 65536):
                u, v = i[cut : cut + 65536], j[cut : cut + 65536]
                sure = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                u, v = u[sure], v[sure]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                fresh = np.flatnonzero(forest.roots(u) != forest.roots(v))
                for k in fresh:
                    forest.link(u[k], v[k])
    return forest, links


def _traverse(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tasks, table in runs(batches, 1):
            cuts = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(a, b - a)
                ids, copies = part.column("vec_id").to_numpy(), part.column("copies").to_numpy()
                x = units(matrix(part.column("embedding")))
                forest, links = _pairs_of(int(tasks[a]), ids, part.column("block").to_numpy(), copies, x, threshold)
                edges = np.array(forest.edges, np.int64).reshape(-1, 2)
                some = np.flatnonzero(links)
                u = np.r_[ids[edges[:, 0]], ids[some]]
                v = np.r_[ids[edges[:, 1]], ids[some]]
                count = np.r_[np.zeros(len(edges), np.int64), links[some]]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(count)], schema=_OUT)

    return run


def _assign(centres: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("leaf", pa.int32()), ("away", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = distances(units(matrix(batch.column(1), centres.shape[1])), centres)
                leaf = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(leaf, pa.int32()), pa.array(gap[np.arange(len(leaf)), leaf])],
                    schema=schema,
                )

    return run


def _groups(leaves: list, centres: np.ndarray, reach: float) -> tuple[list, list]:
    """Leaves packed, in tree order, to groups of a block or more; group pairs that aren't pruned.

    Returns rows (leaf, group, blocks of the group) and (group, other, blocks of the other).  Both are
    bounded by ``LEAVES``, whatever the number of vectors.
    """
    group, held, owner, total = 0, 0, [], {}
    for _, count, _ in leaves:
        if held and held + count > BLOCK:
            group, held = group + 1, 0
        held += count
        owner.append(group)
        total[group] = held
    parts = {g: -(-n // BLOCK) for g, n in total.items()}
    where, radius, owner = np.array([x[0] for x in leaves]), np.array([x[2] for x in leaves]), np.array(owner)
    gap = distances(centres[where], centres[where])
    free = ~prunable(gap, radius[:, None] + radius[None, :], reach) | np.eye(len(leaves), dtype=bool)
    pairs = [
        (p, q, parts[q]) for p in total for q in total if free[np.ix_(owner == p, owner == q)].any()
    ]
    return [(int(w), int(g), parts[int(g)]) for w, g in zip(where, owner, strict=True)], pairs


def threshold_links(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every id of ``rows`` (vec_id, embedding, ...).

    Two vectors are linked when the cosine of their directions, in double precision, is at least
    ``threshold``.  Null, empty or zero vectors and those with null or non-finite components link
    with nothing.  Of rows that repeat an id the least usable vector counts; rows without an id
    are left out; a shorter vector counts as filled up with zeros.  Other columns are ignored.
    """
    spark: SparkSession = rows.sparkSession
    every = written(one_per_id(rows), "vectors")
    whole = every.where(F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False)))
    classes = written(
        whole.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()
    if not sample.num_rows:
        return every.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    x = units(matrix(sample.column(0), width))
    centres = x[grow(x, LEAVES)]
    leaf_of = written(
        classes.select("rep", "embedding").mapInArrow(_assign(centres), "vec_id long, leaf int, away double"), "leaves"
    )
    leaves = leaf_of.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).orderBy("leaf").collect()
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    groups, pairs = _groups([(r.leaf, r.n, r.r) for r in leaves], centres, reach)
    places = spark.createDataFrame(groups, "leaf int, p long, parts long")
    partners = spark.createDataFrame(pairs, "p long, q long, others long")
    placed = leaf_of.join(F.broadcast(places), "leaf").select(
        F.col("vec_id").alias("rep"), "p",
        (F.col("p") * PARTS + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"),
    )
    # a row of block i of p goes to the task of every block j of the groups that p isn't pruned against
    other = F.explode(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda j: F.col("q") * PARTS + j)
    )
    dealt = placed.join(classes, "rep").join(F.broadcast(partners), "p").select(
        other.alias("other"), F.col("rep").alias("vec_id"), "block", "copies", "embedding"
    )
    task = F.shiftleft(F.least("block", "other"), BITS) + F.greatest("block", "other")
    tasks = sum(n for _, _, n in pairs)
    dealt = dealt.withColumn("task", task).drop("other")
    dealt = dealt.repartition(max(1, min(tasks, 4096)), "task").sortWithinPartitions("task")
    found = written(dealt.mapInArrow(_traverse(threshold), "u long, v long, links long"), "links")
    degrees = found.where("links > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(degrees, "rep", "left").select(
        "rep", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    members = whole.join(named, "embedding").select("vec_id", "rep", "n_links")
    edges = found.where("links = 0").select("u", "v").unionByName(
        members.where("vec_id != rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    )
    grouped = components(edges)
    out = every.select("vec_id").join(members.select("vec_id", "n_links"), "vec_id", "left")
    out = out.join(grouped, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (component == F.col("vec_id")).alias("kept"),
    )
