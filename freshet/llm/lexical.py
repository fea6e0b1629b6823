"""Ranked lexical search with range-maximum tables over posting lists.

The items ask in blocks whose texts together hold ``BLOCK_BYTES``; a block's vocabulary is broadcast.
One pass over all documents keeps of each its length and the block's terms in it; counts and document
frequencies are sums over that table.  Then each task cuts its documents into segments of bounded size and
searches every item of the block in each.

A segment has a posting list per term, with impacts, and a sparse table of range maxima over them: the
entry at level k tells which of 2^k successive postings has the greatest impact, so the maximum of any range is
the greater of two entries.  An item's search starts from the interval of all documents.  The bound of an interval is
the sum, over the item's terms, of the greatest impact in it.  The intervals with the highest bounds are taken first and
split at the document of the greatest single impact: that document is scored, the halves are bounded by new range
maxima.  An interval goes when its bound is below the k-th best score so far.  What a segment leaves, at most k rows an
item, is ranked over all segments.

Documents of a segment are put in order of their most frequent term, then of length, so that documents of one language
stand together and most items see few high intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, small_batches, written

#: Bytes of item texts that ask together.
BLOCK_BYTES = 1 << 23
#: Documents and postings of one segment.
SEGMENT, POSTINGS = 1 << 14, 1 << 20
#: Cells (intervals x terms) that one step of a search works on.
CELLS = 1 << 14
#: Fixed values of the score: term weights, length normalisation, saturation.
WEIGHT, SCALE, SLOPE, BASE, TF, NORM = 1000, 10**9, 75, 100, 1000, 8

#: ASCII bytes outside digits and letters part terms; A-Z become a-z; all bytes beyond ASCII belong to terms.
_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def cleaned(text: str | bytes | None) -> bytes:
    """A text whose terms are parted by spaces."""
    text = text or b""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_BYTES)


def terms(text: str | bytes | None) -> list[bytes]:
    """The maximal runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return cleaned(text).split()


_INDEX_SQL = "doc_id long, n long, terms array<int>, tfs array<int>"


def _indexed(vocabulary):
    """Per document its number of terms and, of the vocabulary's terms, which it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1):
                size, known = 0, []
                for part in slices(cleaned(text.as_py())):
                    every = part.split()
                    size += len(every)
                    known.append(np.array(list(filter(None, map(number.get, every))), np.int64))
                sizes.append(size)
                found.append(np.unique(np.concatenate(known), return_counts=True))
            ends = np.r_[0, np.cumsum([len(t) for t, _ in found])].astype(np.int32)
            flat = [np.concatenate([f[i] for f in found] or [np.empty(0)]).astype(np.int32) for i in (0, 1)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(f)) for f in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


class Segment:
    """Posting lists of some documents and their range-maximum table."""

    def __init__(self, ids: np.ndarray, named: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, impact: np.ndarray, length: np.ndarray):
        most = np.zeros(len(ids), np.int64)
        # the most frequent term of each document: the last one written wins, in order of frequency
        by = np.argsort(tf, kind="stable")
        most[owner[by]] = term[by]
        order = np.lexsort((length, most))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.named, self.size = ids[order], named[order], len(ids)
        at = place[owner]
        by = np.lexsort((at, term))
        self.key = term[by] * self.size + at[by]
        self.doc, self.impact = at[by], impact[by]
        lists = np.unique(term, return_counts=True)[1].max(initial=1)
        best = np.arange(len(by), dtype=np.int32)
        self.table = [best]
        for k in range(1, int(lists).bit_length()):
            half = 1 << (k - 1)
            if len(best) <= half:
                break
            left, right = best[:-half], best[half:]
            best = np.where(self.impact[left] >= self.impact[right], left, right)
            self.table.append(best)

    def positions(self, terms_: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each of ``docs`` (rows) and terms (columns) the first posting of the term at that document or later."""
        return np.searchsorted(self.key, terms_[None, :] * self.size + docs[:, None])

    def maxima(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weighted maxima of each row's posting ranges, and the document of the greatest one."""
        size = high - low
        best = np.full(low.shape, -1, np.int64)
        level = np.frexp(size)[1] - 1
        for k in np.unique(level[size > 0]):
            here = (level == k) & (size > 0)
            one, two = self.table[k][low[here]], self.table[k][high[here] - (1 << int(k))]
            best[here] = np.where(self.impact[one] >= self.impact[two], one, two)
        value = np.where(best >= 0, self.impact[best], 0) * weights
        top = value.argmax(axis=1)
        rows = np.arange(len(low))
        return value.sum(axis=1), np.where(value[rows, top] > 0, self.doc[best[rows, top]], -1)

    def search(self, terms_: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents with a score above 0, their scores, and how many were scored.

        Equal scores go by ascending id, documents without an id last.
        """
        step = max(1, CELLS // max(1, len(terms_)))
        begin, end = np.zeros(1, np.int64), np.full(1, self.size)
        bound, split = self.maxima(self.positions(terms_, begin), self.positions(terms_, end), weights)
        best, score, least, scored = np.empty(0, np.int64), np.empty(0, np.int64), 1, 0
        while True:
            alive = bound >= least
            begin, end, bound, split = (a[alive] for a in (begin, end, bound, split))
            if not len(bound):
                return best, score, scored
            # few at first, to raise the least score before much is split
            wide = min(step, 8 + scored)
            first = np.argpartition(-bound, wide - 1)[:wide] if len(bound) > wide else np.arange(len(bound))
            at, low, high = split[first], begin[first], end[first]
            rest = np.ones(len(bound), bool)
            rest[first] = False
            left, middle, right = (self.positions(terms_, d) for d in (low, at, high))
            inside = middle < right
            hit = inside & (self.doc[np.where(inside, middle, 0)] == at[:, None])
            points = (np.where(hit, self.impact[np.where(hit, middle, 0)], 0) * weights).sum(axis=1)
            scored += len(at)
            best, score = np.r_[best, at], np.r_[score, points]
            by = np.lexsort((self.ids[best], ~self.named[best], -score))[:k]
            best, score = best[by], score[by]
            if len(best) == k:
                least = max(1, int(score[-1]))
            below, above = self.maxima(left, middle, weights), self.maxima(middle + hit, right, weights)
            begin = np.r_[begin[rest], low, at + 1]
            end = np.r_[end[rest], at, high]
            bound = np.r_[bound[rest], below[0], above[0]]
            split = np.r_[split[rest], below[1], above[1]]


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Integer contributions of terms to documents."""
    norm = BASE - SLOPE + (SLOPE * length * docs) // max(1, total)
    return weight * ((SCALE * tf) // (TF * tf + NORM * norm))


_FOUND_SQL = "item int, doc_id long, score long"


def _search(asked, weight, docs: int, total: int, k: int, most_rows: int, most_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = weight.value, asked.value
        held: list[pa.RecordBatch] = []

        def searched() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = rows.column("terms").combine_chunks()
            term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
            length = rows.column("n").to_numpy()
            named = rows.column("doc_id").is_valid().to_numpy()
            ids = rows.column("doc_id").fill_null(0).to_numpy()
            impact = impacts(weights[term], tf, length[owner], docs, total)
            used = impact > 0
            segment = Segment(ids, named, owner[used], term[used], tf[used], impact[used], length)
            out = [[], [], []]
            for item, (numbers, times) in enumerate(items):
                if len(numbers) and len(segment.key):
                    best, score, _ = segment.search(numbers, times, k)
                    out[0].append(np.full(len(best), item))
                    out[1].append(best)
                    out[2].append(score)
            item, best, score = (np.concatenate(o or [[]]).astype(np.int64) for o in out)
            return pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(segment.ids[best], mask=~segment.named[best]), pa.array(score)], ["item", "doc_id", "score"]
            )

        rows = postings = 0
        for batch in batches:
            for start in range(0, batch.num_rows, min(1024, most_rows)):
                part = batch.slice(start, min(1024, most_rows))
                more = len(part.column("terms").flatten())
                if held and (rows + part.num_rows > most_rows or postings + more > most_postings):
                    yield searched()
                    held, rows, postings = [], 0, 0
                held.append(part)
                rows, postings = rows + part.num_rows, postings + more
        if held:
            yield searched()

    return run


def _leading(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(items: list, docs: DataFrame, k: int) -> DataFrame:
    """The k best documents of each of a block's items (item_id, text)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    asked = [terms(r.text) for r in items]
    # numbers from 1, so that what is found is true
    number = {t: i for i, t in enumerate(sorted({t for own in asked for t in own}), 1)}
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    index = written(texts.mapInArrow(_indexed(context.broadcast(number)), _INDEX_SQL), "index")
    count, total = index.agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.sum("n")).first()
    count, total = count or 0, total or 0
    frequency = np.zeros(len(number) + 1, np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        frequency[r["term"]] = r["count"]
    weight = np.array([floor(WEIGHT * log((2 * count + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    queries = [np.unique(np.array([number[t] for t in own], np.int64), return_counts=True) for own in asked]
    search = _search(context.broadcast(queries), context.broadcast(weight), count, total, k, SEGMENT, POSTINGS)
    found = index.select("doc_id", "n", "terms", "tfs").mapInArrow(search, _FOUND_SQL)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    # a block's names are bounded with its texts
    return _leading(found, ["item"], k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring of all documents for each item.

    ``items`` has item_id, text; ``docs`` has doc_id, text; other columns are ignored.  Scores are integers (see
    ``impacts``), only those above 0 count; equal scores rank by ascending doc_id, null last.  Rows that repeat a doc_id rank
    each.  Items without an id are left out; of rows that repeat an item_id the least text asks.  Null and termless texts
    match nothing and are no document of the count.
    """
    asks = items.where("item_id is not null").groupBy(F.col("item_id").cast("long")).agg(F.min(F.col("text").cast("string")).alias("text"))
    asks = written(asks, "items")
    size = asks.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = asks.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).orderBy("item_id").select("item_id", "text").collect()
        if not rows and (block or blocks > 1):
            continue
        with small_batches(docs.sparkSession):
            found = written(_block(rows, docs, k), "ranked")
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", F.col("rank").cast("int"), "doc_id", "score")
