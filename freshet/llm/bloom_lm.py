"""Language-model scores from a log-frequency Bloom filter.

Counting.  Tasks turn whole texts into word n-grams, count a bounded number of them at a time and
send the counts to buckets, ranges of the n-grams' 64-bit hashes; there are as many buckets as the
text has ``BUCKET_BYTES``, so one bucket stays small whatever the corpus.  A hot n-gram is one entry per
task, not one row per occurrence.

Filter.  A count c becomes level 1 + floor(log_base c); the pairs (n-gram, 1) ... (n-gram, level) are
inserted.  Each bucket has its own block of 64-bit words, sized by its own insertions, so the rate of
false members (about 2% at level 1 with ``BITS`` = 10) does not depend on the corpus; a pair sets four bits
of one word.  A count is read back by probing levels upward until one is missing.  A level can only
be too high; n-grams are clipped to the levels of their parts.

Probabilities.  Dirichlet smoothing over the orders, p(w | v) = (c(vw) + prior * p(w)) / (c(v) + prior), where every c
is the expected count of a probed level; the lowest order adds 0.1 to each count.

Size.  The filter grows with the corpus.  Up to ``BROADCAST`` bytes, known before anything is sent, its blocks are
broadcast one by one.  Beyond, texts are dealt to packets of ``PACKET_BYTES``.  A packet sends its distinct n-grams, sorted
by hash, to the buckets and gets back their levels alone in that order; the task that scores it puts the same n-grams in
order again and so knows whose level each is.  Nothing is moved per token.  Packets go in ``ROUNDS`` rounds one after another, each with a
part of all packets, and a round's shuffle files are gone before the next: what stands on disk besides the written texts is that
part of what all n-grams take.  Both ways give the same levels.

Exact word counts (``base_score``, ``n_known``) are no matter of the filter: words with at least a 2^-20 share of all
tokens, so at most 2^20 of them, are broadcast as hashes and counts; all other words join their counts, none of
which is hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from .common import shuffles_freed, slices, small_batches, written

END = b""
#: Text bytes per bucket of n-grams.
BUCKET_BYTES = 1 << 23
#: Filter bits per inserted pair.
BITS = 10
#: Largest filter that is broadcast, in bytes.
BROADCAST = 1 << 27
#: Words with this share of all tokens have their exact counts broadcast.
SHARE = 1 << 20
#: n-grams that a task counts before it sends them on.
HELD = 1 << 21
#: Bytes of text that are read at a time.
CHUNK = 1 << 20
#: Bytes of text that ask together for the levels of their n-grams, and what a row counts besides its text.
PACKET_BYTES, ROW_BYTES = 1 << 23, 64
#: Parts of the texts that ask one after another.
ROUNDS = 4
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_HALF = np.uint64(32)


@dataclass(frozen=True)
class Levels:
    """Quantisation of counts: level j holds counts from ceil(base^(j-1)) to below ceil(base^j)."""

    base: float = 1.5

    @property
    def starts(self) -> np.ndarray:
        starts, power = [1], self.base
        while power < 2**62:
            starts.append(max(starts[-1] + 1, ceil(power)))
            power *= self.base
        return np.array(starts, np.int64)

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, counts, "right")

    @property
    def expected(self) -> np.ndarray:
        """Mean count of each level, 0 for level 0."""
        starts = self.starts.astype(float)
        return np.r_[0.0, (starts + np.r_[starts[1:], starts[-1] * self.base] - 1) / 2]


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of hashes."""
    return (((grams >> _HALF) * np.uint64(buckets)) >> _HALF).astype(np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _masks() -> np.ndarray:
    """For each 16 bits a word with four bits set, drawn once and for all."""
    bits = np.random.Generator(np.random.PCG64(12)).integers(0, 64, (4, 1 << 16), dtype=np.uint64)
    return np.bitwise_or.reduce(np.uint64(1) << bits, axis=0)


_MASKS = _masks()


def _cells(grams: np.ndarray, level: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a (n-gram, level) pair in its block, and the four bits there."""
    x = (grams ^ (np.array([level], np.uint64) * _STEP)) * _MIX
    return (((x >> _HALF) * np.uint64(words)) >> _HALF).astype(np.int64), _MASKS[x & np.uint64(0xFFFF)]


def block(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The filter block of one bucket."""
    words = np.zeros(max(1, -(-int(levels.sum()) * BITS // 64)), np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        cell, mask = _cells(grams[levels >= level], level, len(words))
        np.bitwise_or.at(words, cell, mask)
    return words


def probe(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Levels of n-grams by repeated membership probes."""
    levels = np.zeros(len(grams), np.int16)
    rows = np.arange(len(grams))
    level = 1
    while len(rows):
        cell, mask = _cells(grams[rows], level, len(words))
        rows = rows[(words[cell] & mask) == mask]
        levels[rows] = level
        level += 1
    return levels


@dataclass
class Tokens:
    """Some texts' tokens in a row.

    ``names`` are the distinct words, the end last, ``hashes`` theirs; ``codes`` the words of a row that holds every text's
    context before it; ``grams`` for each order the hash of the n-gram that ends at a place; ``at`` the places of tokens
    and ``doc`` the text of each.
    """

    names: pa.Array
    hashes: np.ndarray
    codes: np.ndarray
    grams: list[np.ndarray]
    at: np.ndarray
    doc: np.ndarray


def _bytes(names: pa.Array) -> list[bytes]:
    """A binary array as Python bytes."""
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].tolist()
    data = names.buffers()[2].to_pybytes() if names.buffers()[2] is not None else b""
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _named(names: pa.Array) -> np.ndarray:
    return np.array(list(map(xxh3_64_intdigest, _bytes(names))), np.uint64)


def _added(names: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct names and the sums of their counts."""
    coded = pa.concat_arrays([*names, pa.array([], pa.binary())]).dictionary_encode()
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, coded.indices.to_numpy(), np.concatenate([*counts, np.empty(0, np.int64)]))
    return coded.dictionary, total


def _chunks(column: pa.Array) -> Iterator[tuple[pa.Array, int, bool, bool]]:
    """Texts of some ``CHUNK`` bytes, the number of the first, and whether they begin and end here: long ones come in slices."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(column):
        if size[start] > CHUNK:
            parts = list(slices(column[start].as_py().encode(), CHUNK))
            for i, part in enumerate(parts):
                yield pa.array([part.decode()]), start, i == 0, i == len(parts) - 1
            start += 1
            continue
        end, held = start, 0
        while end < len(column) and size[end] <= CHUNK and held <= CHUNK:
            held, end = held + int(size[end]), end + 1
        yield column.slice(start, end - start).fill_null(""), start, True, True
        start = end


def tokens(column: pa.Array, order: int) -> Iterator[Tokens]:
    """A column of texts in chunks of bounded size; the slices of a long text carry their context on."""
    pad, carried = order - 1, None
    for texts, first, begins, ends in _chunks(column):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        word = pc.greater(pc.binary_length(flat), 0)
        owner, coded = owner[word.to_numpy(zero_copy_only=False)], flat.filter(word).dictionary_encode()
        names = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
        hashes = _named(names)
        sizes = np.bincount(owner, minlength=len(texts)) + int(ends)
        begin = np.cumsum(sizes + pad) - sizes - pad
        codes = np.full(int((sizes + pad).sum()), len(names) - 1)
        within = np.arange(len(owner)) - np.searchsorted(owner, owner)
        codes[begin[owner] + pad + within] = coded.indices.to_numpy()
        own = hashes[codes]
        if not begins and pad:
            own[:pad] = carried
        carried = own[len(own) - pad :]
        grams = [own]
        for _ in range(1, order):
            longer = np.zeros_like(own)
            longer[1:] = _mixed(grams[-1][:-1] * _MIX ^ own[1:])
            grams.append(longer)
        real = np.ones(len(own), bool)
        real[(begin[:, None] + np.arange(pad)).ravel()] = False
        yield Tokens(names, hashes, codes, grams, np.flatnonzero(real), first + np.repeat(np.arange(len(texts)), sizes))


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(grams, kind="stable")
    grams, counts = grams[by], counts[by]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


_COUNTED_SQL = "bucket int, words binary, sizes binary, word_counts binary, grams binary, gram_counts binary"


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _count(order: int, buckets: int):
    """Counts of a task's words and n-grams (from two words on), one row per bucket and ``HELD`` n-grams."""

    def sent(names: list[pa.Array], times: list[np.ndarray], grams: list[np.ndarray]) -> pa.RecordBatch:
        words, totals = _added(names, times)
        hashes = _named(words)
        by = np.argsort(hashes)
        words, totals, where = words.take(pa.array(by)), totals[by], bucket_of(hashes[by], buckets)
        offsets, data = np.frombuffer(words.buffers()[1], np.int32), words.buffers()[2].to_pybytes()
        found, counts = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_counts=True)
        ends = np.arange(buckets + 1)
        word_cut, gram_cut = np.searchsorted(where, ends), np.searchsorted(bucket_of(found, buckets), ends)
        used = np.flatnonzero((np.diff(word_cut) > 0) | (np.diff(gram_cut) > 0))
        columns = [[], [], [], [], []]
        for b in used:
            w, z, g = word_cut[b], word_cut[b + 1], slice(gram_cut[b], gram_cut[b + 1])
            columns[0].append(data[offsets[w] : offsets[z]])
            columns[1].append(np.diff(offsets[w : z + 1]).tobytes())
            columns[2].append(totals[w:z].tobytes())
            columns[3].append(found[g].tobytes())
            columns[4].append(counts[g].astype(np.int64).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), *map(_binary, columns)], ["bucket", "words", "sizes", "word_counts", "grams", "gram_counts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, times, grams, held = [], [], [], 0
        for batch in batches:
            for part in tokens(batch.column(0), order):
                seen = np.bincount(part.codes[part.at], minlength=len(part.names))
                names.append(part.names.filter(pa.array(seen > 0)))
                times.append(seen[seen > 0])
                grams.extend(g[part.at] for g in part.grams[1:])
                held += len(part.at) * order
                if held >= HELD:
                    yield sent(names, times, grams)
                    names, times, grams, held = [], [], [], 0
        if names:
            yield sent(names, times, grams)
        # the worker goes on to other tasks
        del names, times, grams
        pa.default_memory_pool().release_unused()

    return run


_MODEL_SQL = "bucket int, bits binary, pairs long, word binary, hash long, n long"


def _build(levels: Levels):
    """Rows of one bucket after another -> its filter block, then its words with exact counts."""

    def made(bucket: int, names: pa.Array, totals: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashes = _named(names)
        of = levels.of(np.r_[totals, counts])
        bits = block(np.r_[hashes, grams], of)
        yield batch([bucket], _binary([bits.tobytes()]), [int(of.sum())], _binary([None]), [None], [None])
        for at in range(0, len(names), 1 << 14):
            n = min(1 << 14, len(names) - at)
            part = slice(at, at + n)
            yield batch([bucket] * n, _binary([None] * n), [None] * n, names[part], hashes[part].view(np.int64), totals[part])

    def batch(bucket, bits, pairs, word, hashes, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), bits, pa.array(pairs, pa.int64()), word, pa.array(hashes, pa.int64()), pa.array(n, pa.int64())],
            ["bucket", "bits", "pairs", "word", "hash", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, names, totals, grams, counts, held = None, [], [], [], [], 0
        for rows in batches:
            for own, words, sizes, times, found, seen in zip(*(rows.column(i) for i in range(6)), strict=True):
                if own.as_py() != bucket:
                    if bucket is not None:
                        yield from made(bucket, *_added(names, totals), *_summed(np.concatenate(grams), np.concatenate(counts)))
                    bucket, names, totals, grams, counts, held = own.as_py(), [], [], [], [], 0
                sizes = np.frombuffer(sizes.as_py(), np.int32)
                ends = pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                names.append(pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, pa.py_buffer(words.as_py())]))
                totals.append(np.frombuffer(times.as_py(), np.int64))
                grams.append(np.frombuffer(found.as_py(), np.uint64))
                counts.append(np.frombuffer(seen.as_py(), np.int64))
                held += len(grams[-1]) + len(sizes)
                if held >= HELD // 2:
                    both, (word, total) = _summed(np.concatenate(grams), np.concatenate(counts)), _added(names, totals)
                    names, totals, grams, counts, held = [word], [total], [both[0]], [both[1]], 0
        if bucket is not None:
            yield from made(bucket, *_added(names, totals), *_summed(np.concatenate(grams), np.concatenate(counts)))
        del names, totals, grams, counts
        pa.default_memory_pool().release_unused()

    return run


@dataclass
class Model:
    """A trained filter and the exact word counts."""

    blocks: DataFrame
    words: DataFrame
    buckets: int
    tokens: int
    distinct: int
    bytes: int
    order: int
    prior: float
    levels: Levels


def _texts() -> Column:
    return F.col("text").cast("string").alias("text")


def train(docs: DataFrame, order: int = 2, prior: float = 300.0, base: float = 1.5) -> Model:
    """Count words and n-grams of the whole column ``text`` and build the filter; null texts are empty.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, and one end per text; a text begins after an end.
    ``prior`` is the weight of the next lower order, in occurrences.  Repeated rows count each.  Without rows every count
    is 0.  Other columns are ignored.
    """
    levels = Levels(base)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    counted = docs.select(_texts()).mapInArrow(_count(order, buckets), _COUNTED_SQL)
    merged = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_build(levels), _MODEL_SQL)
    with small_batches(docs.sparkSession), shuffles_freed(docs.sparkSession):
        model = written(merged, "ngrams")
    blocks = model.where("bits is not null").select("bucket", "bits", "pairs")
    words = model.where("word is not null").select("word", "hash", "n")
    total = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    held = blocks.agg(F.sum(F.octet_length("bits").cast("long"))).first()[0] or 0
    return Model(blocks, words, buckets, total[0] or 0, total[1], held, order, prior, levels)


def probability(model: Model, own: list, contexts: list, clip, read, floor):
    """p of the longest order, from the levels of the n-grams that end at a token and of their contexts.

    ``clip`` is the lesser of two, ``read`` the expected count of a level.
    """
    bound = own[0]
    p = (read(bound) + 0.1) / floor
    context = None
    for n in range(1, model.order):
        context = contexts[n - 1] if context is None else clip(contexts[n - 1], context)
        bound = clip(own[n], clip(bound, context))
        p = (read(bound) + model.prior * p) / (read(context) + model.prior)
    return p


def _unit(model: Model) -> float:
    return model.tokens + 0.1 * (model.distinct + 1)


_SCORED = "n_tokens long, known long, base double, score double, light array<binary>, tf array<long>"


def _scored(model: Model, heavy):
    """Per text: tokens, base sum and known tokens among heavy words, the light words; the score by the levels of its n-grams."""
    order, expected, unit = model.order, model.levels.expected, _unit(model)
    shape = Model(None, None, model.buckets, model.tokens, model.distinct, model.bytes, order, model.prior, model.levels)

    def scores(part: Tokens, levels) -> np.ndarray:
        single = levels(part.hashes)[part.codes]
        if order > 1:
            # a slice's carried context need not be among its own words
            single[: order - 1] = levels(part.grams[0][: order - 1])
        every = [single, *map(levels, part.grams[1:])]
        own, contexts = [e[part.at] for e in every], [e[part.at - 1] for e in every[:-1]]
        return np.log10(probability(shape, own, contexts, np.minimum, expected.__getitem__, unit))

    def scored(batch: pa.RecordBatch, parts: Iterable[Tokens], levels) -> pa.RecordBatch:
        hashes, counts = heavy.value
        n = batch.num_rows
        total, known, base, score = (np.zeros(n) for _ in range(4))
        docs, light, tf = [np.empty(0, np.int64)], [pa.array([], pa.binary())], [np.empty(0, np.int64)]
        for part in parts:
            at = np.minimum(np.searchsorted(hashes, part.hashes), max(0, len(hashes) - 1))
            hit = hashes[at] == part.hashes if len(hashes) else np.zeros(len(at), bool)
            share = np.where(hit, np.log10((counts[at] + 0.1) / unit), 0.0) if len(hashes) else np.zeros(len(at))
            codes = part.codes[part.at]
            total += np.bincount(part.doc, minlength=n)
            known += np.bincount(part.doc, hit[codes], minlength=n)
            base += np.bincount(part.doc, share[codes], minlength=n)
            rest = ~hit[codes]
            pairs, times = np.unique(part.doc[rest] * len(part.names) + codes[rest], return_counts=True)
            docs.append(pairs // len(part.names))
            light.append(part.names.take(pa.array(pairs % len(part.names))))
            tf.append(times)
            score += np.bincount(part.doc, scores(part, levels), minlength=n)
        ends = pa.array(np.searchsorted(np.concatenate(docs), np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.concat_arrays(light), pa.array(np.concatenate(tf)))]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("kept"), *(pa.array(v.astype(np.int64)) for v in (total, known)), pa.array(base), pa.array(score), *lists],
            ["row", "kept", "n_tokens", "known", "base", "score", "light", "tf"],
        )

    return scored


def _score(model: Model, heavy, shards):
    """Texts' scores by a filter that is at hand."""
    order, buckets, scored = model.order, model.buckets, _scored(model, heavy)

    def levels(grams: np.ndarray) -> np.ndarray:
        where = bucket_of(grams, buckets)
        by = np.argsort(where.astype(np.uint16) if buckets <= 1 << 16 else where, kind="stable")
        out = np.zeros(len(grams), np.int16)
        cuts = np.searchsorted(where[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            if b in shards:
                rows = by[cuts[b] : cuts[b + 1]]
                out[rows] = probe(np.frombuffer(shards[b].value, np.uint64), grams[rows])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield scored(batch, tokens(batch.column("text"), order), levels)

    return run


def _packed(size: int, rounds: int):
    """Rows in packets of some ``size`` bytes; a packet has the number of its first row and is dealt to a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packet, made, held = 0, 0, size
        for batch in batches:
            rows = batch.column("row").to_pylist()
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            packets, parts = [], []
            for row, own in zip(rows, sizes, strict=True):
                if held >= size:
                    packet, made, held = row, made + 1, 0
                held += own + ROW_BYTES
                packets.append(packet)
                # tasks begin with different rounds: the upper bits of a row's number are its task's
                parts.append((made + (packet >> 33)) % rounds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(packets, pa.int64()), pa.array(parts, pa.int32())], [*batch.schema.names, "packet", "part"]
            )

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches of one packet after another, from rows that are sorted by packet."""
    packet, held = None, []
    for batch in batches:
        own = batch.column("packet").to_numpy()
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else own
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and own[a] != packet:
                yield held
                held = []
            packet = own[a]
            held.append(batch.slice(a, z - a))
    if held:
        yield held


def _sorted(found: list[np.ndarray]) -> np.ndarray:
    """Distinct values in order; of so many, sorting takes a tenth of the time that numpy's own hash table does."""
    every = np.sort(np.concatenate(found))
    return every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every


def _distinct(parts: Iterable[Tokens]) -> np.ndarray:
    """Sorted hashes of the n-grams that end at the tokens of whole texts, and of their contexts."""
    found, held = [np.empty(0, np.uint64)], 0
    for part in parts:
        more = [part.hashes, *(g[part.at] for g in part.grams[1:]), *(g[part.at - 1] for g in part.grams[1:-1])]
        found, held = found + more, held + sum(map(len, more))
        if held >= HELD:
            found, held = [_sorted(found)], 0
    return _sorted(found)


_ASKED_SQL = "bucket int, packet long, grams binary"


def _ask(order: int, buckets: int):
    """Per packet and bucket the distinct n-grams whose levels are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _gathered(batches):
            grams = _distinct(part for batch in texts for part in tokens(batch.column("text"), order))
            cuts = np.searchsorted(bucket_of(grams, buckets), np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            packet = pa.array(np.full(len(used), texts[0].column("packet")[0].as_py()), pa.int64())
            asked = _binary([grams[cuts[b] : cuts[b + 1]].tobytes() for b in used])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), packet, asked], ["bucket", "packet", "grams"])

    return run


_ANSWERED_SQL = "packet long, bucket int, levels binary"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket, its block first: levels of the n-grams asked for, in their order."""
    bucket, words = None, None
    for batch in batches:
        own, bits = batch.column("bucket").to_numpy(), batch.column("bits")
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else own
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if own[a] != bucket:
                bucket, words = own[a], None
            if bits[a].is_valid:
                words, a = np.frombuffer(bits[a].as_py(), np.uint64), a + 1
            if a == z:
                continue
            asked = [np.frombuffer(g, np.uint64) for g in batch.column("grams")[a:z].to_pylist()]
            every = np.concatenate(asked)
            found = probe(words, every) if words is not None else np.zeros(len(every), np.int16)
            levels = [f.tobytes() for f in np.split(found, np.cumsum([len(g) for g in asked])[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("packet")[a:z], pa.array(own[a:z], pa.int32()), _binary(levels)], ["packet", "bucket", "levels"]
            )


def _score_packets(model: Model, heavy, size: int):
    """Sorted by packet, its levels by bucket first: texts' scores."""
    order, scored = model.order, _scored(model, heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packet in _gathered(batches):
            answers = [v for batch in packet for v in batch.column("levels").drop_null().to_pylist()]
            # ranges of hashes, so in the order of the buckets all n-grams are sorted
            levels = np.frombuffer(b"".join(answers), np.int16)
            texts = [batch.filter(batch.column("levels").is_null()) for batch in packet]
            held = sum(pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0 for batch in texts)
            # tokens take some times their text: those of a packet with a long text are read twice rather than held
            parts = [list(tokens(batch.column("text"), order)) if held <= 2 * size else None for batch in texts]

            def read(parts=parts, texts=texts) -> Iterator[Iterable[Tokens]]:
                for own, batch in zip(parts, texts, strict=True):
                    yield tokens(batch.column("text"), order) if own is None else own

            grams = _distinct(part for own in read() for part in own)

            def known(asked: np.ndarray, grams=grams, levels=levels) -> np.ndarray:
                # in order, so that successive searches end near each other
                by = np.argsort(asked)
                asked, out = asked[by], np.empty(len(asked), np.int16)
                at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
                out[by] = np.where(grams[at] == asked, levels[at], np.int16(0))
                return out

            for own, batch in zip(read(), texts, strict=True):
                if batch.num_rows:
                    yield scored(batch, own, known)

    return run


def _routed(rows: DataFrame, model: Model, heavy, schema: StructType) -> DataFrame:
    """Texts' scores when the filter is too large to broadcast: n-grams go to the blocks and levels come back."""
    packets = StructType([*rows.schema, *StructType.fromDDL("packet long, part int")])
    rows = written(rows.mapInArrow(_packed(PACKET_BYTES, ROUNDS), packets), "packets", "part")
    made = None
    for part in range(ROUNDS):
        texts = rows.where(F.col("part") == part).drop("part")
        asked = texts.select("packet", "text").repartition("packet").sortWithinPartitions("packet")
        asked = asked.mapInArrow(_ask(model.order, model.buckets), _ASKED_SQL)
        both = model.blocks.select("bucket", "bits").unionByName(asked, allowMissingColumns=True)
        both = both.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())
        levels = both.mapInArrow(_answer, _ANSWERED_SQL)
        both = texts.unionByName(levels, allowMissingColumns=True)
        both = both.repartition("packet").sortWithinPartitions("packet", F.col("bucket").asc_nulls_last())
        found = written(both.mapInArrow(_score_packets(model, heavy, PACKET_BYTES), schema), "scored")
        made = found if made is None else made.unionByName(found)
    return made


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of ``docs`` (text, ...): the columns ``keep``, ``n_tokens, n_known, train_tokens, base_score, score``.

    Both scores are log10 probabilities of the whole text with its end: ``base_score`` of exact word counts (each plus 0.1),
    ``score`` of the filter's n-grams.  A null text is empty: its end alone.  Filters beyond ``broadcast`` bytes are not sent.
    """
    context = docs.sparkSession.sparkContext
    keep = keep or []
    unit = _unit(model)
    top = model.words.where(F.col("n") * SHARE >= max(1, model.tokens)).select("hash", "n").toArrow()
    hashes, counts = (top.column(c).to_numpy() for c in ("hash", "n"))
    by = np.argsort(hashes.astype(np.int64).view(np.uint64))
    heavy = context.broadcast((hashes.astype(np.int64).view(np.uint64)[by], counts.astype(np.int64)[by]))
    shards = None
    if model.bytes <= broadcast:
        shards = {r.bucket: context.broadcast(bytes(r.bits)) for r in model.blocks.select("bucket", "bits").toLocalIterator()}
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), _texts(), kept.alias("kept"))
    schema = StructType([rows.schema["row"], rows.schema["kept"], *StructType.fromDDL(_SCORED)])
    with small_batches(docs.sparkSession), shuffles_freed(docs.sparkSession):
        made = _routed(rows, model, heavy, schema) if shards is None else written(rows.mapInArrow(_score(model, heavy, shards), schema), "scored")
    words = made.select("row", F.explode(F.arrays_zip("light", "tf")).alias("w")).select("row", F.col("w.light").alias("word"), F.col("w.tf").alias("tf"))
    rest = words.join(model.words.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / unit)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("found"),
    )
    out = made.drop("light", "tf").join(rest, "row", "left")
    return out.select(
        *([F.col(f"kept.`{c}`") for c in keep]), "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def held_out(doc_id: str) -> Column:
    """Rows never learned from: those whose crc32 of the id as text is divisible by 10; none without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))
