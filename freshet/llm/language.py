"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of 1 to 3 lower-cased characters, weighted by term frequency times
inverse document frequency.  Document counts cover every labelled row.  The weights are fitted
with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties, which leave most
weights at zero) on a bounded sample per label, and a temperature is fitted on a part of the
sample that the weights have not seen.  Prediction reads whole texts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash, text_batches

UNDETERMINED = "und"
#: Hash space of the n-grams; the bound of the model and of the counted table.
BITS = 16
DIM = 1 << BITS
ORDERS = (1, 2, 3)
#: Labelled rows fitted per label, and the passes over them.
SAMPLE = 400
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Letters and numerals such as fractions and Roman numbers, which are no letters.
_ALNUM = re.compile(r"[^\W\d_]")
#: Letters, for Spark.
_LETTER_SPARK = r"\p{L}"
_SEEDS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: The temperature's range; texts that are all told apart would drive it to nothing.
LEAST_T, MOST_T = 0.5, 20.0
#: Characters worked on at once.
SLICE = 1 << 18


def has_letter(text: str | None) -> bool:
    """Whether any character is of a Unicode letter category."""
    return bool(text) and any(m[0].isalpha() for m in _ALNUM.finditer(text))


def ngram_slots(text: str) -> Iterator[np.ndarray]:
    """Hash slots of all n-grams of a text with a blank at either end, slice by slice."""
    text = f" {text.lower()} "
    for start in range(0, len(text), SLICE):
        # the next slice's first characters complete this one's last n-grams
        part = text[start : start + SLICE + max(ORDERS) - 1]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = min(SLICE, len(text) - start)
        mixed = np.zeros(len(code), np.uint32)
        for n in ORDERS:
            mixed = (mixed[: len(code) - n + 1] ^ code[n - 1 :]) * _SEEDS[n - 1]
            mixed ^= mixed >> np.uint32(15)
            yield (mixed[:size] >> np.uint32(32 - BITS)).astype(np.intp)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and how often each occurs."""
    total = np.zeros(DIM, np.int64)
    for slots in ngram_slots(text):
        total += np.bincount(slots, minlength=DIM)
    found = np.flatnonzero(total)
    return found, total[found]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(DIM, np.int64), 0
    mark = np.zeros(DIM, bool)
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if has_letter(text):
                mark[:] = False
                for slots in ngram_slots(text):
                    mark[slots] = True
                seen += mark
                docs += 1
    found = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[found, -1].astype(np.int32)), pa.array(np.r_[seen[found], docs])], names=["slot", "n"]
    )


@dataclass
class Model:
    """Weights (slot x label, times the inverse document frequency) and the temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, many = np.zeros(len(self.labels)), 0
        for slots in ngram_slots(text):
            total += np.take(self.weights, slots, axis=0).sum(axis=0, dtype=np.float64)
            many += len(slots)
        return total / max(1, many) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


#: Brings term frequencies, which add up to one, to a range in which the rates work.
TF_SCALE = 100.0


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader; rows are (slots, values, label)."""
    z, n = np.zeros((DIM + 1, labels)), np.zeros((DIM + 1, labels))
    order = np.random.Generator(np.random.PCG64(11))

    def weights(slots):
        zs, ns = z[slots], n[slots]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            slots, values, label = rows[i]
            slots, values = np.r_[slots, DIM], np.r_[values, 1.0]
            w = weights(slots)
            error = softmax(values @ w)
            error[label] -= 1
            g = values[:, None] * error[None]
            step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - step * w
            n[slots] += g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section on its logarithm."""
    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    low, high, ratio = np.log(LEAST_T), np.log(MOST_T), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame) -> Model:
    """Fit on ``doc_id, text, lang``; rows without a lang or without a letter are left out.

    The document counts, at most ``DIM`` numbers, cover all rows.  The fit takes at most ``SAMPLE``
    rows of a label, the least by hash of doc_id and text, in one task; its weights come to the driver.
    Only rows with a letter take a place, also those without a doc_id; equal rows take one.
    """
    text_batches(labelled.sparkSession)
    named = labelled.where("lang is not null").select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    seen = named.select("text").mapInArrow(_document_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    df, docs = np.zeros(DIM), 0
    for slot, n in seen.collect():
        if slot < 0:
            docs = n
        else:
            df[slot] = n
    idf = np.log((1 + docs) / (1 + df)) + 0.1
    rows = named.where(F.col("text").rlike(_LETTER_SPARK)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.xxhash64("text").alias("digest")
    )
    chosen = sample_by_hash(rows.select("lang", "doc_id", "digest").distinct(), "lang", ["doc_id", "digest"], SAMPLE)
    taken = F.broadcast(chosen.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")))
    same = (F.col("lang") == F.col("_lang")) & (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # the rows taken are the ones fitted: of equal rows one
    sample = rows.join(taken, same, "left_semi").groupBy("lang", "doc_id", "digest").agg(F.first("text").alias("text"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], [], []
            for doc_id, digest, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text", "lang")), strict=True):
                if has_letter(text):
                    slots, many = counts(text)
                    for c, v in zip(out, (doc_id, lang, slots.tolist(), many.tolist(), digest), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.int64())],
                names=["doc_id", "lang", "slots", "many", "digest"],
            )

    shared = labelled.sparkSession.sparkContext.broadcast(idf)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fit_rows(batches, shared.value)

    vectors = sample.select("doc_id", "digest", "text", "lang").mapInArrow(
        reduce, "doc_id long, lang string, slots array<int>, many array<long>, digest long"
    )
    # the sample is bounded: one task fits it, and the model alone comes to the driver
    found = vectors.repartition(1).mapInArrow(fit, "slot int, label string, weight double").toArrow()
    slot, weight = found.column("slot").to_numpy(), found.column("weight").to_numpy()
    labels = sorted(found.column("label").unique().to_pylist())
    label = np.zeros(len(slot), int)
    for i, name in enumerate(labels):
        label[np.array(pc.equal(found.column("label"), name))] = i
    whole = np.zeros((DIM + 2, len(labels)))
    whole[slot, label] = weight
    weights, bias = whole[:DIM].astype(np.float32), whole[DIM]
    temperature = float(whole[DIM + 1].max(initial=0.0)) or 1.0
    return Model(labels, weights, bias, temperature)


def _fit_rows(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Fit the sample's vectors: non-zero weights by slot, at ``DIM`` the bias, above it the temperature."""
    got = []
    for batch in batches:
        for i, (doc_id, lang, digest) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 4)), strict=True)):
            slots = batch.column(2)[i].values.to_numpy().astype(np.intp)
            many = batch.column(3)[i].values.to_numpy().astype(float)
            got.append(((doc_id is None, doc_id or 0, lang, digest), lang, slots, TF_SCALE * many / many.sum() * idf[slots]))
    if not got:
        return
    got.sort(key=lambda r: r[0])
    labels = sorted({r[1] for r in got})
    rows = [(slots, values, labels.index(lang)) for _, lang, slots, values in got]
    # every fifth row, spread by id order over all labels, is kept for the temperature
    held, fit = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    w, bias = fit_ftrl(fit, len(labels))
    logits = np.array([v @ w[s] + bias for s, v, _ in held])
    temperature = fit_temperature(logits, np.array([y for _, _, y in held]))
    w = TF_SCALE * w * idf[:, None]
    slot, label = np.nonzero(w)
    count = len(labels)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[slot, [DIM] * count, [DIM + 1] * count].astype(np.int32)),
            pa.array([labels[i] for i in label] + labels * 2, pa.string()),
            pa.array(np.r_[w[slot, label], bias, [temperature] * count]),
        ],
        names=["slot", "label", "weight"],
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    A null or empty text and one without a letter get ``und`` and score 0, as do all rows if no
    label was learned.  The score is the calibrated probability of the predicted label.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> Column:
    """Rows never learned from: those whose crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn from the rows not held out, predict all."""
    model = train(docs.where(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


#: A document stays if its language is found with at least this probability.
LEAST_SCORE = 0.4


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a language found with a score of ``least`` or more, columns as they are.

    Null, empty and letterless texts go.  Where no label was learned nothing else is rejected.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            good = []
            for t in texts:
                lang, score = shared.value.predict(t.as_py())
                good.append(has_letter(t.as_py()) if not shared.value.labels else lang != UNDETERMINED and score >= least)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
