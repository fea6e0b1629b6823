"""Language-model scores against exact counts."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from freshet.llm import bloom_lm, common

from .conftest import prose

ROWS = [(i, prose(i % 37, 200 + i, "abcd"), "en", "s") for i in range(120)] + [(200 + i, prose(5, 50, "xy"), "en", "s") for i in range(60)]


def split(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", low) + [b""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def base_scores(rows):
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in split(t))
    total = sum(counts.values())
    unit = total + 0.1 * (len(counts) + 1)
    out = []
    for i, t, *_ in rows:
        words = split(t)
        base = sum(math.log10((counts[w] + 0.1) / unit) for w in words)
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), total, base))
    return out


def run(docs, **how):
    docs = docs.withColumn("held_out", bloom_lm.held_out("doc_id"))
    trained = bloom_lm.train(docs.where("not held_out"), **{k: v for k, v in how.items() if k != "broadcast"})
    keep = {k: v for k, v in how.items() if k == "broadcast"}
    return trained, bloom_lm.score(docs, trained, ["doc_id", "held_out"], **keep).collect()


def exact_score(model, rows, text):
    """Dirichlet smoothing over quantised true counts."""
    counts = [Counter() for _ in range(model.order)]
    for i, t, *_ in rows:
        if not held(i):
            words = [b""] * (model.order - 1) + split(t)
            for at in range(model.order - 1, len(words)):
                for n in range(model.order):
                    counts[n][tuple(words[at - n : at + 1])] += 1
    expected = model.levels.expected

    def level(gram):
        return int(model.levels.of(np.array([counts[len(gram) - 1][gram]]))[0]) if counts[len(gram) - 1][gram] else 0

    unit = model.tokens + 0.1 * (model.distinct + 1)
    words, out = [b""] * (model.order - 1) + split(text), 0.0
    for at in range(model.order - 1, len(words)):
        bound = level((words[at],))
        p, context = (expected[bound] + 0.1) / unit, None
        for n in range(1, model.order):
            own = level(tuple(words[at - n : at]))
            context = own if context is None else min(own, context)
            bound = min(level(tuple(words[at - n : at + 1])), bound, context)
            p = (expected[bound] + model.prior * p) / (expected[context] + model.prior)
        out += math.log10(p)
    return out


def test_base_scores_are_exact(documents, odd):
    rows = ROWS + [(400, None, "en", "s"), (401, "", "en", "s"), (402, "Never SEEN words\x0bhere", "en", "s"), (None, "abc Abc", "en", "s")]
    _, got = run(documents(rows))
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=str)
    for one, other in zip(got, sorted(base_scores(rows), key=str), strict=True):
        assert one[:5] == other[:5]
        assert one[5] == pytest.approx(other[5], rel=1e-12)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_come_near_those_of_true_counts(documents, order, monkeypatch):
    model, got = run(documents(ROWS), order=order, prior=10.0)
    score = {r.doc_id: r.score for r in got}
    for i in (0, 7, 41, 203, 216):
        exact = exact_score(model, ROWS, ROWS[i][1] if i < 200 else ROWS[120][1])
        # a false member raises a count by half at most
        assert score[i] == pytest.approx(exact, rel=0.01, abs=0.5)


def test_routed_levels_equal_broadcast_ones(documents, monkeypatch):
    monkeypatch.setattr(bloom_lm, "BUCKET_BYTES", 4000)
    docs = documents(ROWS + [(400, None, "en", "s"), (None, "a b", "en", "s")])
    for order in (2, 3):
        near = {(r.doc_id, r.n_tokens): r for r in run(docs, order=order)[1]}
        far = {(r.doc_id, r.n_tokens): r for r in run(docs, order=order, broadcast=0)[1]}
        assert near.keys() == far.keys()
        for k, r in near.items():
            assert far[k].score == pytest.approx(r.score, rel=1e-12)
            assert far[k].base_score == pytest.approx(r.base_score, rel=1e-12)


def test_packets_and_rounds_change_no_score(documents, odd, nothing, monkeypatch):
    monkeypatch.setattr(bloom_lm, "BUCKET_BYTES", 4000)
    # the long text exceeds its packet and is read twice
    monkeypatch.setattr(bloom_lm, "PACKET_BYTES", 2000)
    docs = documents(ROWS[::4]).unionByName(odd)
    for order in (1, 3):
        model, near = run(docs, order=order)
        far = run(docs, order=order, broadcast=0)[1]
        assert len(near) == docs.count()
        for one, other in zip(sorted(map(tuple, far), key=str), sorted(map(tuple, near), key=str), strict=True):
            assert one[:5] == other[:5] and one[5:] == pytest.approx(other[5:], rel=1e-12)
    assert bloom_lm.score(nothing, model, broadcast=0).collect() == []


def test_rows_are_dealt_to_packets_of_bounded_bytes():
    texts = [None, "", *(prose(i, 20) for i in range(50)), "a" * 5000, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    out = pa.Table.from_batches(bloom_lm._packed(1000, 4)(iter([batch.slice(0, 7), batch.slice(7)]))).to_pylist()
    assert [r["text"] for r in out] == texts
    packets = {}
    for r in out:
        packets.setdefault((r["packet"], r["part"]), []).append(r)
    assert len(packets) > 6 and {part for _, part in packets} == {0, 1, 2, 3}
    for (packet, _), rows in packets.items():
        assert packet == rows[0]["row"]
        assert sum(len(r["text"] or "") + bloom_lm.ROW_BYTES for r in rows[:-1]) < 1000


@pytest.mark.parametrize("order", [1, 2, 3])
def test_sliced_texts_ask_for_the_same_grams(order, monkeypatch):
    column = pa.array([prose(3, 3000), None, "a b", prose(4, 500), ""])
    whole = bloom_lm._distinct(bloom_lm.tokens(column, order))
    every = {g for p in bloom_lm.tokens(column, order) for n in range(order) for g in p.grams[n][p.at].tolist()}
    assert (np.diff(whole.astype(object)) > 0).all() and every <= set(whole.tolist())
    monkeypatch.setattr(bloom_lm, "CHUNK", 100)
    monkeypatch.setattr(bloom_lm, "HELD", 500)
    assert (bloom_lm._distinct(bloom_lm.tokens(column, order)) == whole).all()


def test_routed_way_takes_little_disk(spark, documents, folder, monkeypatch):
    """Written tables and shuffle files that stand when the scores are made, as multiples of the texts' table."""
    monkeypatch.setattr(bloom_lm, "BUCKET_BYTES", 1 << 18)
    docs = documents([(i, prose(i, 2000), "en", "s") for i in range(200)])
    docs.select("doc_id", "text").write.parquet(folder)
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"{folder}-own")

    def size(path):
        return sum(p.stat().st_size for p in Path(path.removeprefix("file:")).rglob("*") if p.is_file())

    def shuffled():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(held.apply(i).length() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle"))

    before = shuffled()
    model = bloom_lm.train(docs)
    assert shuffled() - before < size(folder) / 10
    before = size(f"{folder}-own") + shuffled()
    assert len(bloom_lm.score(docs, model, ["doc_id"], broadcast=0).collect()) == 200
    assert size(f"{folder}-own") + shuffled() - before < 2 * size(folder)


def test_copies_score_above_base_and_unseen_text_below_seen(documents):
    got = {r.doc_id: r for r in run(documents(ROWS), prior=10.0)[1]}
    copies = [r for i, r in got.items() if i >= 200]
    assert any(r.held_out for r in copies) and all(r.score > r.base_score for r in copies)


def test_filter_holds_every_level_and_few_others():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 2**63, 20000).astype(np.uint64))
    levels = bloom_lm.Levels(1.5)
    of = levels.of(rng.geometric(0.4, len(grams)))
    words = bloom_lm.block(grams, of)
    assert (bloom_lm.probe(words, grams) >= of).all()
    other = rng.integers(2**63, 2**64, 20000, dtype=np.uint64)
    assert (bloom_lm.probe(words, other) > 0).mean() < 0.04
    assert len(words) * 64 <= of.sum() * bloom_lm.BITS + 64


def test_levels_cover_counts():
    levels = bloom_lm.Levels(1.5)
    assert levels.of(np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10**18])).tolist()[:9] == [0, 1, 2, 3, 4, 4, 5, 5, 6]
    assert levels.expected[:7].tolist() == [0, 1, 2, 3, 4.5, 6.5, 9.5]


def test_odd_and_empty_tables(odd, nothing, documents):
    _, got = run(odd)
    assert len(got) == odd.count() and all(np.isfinite(r.score) for r in got)
    _, got = run(nothing)
    assert got == []
    # a model of no text: every token is unknown
    model = bloom_lm.train(nothing)
    r = bloom_lm.score(documents([(1, "a b", "en", "s")]), model, ["doc_id"]).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0.0


def test_long_texts_are_read_in_slices(monkeypatch):
    column = pa.array([prose(3, 3000), None, "a b", prose(4, 500), ""])

    def read():
        parts = list(bloom_lm.tokens(column, 3))
        own = [np.concatenate([g[p.at] for p, g in ((p, p.grams[i]) for p in parts)]) for i in range(3)]
        context = [np.concatenate([p.grams[i][p.at - 1] for p in parts]) for i in range(2)]
        words = [w for p in parts for w in p.names.take(pa.array(p.codes[p.at])).to_pylist()]
        return words, np.concatenate([p.doc for p in parts]), own + context

    words, doc, grams = read()
    assert words == [w for t in column.to_pylist() for w in split(t)]
    monkeypatch.setattr(bloom_lm, "CHUNK", 100)
    other = read()
    assert words == other[0] and (doc == other[1]).all()
    assert all((a == b).all() for a, b in zip(grams, other[2], strict=True))


def test_sliced_scores_equal_whole_ones(documents, monkeypatch):
    docs = documents(ROWS)
    whole = {r.doc_id: (r.score, r.base_score) for r in run(docs, order=3)[1]}
    monkeypatch.setattr(bloom_lm, "CHUNK", 200)
    for r in run(docs, order=3)[1]:
        assert (r.score, r.base_score) == pytest.approx(whole[r.doc_id], rel=1e-12)
