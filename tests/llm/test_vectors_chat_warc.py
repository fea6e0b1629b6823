"""Cover tree, top-k, chat formatting and WARC archives against brute force and round trips."""

import gzip
import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import chat, cover_tree, graph, top_k, warc

SCHEMA = "vec_id long, embedding array<float>, label int, task string, n_links string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "t", "n") for i, v in rows], SCHEMA)


ODD = [
    (900, None), (901, []), (902, [0.0, 0.0, 0.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 0.0]),
    (905, [float("inf"), 1.0, 0.0]), (None, [1.0, 2.0, 3.0]), (907, [1e30, 0.0, 0.0]), (908, [1e-30, 0.0, 0.0]), (909, [2.0]),
    (910, [3.0, 4.0, 0.0]), (910, [3.0, 4.0, 0.0]),
]


def links_by_force(rows, threshold):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids, width = sorted(good), max(len(v) for v in good.values())
    x = np.array([np.pad(good[i], (0, width - len(good[i]))) for i in ids])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    low = np.arange(len(ids))
    for _ in ids:
        low = np.array([min([low[a], *low[near[a]]]) for a in range(len(ids))])
    out = {i: (0, i) for i, _ in rows if i is not None}
    return out | {i: (int(near[n].sum()), ids[low[n]]) for n, i in enumerate(ids)}


def got_links(df, threshold=0.95):
    rows = cover_tree.threshold_links(df, threshold).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows) and len(rows) == len({r.vec_id for r in rows})
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


@pytest.mark.parametrize("block,leaves,brute", [(8192, 512, 512), (16, 20, 4)])
def test_links_match_brute_force(spark, monkeypatch, block, leaves, brute):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "LEAVES", leaves)
    rng = np.random.Generator(np.random.PCG64(2))
    base = rng.normal(size=(12, 6))
    rows = [(int(i), (base[i % 12] + rng.normal(size=6) * (0.05 + 0.1 * (i % 4))).tolist()) for i in range(150)]
    rows += [(200 + i, (base[0] * (1 + i)).tolist()) for i in range(40)] + [(300 + i, base[1].tolist()) for i in range(20)]
    assert got_links(vectors(spark, rows)) == links_by_force(rows, 0.95)


def test_local_trees_prune_without_loss(monkeypatch):
    monkeypatch.setattr(cover_tree, "BRUTE", 4)
    rng = np.random.Generator(np.random.PCG64(8))
    x = cover_tree.units(np.repeat(rng.normal(size=(40, 3)), 5, axis=0) + 0.05 * rng.normal(size=(200, 3)))
    blocks = np.repeat([0, 1], 100)
    forest, links = cover_tree._pairs_of(1, np.arange(200), blocks, np.ones(200, np.int64), x, 0.95)
    want = (x[:100] @ x[100:].T >= 0.95)
    assert (links[:100] == want.sum(axis=1)).all() and (links[100:] == want.sum(axis=0)).all()
    seen = sum(len(a) * len(b) for a, b in cover_tree.dual(cover_tree.Node(x, np.arange(100), 2.0), cover_tree.Node(x, np.arange(100, 200), 2.0), 0.3))
    assert seen < 10000


def test_links_of_odd_vectors(spark):
    assert got_links(vectors(spark, ODD)) == links_by_force(ODD, 0.95)
    assert got_links(vectors(spark, ODD[:3])) == {900: (0, 900), 901: (0, 901), 902: (0, 902)}
    assert got_links(vectors(spark, [])) == {}


def best_by_force(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all():
            good[i] = [int(np.floor(64 * float(np.float32(x)))) for x in v]
    out = set()
    for q in good:
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(good[q], good[c], strict=False)))), c) for c in good if c != q)
            out |= {(q, n, c, -s) for n, (s, c) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("bucket,queries,long", [(8192, 1024, 1.0), (16, 3, 1.0), (16, 3, 40.0)])
def test_top_k_matches_brute_force(spark, monkeypatch, bucket, queries, long):
    monkeypatch.setattr(top_k, "BUCKET", bucket)
    monkeypatch.setattr(top_k, "QUERIES", queries)
    rng = np.random.Generator(np.random.PCG64(3))
    scale = np.where(np.arange(200) % 9 == 0, long, 1.0)[:, None]
    x = rng.normal(size=(200, 5)) * scale
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {tuple(r) for r in top_k.top_k(vectors(spark, rows), 7, 5).collect()}
    assert got == best_by_force(rows, 7, 5)


def test_top_k_of_odd_vectors(spark):
    assert {tuple(r) for r in top_k.top_k(vectors(spark, ODD), 3, 1).collect()} == best_by_force(ODD, 3, 1)
    assert top_k.top_k(vectors(spark, []), 3, 1).count() == 0


def test_components(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(70)] + [(600, 900 + i) for i in range(50)]
    low = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    df = spark.createDataFrame([*edges, (None, 3), (7, None)], "u long, v long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {n: m for n, m in low.items() if n in got} and all(low[n] == n for n in low if n not in got)
    assert graph.components(df.limit(0)).count() == 0


def read(made):
    made = made.withColumns({"turns": chat.read_back(F.col("formatted")), "said": chat.read_loss(F.col("formatted"), F.col("loss"))})
    return {r.tree: r for r in made.collect()}


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok\n</turn>\n### user\n\\b\\h\\l\\\\ \U0001f600"
    rows = [
        (1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "us\ner#<\\n", None), (1, 3, "assistant", ""), (1, 4, None, "x"),
        (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (2, None, "user", "first"), (None, 0, "user", "n"), (3, 1, "assistant", "z" * 200000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = read(chat.conversations(chat.as_trees(df)))
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want[conv].append((role or "", text or ""))
    assert {k: [tuple(t) for t in r.turns] for k, r in got.items()} == want
    assert all(r.said == "".join(t for role, t in want[k] if role == "assistant") for k, r in got.items())
    assert got[1].n_turns == 5 and chat.conversations(chat.as_trees(df.limit(0))).count() == 0


def test_reply_trees_rank_branches(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 0.9), (1, 3, 1, 0.1), (1, 4, 3, 5.0), (1, 5, 2, None), (2, 9, 77, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0)]
    rows += [(4, i, i - 1 if i else None, 1.0) for i in range(40)]
    df = spark.createDataFrame([(t, n, p, "user", str(n), s) for t, n, p, s in rows], "tree long, node long, parent long, role string, text string, score double")
    made = chat.conversations(df, 2).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    got = {(r.tree, r["rank"]): [t.text for t in r.turns] for r in made}
    assert got == {(1, 1): ["1", "3", "4"], (1, 2): ["1", "2", "5"], (2, 1): ["9"], (4, 1): [str(i) for i in range(40)]}


PAGES = [
    (1, "http://a/\r\nX: y%", "<p>" + "a" * 2000), (2, None, "<p>" + "a" * 2000), (3, "u", "<p>" + "a" * 2000), (4, "u", "short"), (5, "u", "short"),
    (6, "u", None), (7, "u", ""), (None, "u", "<p>" + "a" * 2000), (8, "u", "é\r\n\r\n" * 100000), (8, "u", "é\r\n\r\n" * 100000), (9, "u", "b" * 999),
    (10, "u", "b" * 999),
]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    got = warc.archive(df).collect()
    assert len(got) == len(PAGES) and all(r.verified for r in got)
    text = {p: (h or "").encode() for p, _, h in PAGES}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(text[r.page_id]), hashlib.sha1(text[r.page_id]).hexdigest())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert {k: v for k, v in kinds.items() if v[0] == "revisit"} == {1: ("revisit", 3), 2: ("revisit", 3), None: ("revisit", 3)}
    assert [r.url for r in got if r.page_id == 1] == ["http://a/%0D%0AX: y%25"]
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_reads_urls_of_any_length(spark):
    import random

    rng = random.Random(3)
    url = "http://h/" + "".join(rng.choice("abcdefgh0123456789") for _ in range(3 << 20))
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, url, "<p>b</p>"), (3, "v", "<p>c</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive(df.coalesce(1)).collect()}
    assert sorted(got) == [1, 2, 3] and all(r.verified for r in got.values()) and got[2].url == url


def test_warc_goes_on_after_damaged_members(spark, tmp_path):
    import os

    good = [warc.record(i, "u", os.urandom(90000) if i == 3 else b"y" * (50000 * i), None) for i in range(5)]
    torn = bytearray(good[3])
    torn[2000:2100] = b"\0" * 100
    cases = {
        "torn": [good[0], bytes(torn), good[2], good[4]], "cut": [good[1], good[3][: len(good[3]) // 2], good[2]],
        "junk": [b"junk" * 30, good[1], b"\x1f\x8b\x08junk", good[2]],
        "length": [gzip.compress(gzip.decompress(good[1]).replace(b"Content-Length: 50", b"Content-Length: 51")), good[0]],
    }
    for name, parts in cases.items():
        (tmp_path / name).write_bytes(b"".join(parts))
    df = spark.createDataFrame([(str(tmp_path / n),) for n in cases], "path string")
    got = defaultdict(list)
    for r in sorted(warc.read(df).collect(), key=lambda r: r.position):
        got[r.archive.rsplit("/", 1)[-1]].append(r.page_id if r.verified else r.record_type)
    assert got["torn"] == [0, "damaged", 2, 4] and got["cut"] == [1, "damaged", 2]
    assert got["junk"] == ["damaged", 1, "damaged", 2] and got["length"] == ["damaged", 0]


def test_warc_members_and_damage(spark, tmp_path):
    good = [warc.record(i, "u", b"x" * (70000 * i), None) for i in range(4)]
    plain = gzip.decompress(good[1])
    cases = {
        "good": b"".join(good), "short": b"".join(good)[:-20], "broken": good[0] + b"junk", "empty": b"",
        "digest": gzip.compress(plain.replace(b"sha1:", b"sha1:0", 1)) + good[2],
        "length": gzip.compress(plain.replace(b"Content-Length: 70", b"Content-Length: 71")),
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    df = spark.createDataFrame([(str(tmp_path / n), "x") for n in cases] + [(None, "x")], "path string, position string")
    got = defaultdict(list)
    for r in sorted(warc.read(df).collect(), key=lambda r: r.position):
        got[r.archive.rsplit("/", 1)[-1]].append((r.page_id, r.record_type, r.verified))
    sound = [(i, "response", True) for i in range(4)]
    assert got["good"] == sound and got["short"] == [*sound[:3], (None, "damaged", False)] and "empty" not in got
    assert got["broken"] == [sound[0], (None, "damaged", False)] and got["digest"] == [(1, "response", False), sound[2]]
    assert got["length"] == [(None, "damaged", False)]
