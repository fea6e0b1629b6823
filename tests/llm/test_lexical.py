"""Ranked lexical search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from freshet.llm import common, lexical

from .conftest import CLASHING, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k):
    """All items against all documents, one by one."""
    bags = [(i, split(t)) for i, t in docs]
    count, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    frequency = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            tf, score = Counter(bag), 0
            for t in split(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * frequency[t] + 1)))
                    score += w * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * (25 + (75 * len(bag) * count) // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def asked(spark):
    def make(items):
        names = ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame([(*i, *CLASHING.values()) for i in items], f"item_id long, text string, {names}")

    return make


def table(documents, docs):
    return documents([(i, t, "en", "s") for i, t in docs])


DOCS = [(i, prose(i, random.Random(i).randint(1, 120), "abc")) for i in range(300)]
#: Copies that tie, more of them than ranks, under ids out of order.
DOCS += [(1000 - i, prose(7, 60, "abc")) for i in range(40)] + [(i, prose(i, 30, "abc")) for i in (3, 3, 5)]
ITEMS = [(i, prose(1000 + i, 25, "abc")) for i in range(12)] + [(50, prose(7, 60, "abc")), (51, "AB ab Ab-bA 12"), (52, "zzz"), (53, "")]


def test_search_matches_brute_force(documents, asked):
    assert rows(lexical.search(asked(ITEMS), table(documents, DOCS))) == brute(ITEMS, DOCS, 10)


def test_small_segments_and_blocks_give_the_same(documents, asked, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 37)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 900)
    monkeypatch.setattr(common, "SLICE", 64)
    assert rows(lexical.search(asked(ITEMS), table(documents, DOCS), 7)) == brute(ITEMS, DOCS, 7)


def test_odd_rows(documents, asked):
    long = prose(1, 60000)
    docs = [(1, long), (2, None), (3, ""), (None, "one two"), (4, "one two"), (5, "one two"), (6, "Ünï é中 a_b"), (7, " \t--")]
    items = [(1, "ONE two two"), (2, "é中 b"), (3, None), (4, long[:3000])]
    repeated = [(None, "one"), (1, "zz"), (1, None)]
    assert rows(lexical.search(asked(items + repeated), table(documents, docs))) == brute(items, docs, 10)


def test_empty_tables(documents, asked, nothing):
    assert rows(lexical.search(asked(ITEMS), nothing)) == []
    assert rows(lexical.search(asked([]), table(documents, DOCS))) == []


def segment(seed, size, terms):
    rng = np.random.default_rng(seed)
    owner, term = np.nonzero(rng.random((size, terms)) < 0.3)
    tf = rng.integers(1, 5, len(owner))
    impact = rng.integers(1, 1000, len(owner))
    length = rng.integers(1, 100, size)
    return lexical.Segment(np.arange(size), np.ones(size, bool), owner, term + 1, tf, impact, length), owner, term + 1, impact


def test_range_maxima_equal_plain_ones():
    made, *_ = segment(1, 200, 6)
    rng = np.random.default_rng(2)
    terms = np.arange(1, 7)
    for _ in range(50):
        a, b = np.sort(rng.integers(0, 201, 2))
        low, high = (made.positions(terms, np.array([x])) for x in (a, b))
        bound, at = made.maxima(low, high, np.ones(6, np.int64))
        parts = [made.impact[x:y] for x, y in zip(low[0], high[0], strict=True)]
        assert bound[0] == sum(p.max(initial=0) for p in parts)
        assert at[0] == -1 or a <= at[0] < b


def test_search_leaves_most_documents_unscored():
    size = 4000
    rng = np.random.default_rng(4)
    owner, term = np.nonzero(rng.random((size, 8)) < 0.05)
    impact = rng.integers(1, 1000, len(owner))
    best = np.arange(8) * 17
    owner, term = np.r_[owner, np.repeat(best, 8)], np.r_[term, np.tile(np.arange(8), 8)]
    impact = np.r_[impact, np.full(64, 2000)]
    pairs = np.unique(owner * 8 + term, return_index=True)[1]
    owner, term, impact = owner[pairs], term[pairs], impact[pairs]
    impact[np.isin(owner, best)] = 2000
    made = lexical.Segment(np.arange(size), np.ones(size, bool), owner, term + 1, np.ones(len(owner), np.int64), impact, np.arange(size))
    found, score, scored = made.search(np.arange(1, 9), np.ones(8, np.int64), 8)
    assert sorted(made.ids[found]) == best.tolist() and (score == 16000).all()
    assert scored < size / 8
