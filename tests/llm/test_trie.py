"""The prefix trie against a plain one in Python."""

import random
import zlib
from hashlib import sha256

from freshet.llm import trie

from .conftest import prose


def brute_trie(rows):
    """Nodes of the rebuilt conversations of rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [n for n in nodes if n[: len(prefix)] == prefix]
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
            sum(len(n) == len(prefix) + 1 for n in below),
            sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below),
            sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            sha256(",".join(str(c) for c in sorted(members) if len(made[c]) == len(prefix)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, key string, place string, bytes string, depth string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "k", "p", "b", "d") for r in rows], SCHEMA)
    got = trie.prefix_trie(*trie.rebuilt(trie.in_order(df))).drop("key", "parent_key")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_trie_matches_brute_force(spark):
    rng = random.Random(3)
    stock = ["a", "é", "b c", "", None]
    rows = [
        (c, t if rng.random() < 0.9 else t + 100, rng.choice(["user", "assistant", None]) if t else "user", rng.choice(stock))
        for c in range(90) for t in range(rng.randint(1, 11))
    ]
    # a group of copies with a third of all conversations, also beyond a block of ends
    rows += [(1000 + c, t, "user", "same") for c in range(1200) for t in range(2)]
    assert found(spark, rows) == brute_trie(rows)


def test_odd_conversations(spark):
    long = prose(5, 60000)
    rows = [
        (None, 0, "user", "x"), (7, None, "user", "first"), (7, 0, None, None), (7, 1, "user", long), (7, 1, "user", long),
        (5, 0, "user", long), (6, 0, "user", "lost"), (11, 0, "a", "bc"), (12, 0, "ab", "c"), (13, 3, "", ""),
    ]
    rows += [(20, t, "user", f"turn {t}") for t in range(5000)]
    got = found(spark, rows)
    assert sum(r[1] == 0 for r in got) == 1
    small = [r for r in rows if r[0] != 20]
    assert found(spark, small) == brute_trie(small)
    assert max(r[1] for r in got) == 5000
    assert found(spark, []) == []


def test_sequences_and_ends(spark):
    rows = [(c, t, "user", x) for c, texts in [(1, "ab"), (2, "ab"), (3, "a"), (4, "abc"), (8, "x")] for t, x in enumerate(texts)]
    turns = trie.in_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ids = turns.select("conv_id").distinct()
    prefixes = trie.written(trie.prefixes(turns, ids), "test")
    got = {r.conv_id: (r.weight, r.length, r.leaf) for r in trie.sequences(prefixes).collect()}
    assert got == {1: (2, 2, False), 3: (1, 1, False), 4: (1, 3, True), 8: (1, 1, True)}
    ends = trie.end_lists(prefixes.where("last")).collect()
    assert sorted(r.ends for r in ends) == ["1,2", "3", "4", "8"]
