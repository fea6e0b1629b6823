import random

import pytest

#: Names that operators use themselves.
CLASHING = {"component_id": "c", "score": "s", "key": "k", "start": "1", "row": "r", "features": "f", "depth": "d", "length": "l", "text_": "t"}


def prose(seed, count, stock="abcdefghijklmnop"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(stock) for _ in range(rng.randint(2, 7))) for _ in range(count))


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) with columns whose names operators use themselves."""
    def make(rows):
        extra = tuple(CLASHING.values())
        full = [(i, t, lang, source, None if t is None else len(t), *extra) for i, t, lang, source in rows]
        names = ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {names}")

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and very long texts, a repeated row, letterless and wordless texts."""
    long = prose(1, 60000)
    return documents([
        (0, long, "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, prose(2, 40), "en", None), (None, prose(3, 40), "en", "b"),
        (4, prose(2, 40), "de", "b"), (4, prose(2, 40), "de", "b"), (5, "12 34 56 !", "de", "b"), (6, " \t\n", "en", "b"),
        (7, "one two three", None, "c"), (8, "ONE two\tthree", "en", "c"), (9, "é中퟿ <|endoftext|> İ", "de", "c"),
    ])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
