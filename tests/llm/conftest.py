import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, shard int, kept boolean, key string, row int, target string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def make(spark, rows):
    """Rows (doc_id, text, lang, source) as documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, None, 1.5, -1, 9, False, "k", 0, "t") for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, near copies."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(60)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None), (4, base, "en", "a"), (5, base, "en", None),
        (6, " ".join(near), "de", "b"), (7, base.upper(), "de", "b"), (8, prose(30_000), "en", "c"), (9, "one", "de", "c"), (10, "one two", None, "c"),
        (None, base, "en", "a"), (12, prose(40), "en", "é"), (12, prose(40), "en", "é"), (13, "Ａｂｃ  Straße", "de", "ü"), (14, "abc strasse", "de", "ü"),
    ]
    rows += [(100 + i, prose(20 + i), "en" if i % 2 else "de", "abc"[i % 3]) for i in range(30)]
    return [*rows, rows[3], rows[0]]


@pytest.fixture()
def edge(spark, edge_rows):
    return make(spark, edge_rows)


@pytest.fixture()
def empty(spark):
    return make(spark, [])
