import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows, and extra columns with names that operators use."""
    base = prose(120, 1)
    rows = [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base, None, "a", None),
        (3, None, "en", "b", 0),
        (4, "", "fr", None, 0),
        (5, " \n\t ", "fr", "b", 3),
        (None, "null id text with words enough", "en", "b", 3),
        (None, None, None, None, None),
        (6, prose(60_000, 2), "de", "c", 1),
        (7, "aaaa " * 3000, "de", "c", 1),
        (8, "été çà ñ 中文 😀 " * 40, "fr", "c", 1),
        (9, "x", "en", "a", 1),
    ]
    extra = "score double, kept boolean, id string, t long, g int, n string, hash int, topic string, weight int, spans string, host string, value int"
    return spark.createDataFrame([(*r, 1.0, True, "i", 1, 1, "n", 1, "t", 1, "s", "h", 1) for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
