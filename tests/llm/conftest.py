import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def invented(rng: random.Random, n: int, letters: str = "thedanorsi") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs."""

    def make(rows):
        full = [(i, t, None, "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
