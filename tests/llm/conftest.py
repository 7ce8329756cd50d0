import random

import pytest

SYLLABLES = "an be ti on er ver sche ion que la re do sa lu mi ko ra ten der ung".split()


@pytest.fixture
def words():
    """A maker of made-up prose: words(rng, n)."""

    def make(rng: random.Random, n: int) -> str:
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 2, 3)))) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) rows; with columns whose names clash with those operators use."""

    def make(rows):
        full = [(i, t, "en", "src", None if t is None else len(t), 1, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score int, node string")

    return make
