from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_uid string, sig string, kept boolean"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with columns whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or ""), "u", "g", True) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Invented prose from a seed: n words."""

    def make(seed, n, alphabet="abcdefgh"):
        r = random.Random(seed)
        return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))

    return make
