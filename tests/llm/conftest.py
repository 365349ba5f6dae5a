from __future__ import annotations

import random

import pytest

# columns whose names the operators use inside
CLASH = {"_d": 1, "_id": 2, "_text": "x", "digest": "y", "token": 3, "n": 4, "root": 5, "d_0": 6, "_h": 7, "_spans": 8}


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) pairs, with further columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
            f"{c} {'string' if isinstance(v, str) else 'int'}" for c, v in CLASH.items()
        )
        return spark.createDataFrame(
            [(i, t, None if i == 3 else "en", None if i == 4 else "s", len(t or ""), *CLASH.values()) for i, t in rows], schema
        )

    return make


@pytest.fixture(scope="session")
def prose():
    """A maker of random prose."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 5))) for _ in range(n))

    return make
