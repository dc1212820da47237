from __future__ import annotations

import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a documents table, with extra columns whose names operators use inside."""

    def make(rows):
        clashing = "row long, id string, doc long, fp string, pattern string, leaks string, spans string, label string, score string, simplified string, taken string"
        full = [(i, t, "en", "s", len(t or ""), 1, "x", 1, "x", "x", "x", "x", "x", "x", "x", "x") for i, t in rows]
        return spark.createDataFrame(full, f"{DOCUMENT}, {clashing}")

    return make


@pytest.fixture
def prose():
    """Seeded texts of made-up words."""

    def make(n, seed=0, words=40):
        draw = random.Random(seed)
        stock = ["".join(draw.choice("bdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(400)]
        return [" ".join(draw.choice(stock) for _ in range(draw.randint(words // 2, words))) for _ in range(n)]

    return make
