from __future__ import annotations

import random

import pytest

SYLLABLES = "ka lo mi ren tus vor bel dan sho qui ze par nim gol fe".split()


class Prose:
    """Invented text from a seed."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randrange(1, 4)))

    def words(self, n: int) -> list[str]:
        return [self.word() for _ in range(n)]

    def text(self, n: int) -> str:
        return " ".join(self.words(n))

    def changed(self, text: str, share: float) -> str:
        return " ".join(self.word() if self.rng.random() < share else w for w in text.split(" "))


@pytest.fixture
def prose():
    return Prose(7)


#: Columns that operators use inside, and whose names a table may have too.
CLASHING = "node component k1 k2 sig key n a b x y id place count slot shard lang score gone w value".split()


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) or (doc_id, text, lang) as a table with clashing extra columns."""

    def make(rows):
        rows = [(*r, "en")[:3] for r in rows]
        df = spark.createDataFrame([(i, t, k, "src", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
        extra = [c for c in CLASHING if c not in df.columns]
        return df.selectExpr("*", *[f"'extra' AS `{c}`" for c in extra])

    return make
