"""Rows that every operator must survive."""

from __future__ import annotations

import random

AWKWARD = [
    (1, None, "en", "a", None, "x"), (2, "", None, "a", 0, None), (3, "Hello WORLD ünï 42", "en", None, 18, "x"), (3, "Hello WORLD ünï 42", "en", None, 18, "x"),
    (None, "no id here at all", "en", "b", 17, "y"), (None, "no id here at all", "en", "b", 17, "y"), (4, "   \n\t ", "en", "b", 6, "z"), (5, "word " * 30_000, "en", "b", 150_000, "z"), (6, "   é É", "fr", "a", 6, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def awkward(spark):
    """Nulls, empties, repeats, a long text, and an extra column named like a result."""
    return spark.createDataFrame(AWKWARD, SCHEMA)


def prose(seed, n, low=5, high=60):
    rng = random.Random(seed)
    syllables = ["the", "an", "ti", "on", "re", "ed", "sh", "wh", "ou", "É", "ble"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(low, high))) for _ in range(n)]
