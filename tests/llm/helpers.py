"""Small document tables with the odd rows that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark int, id long, kept string"


def documents(spark, rows, schema=DOCS):
    """Rows (doc_id, text) or (doc_id, text, lang); the other columns are there to clash with names inside operators."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", 0, 1, 2, "x") for r in rows]
    return spark.createDataFrame(full, schema)


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows(rng: random.Random):
    """Null and empty texts, a null number, repeated rows, ties, a very long text."""
    long = " ".join(words(rng, 30_000, 10**6))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "One two"), (7, "one two"),
        (None, "a text without a number here"), (8, long), (9, long + " more"), (10, "same row twice over and over"),
        (10, "same row twice over and over"), (11, "\x00 odd \x1f bytes é ß Ä"), (12, "!!! ... ???"),
    ]
