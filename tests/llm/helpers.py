"""Small tables with the awkward rows that every operator must stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept string, bucket int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    words = ["".join(pick.choice("ba ce di fo gu la me ni po ru sa te vi".split()) for _ in range(2 + k % 3)) for k in range(vocabulary)]
    return " ".join(pick.choice(words) for _ in range(n))


def docs(spark, texts: list, start: int = 0, **columns):
    """Documents with clashing extra columns."""
    rows = [(start + i, t, columns.get("lang", "en"), columns.get("source", "s"), len(t or ""), 0.5, 7, "x", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", "   \n\t ", "one", "é", "!!! ???", "a" * 5000, "\n\n\n", "word " * 3000, "same text here", "same text here", "\x00\x1f odd"]


def awkward(spark):
    frame = docs(spark, AWKWARD)
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (None, "no id", None, None, 1, None, None, None, None), (9, "same text here", None, None, 1, None, None, None, None)], DOCS)
    return frame.unionByName(nulls)
