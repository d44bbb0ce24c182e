"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, fp string, word string, tag long, size long"

LONG = " ".join(f"word{n % 977}" for n in range(40_000))
PASSAGE = "the passage that stands in several texts " * 8


def rows() -> list[tuple]:
    texts = [
        (1, "The Cat sat on the mat."),
        (2, "the cat SAT on the mat."),
        (3, None),
        (4, ""),
        (None, "a text without a key"),
        (5, "   \t \n "),
        (6, LONG),
        (7, LONG.upper()),
        (8, "äöü ÄÖÜ ß 日本語 \U0001f600 é"),
        (8, "same key, other text"),
        (9, "repeated row"),
        (9, "repeated row"),
        (10, PASSAGE + "end one"),
        (11, "begin two " + PASSAGE),
        (12, "b" * 700),
        (13, "x"),
        (None, None),
    ]
    return [
        (key, text, "en" if place % 3 else None, None if place % 5 == 0 else f"s{place % 3}", 0, -1, "r", "f", "w", 7, 9)
        for place, (key, text) in enumerate(texts)
    ]


def frame(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
