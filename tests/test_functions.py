"""Column functions against plain restatements of the rules, on awkward inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsluice.functions import text
from docsluice.functions.answers import parse_category_answer
from docsluice.functions.names import preprocess_filename, suffix
from docsluice.functions.prompts import metadata_json
from docsluice.functions.results import clamp, normalize_category
from docsluice.operators.features import with_features
from docsluice.operators.results import check_documents

TEXTS = [
    "",
    "   \n\t ",
    "123456789",
    "0123456789",
    "a.b.c.d.e.f.g.h",
    "." * 20,
    "   leading blanks and some more words.",
    "one\x1ctwo\x1dthree four five six",
    "| a | b |\n|---|---|\n| 1\t| 2 |",
    "line one\r\nline two\r\n\r\nline four",
    "no line break at all, suitable for one line",
    "x" * 2001,
    "short\n" + "long " * 40 + "\nshort",
    "ünïcödé wörds änd émojis \U0001f600 here. Yes.",
]


def restated(document: str) -> tuple:
    stripped = document.strip()
    if len(stripped) < 10:
        return (0, 1, 0.0, 0.0, 0.0, False, False, False)
    found = document.split()
    lines = [len(line.strip()) for line in document.split("\n") if line.strip()]
    mean = sum(lines) / len(lines)
    spread = sum((size - mean) ** 2 for size in lines) / len(lines) if len(lines) > 1 else 0.0
    marks = sum(document.count(mark) for mark in "\n\t") + 2 * document.count("|") + 0.1 * document.count("-")
    return (
        len(found),
        max(1, sum(1 for piece in document.split(".") if piece.strip())),
        round(sum(map(len, found)) / len(found), 6),
        round(sum(1 for word in found if len(word) > 8) / len(found), 6),
        round(marks / len(document), 6),
        any(mark in document for mark in "|\t") or "table" in document.lower(),
        spread > 500,
        len({len(word) for word in found[:50]}) > 10,
    )


def test_features_of_awkward_texts(spark):
    rows = [(place, content) for place, content in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, content string").selectExpr(
        "*", "'A@B@Mail.CORP.example' AS sender_email", "'' AS file_extension"
    )
    for row in with_features(docs).collect():
        found = row.features
        numbers = [round(found[name], 6) for name in ("avg_word_length", "tech_term_density", "formatting_complexity")]
        actual = (
            found.word_count,
            found.sentence_count,
            *numbers,
            found.has_tables,
            found.has_mixed_content,
            found.semantic_similarity_flag,
        )
        assert actual == restated(row.content), row.content
        assert (found.file_extension, found.sender_domain, found.is_internal) == ("txt", "Mail.CORP.example", True)


def test_missing_text_and_sender(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None)], "doc_id long, content string, sender_email string, file_extension string"
    )
    found = with_features(docs).first().features
    assert (found.word_count, found.sentence_count, found.sender_domain, found.is_internal) == (0, 1, "", False)
    assert check_documents(docs).first().error == "Empty document content"


def test_samples_break_at_words(spark):
    limit = 20
    rows = spark.createDataFrame([(content,) for content in TEXTS], "content string")
    for row in rows.select("content", text.sample_document(F.col("content"), limit).alias("sample")).collect():
        collapsed = " ".join(row.content.split())
        expected = collapsed
        if len(collapsed) > limit:
            expected = collapsed[:limit]
            if expected.rfind(" ") > limit * 0.8:
                expected = expected[: expected.rfind(" ")]
            expected += "..."
        assert row.sample == expected


def test_file_names(spark):
    cases = {
        "Invoice_2024-01.v2.PDF": ("invoice v", ".pdf"),
        "a..pdf": ("a", ".pdf"),
        ".bashrc": ("bashrc", ""),
        "...x": ("x", ""),
        "a.b/c": ("a bc", ""),
        "d.ir/.hid": ("d ir hid", ""),
        "a.b.c": ("a b", ".c"),
        "": ("", ""),
        "Ünder_score.txt": ("nder score", ".txt"),
    }
    rows = spark.createDataFrame([(name,) for name in cases], "name string")
    for row in rows.select(
        "name", preprocess_filename(F.col("name")).alias("text"), suffix(F.col("name")).alias("suffix")
    ).collect():
        assert (row.text, row.suffix) == cases[row.name], row.name


@pytest.mark.parametrize(
    ("response", "category", "confidence"),
    [
        ('{"category": "Memo", "confidence": 0.9}', "Memo", 0.9),
        ('so: {"category":"memo","confidence":"0.5"} ok', "memo", 0.5),
        ('{"category":"memo","confidence":0.9} tail }', "unknown", 0.0),
        ('{"category":"memo","confidence":0.9}{"category":"form","confidence":0.1}', "unknown", 0.0),
        ("{bad}", "unknown", 0.0),
        ("{'category': 'memo', 'confidence': 1}", "unknown", 0.0),
        ('{"category":"memo","confidence":"high"}', "unknown", 0.0),
        ('{"category":"memo"}', "unknown", 0.0),
        ("CATEGORY: Memo\nconfidence : 0.4", "memo", 0.4),
        ("category: memo confidence: 0.4.1", "unknown", 0.0),
        ("nothing", "unknown", 0.0),
        ('{"category":"memo",\n"confidence":0.25,\n"reasoning":"two\\nlines"}', "memo", 0.25),
        (None, "unknown", 0.0),
    ],
)
def test_answers(spark, response, category, confidence):
    row = spark.createDataFrame([(response,)], "response string").select(
        parse_category_answer(F.col("response")).alias("answer")
    )
    answer = row.first().answer
    assert (answer.category, answer.confidence) == (category, confidence)


def test_small_rules(spark):
    row = spark.range(1).select(
        normalize_category(F.lit("INVOICE")).alias("known"),
        normalize_category(F.lit("contract")).alias("unknown"),
        normalize_category(F.lit(None).cast("string")).alias("missing"),
        clamp(F.lit(1.5)).alias("high"),
        clamp(F.lit(-0.5)).alias("low"),
        metadata_json(a=F.lit(None).cast("string"), b=F.lit(3)).alias("some"),
        metadata_json(a=F.lit(None).cast("string")).alias("none"),
        text.preview(F.lit("x" * 201)).alias("cut"),
        text.decode_text(F.lit(b"A\xff\r\nB \r").cast("binary")).alias("latin"),
        text.decode_text(F.lit("  Ä\r\n".encode()).cast("binary")).alias("utf"),
    ).first()
    assert (row.known, row.unknown, row.missing) == ("invoice", "letter", "letter")
    assert (row.high, row.low) == (1.0, 0.0)
    assert (row.some, row.none) == ('{"b":3}', "No metadata provided")
    assert row.cut == "x" * 200 + "..."
    assert (row.latin, row.utf) == ("Aÿ\nB", "Ä")
