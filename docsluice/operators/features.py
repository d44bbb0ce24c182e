"""Routing features of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions.names import filename_features, keyword_flags, preprocess_filename
from docsluice.functions.text import WHITESPACE, WHITESPACE_CLASS, occurrences, strip, words
from docsluice.schema import FEATURE_NAMES

# Parts of a sender domain that mark it as internal.
INTERNAL_DOMAIN = r"company|corp|internal|\.local"

VECTOR_NAMES = [
    "word_count",
    "sentence_count",
    "avg_word_length",
    "tech_term_density",
    "formatting_complexity",
    "has_tables",
    "has_mixed_content",
    "file_extension_pdf",
    "file_extension_docx",
    "file_extension_txt",
    "is_internal",
    "semantic_similarity_flag",
]


def with_features(
    df: DataFrame, content: str = "content", sender: str = "sender_email", extension: str = "file_extension"
) -> DataFrame:
    """Adds the struct `features`; one pass over the text, no shuffle."""
    text = F.coalesce(F.col(content), F.lit(""))
    # The arrays are columns of their own, so that the text is split once and not once per feature.
    parts = df.withColumn("_words", words(text)).withColumn(
        "_lines",
        F.filter(
            F.transform(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(WHITESPACE)))),
            lambda size: size > 0,
        ),
    )
    word, lines = F.col("_words"), F.col("_lines")

    usable = F.length(strip(text)) >= 10
    count = F.size(word)
    # A sentence begins at the first sign after a full stop that is not white space.
    sentences = F.regexp_count(text, F.lit(f"[^.{WHITESPACE_CLASS}][^.]*"))
    letters = F.length(F.array_join(word, ""))
    long_words = F.size(F.filter(word, lambda part: F.length(part) > 8))
    marks = (
        occurrences(text, "\n")
        + occurrences(text, "\t")
        + occurrences(text, "|") * 2
        + occurrences(text, "-") * F.lit(0.1).cast("double")
    )
    domain = F.when(
        F.contains(F.col(sender), F.lit("@")), F.substring_index(F.col(sender), "@", -1)
    ).otherwise("")
    columns = {
        "word_count": _for(usable, count.cast("long"), 0),
        "sentence_count": _for(usable, F.greatest(F.lit(1), sentences).cast("long"), 1),
        "avg_word_length": _for(usable, letters / count, 0.0),
        "tech_term_density": _for(usable, long_words / count, 0.0),
        "formatting_complexity": _for(usable, marks / F.length(text), 0.0),
        "has_tables": usable
        & (
            F.contains(text, F.lit("|"))
            | F.contains(text, F.lit("\t"))
            | F.contains(F.lower(text), F.lit("table"))
        ),
        "has_mixed_content": usable & _spread_exceeds(lines, 500.0),
        "file_extension": F.lower(F.coalesce(F.nullif(F.col(extension), F.lit("")), F.lit("txt"))),
        "sender_domain": domain,
        "is_internal": F.lower(domain).rlike(INTERNAL_DOMAIN),
        "semantic_similarity_flag": usable & (F.size(F.array_distinct(F.transform(F.slice(word, 1, 50), lambda part: F.length(part)))) > 10),
    }
    features = F.struct(*[columns[name].alias(name) for name in FEATURE_NAMES])
    return parts.withColumn("features", features).drop("_words", "_lines")


def _for(usable: Column, value: Column, otherwise: float) -> Column:
    return F.when(usable, value).otherwise(F.lit(otherwise))


def _spread_exceeds(values: Column, limit: float) -> Column:
    """Is the population variance of the array above the limit?"""
    count = F.size(values).cast("double")
    # n^2 * variance = n * sum of squares - square of sum: whole numbers, hence no rounding at the limit.
    return F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("squares")),
        lambda seen, value: F.struct(
            (seen["total"] + value).alias("total"), (seen["squares"] + value * value.cast("double")).alias("squares")
        ),
        lambda seen: count * seen["squares"] - seen["total"] * seen["total"] > count * count * limit,
    )


def feature_vector(features: Column) -> dict[str, Column]:
    """The twelve numbers the confidence predictor sees."""
    columns: dict[str, Column] = {}
    for name in VECTOR_NAMES:
        if name.startswith("file_extension_"):
            value = features["file_extension"] == name.removeprefix("file_extension_")
        else:
            value = features[name]
        columns[name] = value.cast("double") if name in VECTOR_NAMES[:5] else value.cast("int").cast("double")
    return columns


def with_filename_columns(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Adds `processed_text`, the file-name features and the keyword flags."""
    named = df.withColumn("processed_text", preprocess_filename(F.col(filename)))
    processed = F.col("processed_text")
    return named.withColumns(
        {**filename_features(F.col(filename), processed), **keyword_flags(processed)}
    )
