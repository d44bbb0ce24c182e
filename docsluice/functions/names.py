"""File-name rules as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsluice.functions.text import WHITESPACE_CLASS, normalize_ws
from docsluice.schema import CATEGORY_KEYWORDS

# A suffix counts only behind a character other than a dot in the last path segment.
NAME_WITH_SUFFIX = r"(?s)\A((?:.*/)?\.*[^./][^/]*)(\.[^./]*)\z"

# File types with a flag of their own.
FLAGGED_SUFFIXES = ["pdf", "tif", "png", "docx", "pptx", "xlsx"]


def suffix(name: Column) -> Column:
    """The lower-case suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, NAME_WITH_SUFFIX, 2))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def preprocess_filename(name: Column) -> Column:
    """The letters of a file name as lower-case words, without suffix."""
    stem = F.lower(F.regexp_replace(name, NAME_WITH_SUFFIX, "$1"))
    spaced = F.translate(stem, "._-", "   ")
    letters = F.regexp_replace(spaced, f"[^a-zA-Z{WHITESPACE_CLASS}]", "")
    return normalize_ws(letters)


def filename_features(name: Column, processed: Column) -> dict[str, Column]:
    """Columns derived from the original and the processed name."""
    found: dict[str, Column] = {
        "name_length": F.length(processed).cast("long"),
        "name_word_count": F.when(processed == "", 0).otherwise(F.size(F.split(processed, " "))).cast("long"),
        "has_numbers": name.rlike(r"\p{Nd}"),
        "has_underscore": F.contains(name, F.lit("_")),
        "has_hyphen": F.contains(name, F.lit("-")),
        "has_dot": F.contains(name, F.lit(".")),
    }
    lowered = F.lower(name)
    for kind in FLAGGED_SUFFIXES:
        found[f"extension_{kind}"] = F.endswith(lowered, F.lit(f".{kind}")).cast("long")
    return found


def keyword_flags(processed: Column) -> dict[str, Column]:
    """One boolean per category: does the processed name contain one of its keywords?"""
    flags = {}
    for category, keywords in CATEGORY_KEYWORDS.items():
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(processed, F.lit(keyword))
        flags[f"contains_{category}"] = hit
    return flags


def keyword_matches(processed: Column) -> Column:
    """Array of (category, keyword) pairs found in the processed name."""
    pairs = F.array(
        *[
            F.struct(F.lit(category).alias("category"), F.lit(keyword).alias("keyword"))
            for category, keywords in CATEGORY_KEYWORDS.items()
            for keyword in keywords
        ]
    )
    return F.filter(pairs, lambda pair: F.contains(processed, pair["keyword"]))
