"""Reading the answers of the external model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where an answer keeps its parts.
JSON_OBJECT = r"(?s)\{.*\}"
CATEGORY_PAIR = r'(?i)category["\s]*:["\s]*([a-zA-Z_]+)'
CONFIDENCE_PAIR = r'(?i)confidence["\s]*:["\s]*([0-9.]+)'

# What stands for a missing category and a missing reason.
UNKNOWN = "unknown"
NO_REASON = "No reasoning provided"
BAD_ANSWER = "Parsing error: not a usable answer"

ANSWER_ARRAY = "array<struct<category:string,confidence:string,reasoning:string>>"


def parse_category_answer(response: Column) -> Column:
    """Struct (category, confidence, reasoning): JSON object, else `key: value` text, else unknown."""
    found = F.regexp_extract(response, JSON_OBJECT, 0)
    # Inside brackets a text with anything behind the object is no longer valid.
    parsed = F.from_json(F.concat(F.lit("["), found, F.lit("]")), ANSWER_ARRAY, {"allowSingleQuotes": "false"})
    answer = F.when(F.size(parsed) == 1, F.element_at(parsed, 1))
    from_json = _answer(answer["category"], answer["confidence"], F.coalesce(answer["reasoning"], F.lit(NO_REASON)))

    category = F.regexp_extract(response, CATEGORY_PAIR, 1)
    confidence = F.regexp_extract(response, CONFIDENCE_PAIR, 1)
    from_text = _answer(F.lower(category), confidence, response)

    return (
        F.when(response.isNull(), _fixed(F.lit(BAD_ANSWER)))
        .when(found != "", from_json)
        .when((category != "") & (confidence != ""), from_text)
        .otherwise(_fixed(response))
    )


def _answer(category: Column, confidence: Column, reasoning: Column) -> Column:
    number = confidence.try_cast("double")
    usable = category.isNotNull() & number.isNotNull() & ~F.isnan(number)
    return F.when(
        usable,
        F.struct(category.alias("category"), number.alias("confidence"), reasoning.alias("reasoning")),
    ).otherwise(_fixed(F.lit(BAD_ANSWER)))


def _fixed(reasoning: Column) -> Column:
    return F.struct(
        F.lit(UNKNOWN).alias("category"), F.lit(0.0).alias("confidence"), reasoning.alias("reasoning")
    )


def parse_routing_answer(response: Column, predicted: Column) -> Column:
    """Struct (decision, confidence) from the answer to a routing question."""
    upper = F.upper(F.coalesce(response, F.lit("ROUTE: ML")))
    to_ml = F.contains(upper, F.lit("ROUTE: ML"))
    to_llm = F.contains(upper, F.lit("ROUTE: LLM"))
    decision = F.when(to_ml, "ML").when(to_llm, "LLM").when(predicted < 0.6, "LLM").otherwise("ML")
    confidence = (
        F.when(to_ml, F.least(F.lit(0.9), predicted + 0.1))
        .when(to_llm, F.greatest(F.lit(0.1), predicted - 0.1))
        .otherwise(predicted)
    )
    return F.struct(decision.alias("decision"), confidence.alias("confidence"))
