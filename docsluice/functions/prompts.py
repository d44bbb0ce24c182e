"""Questions for the external model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsluice.config import MAX_CHARS, ROUTING_CHARS
from docsluice.functions.text import sample_document
from docsluice.schema import CATEGORIES

# Fixed value: what stands for missing metadata.
NO_METADATA = "No metadata provided"


def metadata_json(**fields: Column) -> Column:
    """The known fields as JSON; null fields are left out, and no field at all gives a fixed text."""
    known = F.to_json(F.struct(*[column.alias(name) for name, column in fields.items()]))
    return F.when(known == "{}", F.lit(NO_METADATA)).otherwise(known)


def classification_prompt(content: Column, metadata: Column, max_chars: int = MAX_CHARS) -> Column:
    return F.concat(
        F.lit("Sort this document into exactly one category.\n\nCategories: " + ", ".join(CATEGORIES)),
        F.lit("\n\nMetadata: "),
        metadata,
        F.lit("\n\nText:\n"),
        sample_document(content, max_chars),
        F.lit(
            '\n\nAnswer with one JSON object: {"category": a name from the list, '
            '"confidence": a number from 0 to 1, "reasoning": one sentence}'
        ),
    )


def two_decimals(share: Column) -> Column:
    """A number that is not negative, with two decimals."""
    hundredths = F.round(share * 100).cast("long")
    whole = F.floor(hundredths / 100).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def routing_prompt(content: Column, features: dict[str, Column], predicted: Column) -> Column:
    """Question about the route of one document; the opening of the text is part of the question."""
    return F.concat(
        F.lit("Choose the classifier for this document: ML (cheap and fast) or LLM (costly, better on hard texts).\n\n"),
        F.lit("Opening:\n"),
        F.left(content, F.lit(ROUTING_CHARS)),
        F.format_string(
            "\n\nwords=%d technical=%s formatting=%s tables=%s mixed=%s type=%s expected_ml_confidence=%s",
            features["word_count"],
            two_decimals(features["tech_term_density"]),
            two_decimals(features["formatting_complexity"]),
            features["has_tables"].cast("string"),
            features["has_mixed_content"].cast("string"),
            features["file_extension"],
            two_decimals(predicted),
        ),
        F.lit(
            "\n\nSimple layout, a clear category or an expected confidence over 0.7 speak for ML; technical, "
            'mixed or ambiguous content or one under 0.5 speak for LLM. Answer "ROUTE: ML" or "ROUTE: LLM" and why.'
        ),
    )
