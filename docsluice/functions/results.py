"""Result rules as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsluice.config import LLM_COST_MILLS, ML_COST_MILLS
from docsluice.functions.names import base_name
from docsluice.schema import CATEGORIES, DEFAULT_CATEGORY


def normalize_category(category: Column) -> Column:
    """Lower case; anything that is not a category becomes the default one."""
    lowered = F.lower(category)
    return F.when(lowered.isin(CATEGORIES), lowered).otherwise(F.lit(DEFAULT_CATEGORY))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value kept inside the range; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def cost_mills(decision: Column) -> Column:
    return F.when(decision == "LLM", F.lit(LLM_COST_MILLS)).otherwise(F.lit(ML_COST_MILLS)).cast("long")


def cost(decision: Column) -> Column:
    return cost_mills(decision) / F.lit(1000.0)


def result_line(path: Column, category: Column, confidence: Column, decision: Column, error: Column) -> Column:
    """One printable line per document."""
    line = F.format_string("%s -> %s (%.3f via %s)", base_name(path), category, confidence, decision)
    return F.when(error.isNull(), line).otherwise(F.concat(F.lit("ERROR processing "), path, F.lit(": "), error))
