"""Operators over documents and classification results.

Results have the columns doc_id, category, confidence, processing_time_ms and cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.functions.results import clamp, normalize_category, result_line
from docsluice.functions.text import is_blank, preview

# Fixed value: callers compare with it.
EMPTY_DOCUMENT = "Empty document content"

# Columns of a detailed result, in the order they are shown; what is null is left out.
DETAILS = (
    "path", "category", "confidence", "decision", "predicted", "processing_time_ms", "file_size",
    "file_extension", "reasoning", "error",
)


def check_documents(docs: DataFrame, content: str = "content") -> DataFrame:
    """Adds `error`, set for documents without any text."""
    return docs.withColumn("error", F.when(is_blank(F.col(content)), EMPTY_DOCUMENT))


def keep_or_drop(results: DataFrame, mode: str = "keep") -> DataFrame:
    """All rows, or only those without an error."""
    if mode not in ("keep", "drop"):
        raise ValueError("mode must be keep or drop")
    return results if mode == "keep" else results.filter(F.col("error").isNull())


def normalize_results(results: DataFrame) -> DataFrame:
    return results.withColumns(
        {"category": normalize_category(F.col("category")), "confidence": clamp(F.col("confidence"))}
    )


def project_results(results: DataFrame, detailed: bool = False) -> DataFrame:
    """The reported columns; `detailed` adds confidence forecast, reasoning, preview and metadata."""
    columns = [
        F.col("path"),
        F.col("category"),
        F.col("confidence"),
        F.col("decision").alias("classifier_used"),
        F.col("processing_time_ms"),
        F.length("content").cast("long").alias("content_length"),
        F.col("file_size"),
        F.col("file_extension"),
    ]
    if detailed:
        columns += [
            F.col("predicted").alias("predicted_ml_confidence"),
            F.col("reasoning"),
            preview(F.col("content")).alias("content_preview"),
            F.to_json(F.struct("sender_email", "file_extension", "file_size")).alias("metadata"),
        ]
    return results.select(*columns)


def format_results(results: DataFrame, style: str = "text") -> DataFrame:
    """Adds `line`: one line of text, several lines (`detailed`) or a JSON object per result."""
    if style not in ("text", "detailed", "json"):
        raise ValueError("style must be text, detailed or json")
    if style == "json":
        return results.withColumn("line", F.to_json(F.struct(*results.columns)))
    if style == "detailed":
        shown = [name for name in DETAILS if name in results.columns]
        lines = [F.concat(F.lit(f"{name}: "), F.col(name).cast("string")) for name in shown]
        return results.withColumn("line", F.concat_ws("\n", *lines))
    line = result_line(*[F.col(name) for name in ("path", "category", "confidence", "decision", "error")])
    return results.withColumn("line", line)


def compare_classifiers(ml: DataFrame, llm: DataFrame) -> DataFrame:
    """Both results side by side for the documents that have both."""
    pairs = _pairs(ml, llm)
    return pairs.select(
        "doc_id",
        "ml_category",
        "ml_confidence",
        "llm_category",
        "llm_confidence",
        (F.col("ml_category") == F.col("llm_category")).alias("agreement"),
        F.abs(F.col("ml_confidence") - F.col("llm_confidence")).alias("confidence_diff"),
        (F.col("llm_time_ms") / F.greatest(F.col("ml_time_ms"), F.lit(1.0))).alias("speed_ratio"),
        (_known(F.col("llm_cost"), 0.01) / _known(F.col("ml_cost"), 0.001)).alias("cost_ratio"),
    )


def example_pairs(ml: DataFrame, llm: DataFrame) -> DataFrame:
    """Training examples from documents both classifiers answered: the surer one is the better route."""
    pairs = _pairs(ml, llm)
    agree = F.col("ml_category") == F.col("llm_category")
    return pairs.select(
        "doc_id",
        F.when(F.col("llm_confidence") > F.col("ml_confidence"), "LLM").otherwise("ML").alias("routing_decision"),
        "ml_confidence",
        "llm_confidence",
        agree.alias("ml_correct"),
        agree.alias("llm_correct"),
        F.col("ml_category").alias("actual_category"),
        F.col("ml_time_ms").alias("processing_time_ml"),
        F.col("llm_time_ms").alias("processing_time_llm"),
        _known(F.col("ml_cost"), 0.001).alias("cost_ml"),
        _known(F.col("llm_cost"), 0.01).alias("cost_llm"),
    )


def comparative_feedback(ml: DataFrame, llm: DataFrame, hashes: DataFrame, truth: DataFrame) -> DataFrame:
    """Correctness of both classifiers against the ground truth of the content, null where there is none.

    `hashes` has doc_id and content_hash, and `features`, `metadata` and `timestamp` if
    they are to be kept; `truth` one row (content_hash, true_category) per content.
    """
    described = [name for name in ("features", "metadata", "timestamp") if name in hashes.columns]
    known = hashes.join(truth.select("content_hash", "true_category"), "content_hash", "left")
    pairs = _pairs(ml, llm).join(known.select("doc_id", "true_category", *described), "doc_id", "left")
    true = F.lower(F.nullif(F.col("true_category"), F.lit("")))
    return pairs.select(
        "doc_id",
        F.lit("ML").alias("routing_decision"),
        "ml_confidence",
        "llm_confidence",
        (F.lower("ml_category") == true).alias("ml_correct"),
        (F.lower("llm_category") == true).alias("llm_correct"),
        F.coalesce(F.nullif(F.col("true_category"), F.lit("")), F.col("ml_category")).alias("actual_category"),
        F.col("ml_time_ms").alias("processing_time_ml"),
        F.col("llm_time_ms").alias("processing_time_llm"),
        _known(F.col("ml_cost"), 0.001).alias("cost_ml"),
        _known(F.col("llm_cost"), 0.01).alias("cost_llm"),
        *described,
    )


def by_route(routes: DataFrame, ml: DataFrame, llm: DataFrame) -> DataFrame:
    """The results of the classifier each document was sent to: doc_id, category, confidence, classifier_type."""
    parts = [
        rows.join(routes.filter(F.col("decision") == kind).select("doc_id"), "doc_id", "left_semi").select(
            "doc_id", "category", "confidence", F.lit(kind).alias("classifier_type")
        )
        for kind, rows in (("ML", ml), ("LLM", llm))
    ]
    return parts[0].unionByName(parts[1])


def fall_back(wanted: DataFrame, llm: DataFrame, ml: DataFrame) -> DataFrame:
    """For each wanted doc_id the costly result, or the cheap one where that failed."""
    names = ["category", "confidence", "cost"]
    costly = llm.select("doc_id", F.lit("LLM").alias("_used"), *[F.col(name).alias(f"_{name}") for name in names])
    joined = wanted.join(costly, "doc_id", "left").join(ml.select("doc_id", *names), "doc_id", "left")
    answered = F.col("_used").isNotNull()
    return joined.select(
        "doc_id",
        *[F.when(answered, F.col(f"_{name}")).otherwise(F.col(name)).alias(name) for name in names],
        F.coalesce(F.col("_used"), F.lit("ML")).alias("classifier_type"),
    )


def _pairs(ml: DataFrame, llm: DataFrame) -> DataFrame:
    sides = [
        side.select(
            "doc_id",
            F.col("category").alias(f"{name}_category"),
            F.col("confidence").alias(f"{name}_confidence"),
            F.col("processing_time_ms").alias(f"{name}_time_ms"),
            F.col("cost").alias(f"{name}_cost"),
        )
        for name, side in (("ml", ml), ("llm", llm))
    ]
    return sides[0].join(sides[1], "doc_id")


def _known(cost, default: float):
    """A missing or zero cost counts as the default."""
    return F.coalesce(F.nullif(cost, F.lit(0.0)), F.lit(default))
