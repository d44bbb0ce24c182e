"""Categories, keyword lists and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The categories in their fixed order and the file-name keywords of each.
CATEGORY_KEYWORDS: dict[str, list[str]] = {
    "letter": ["letter", "correspondence", "business_letter", "formal_letter"],
    "form": ["form", "application", "registration_form", "survey_form"],
    "email": ["email", "mail", "correspondence", "communication"],
    "handwritten": ["handwritten", "note", "manuscript", "written"],
    "advertisement": ["advertisement", "ad", "marketing", "promotion"],
    "scientific_report": ["scientific_report", "research_report", "study_report", "analysis_report"],
    "scientific_publication": ["publication", "paper", "article", "research_paper"],
    "specification": ["specification", "tech_spec", "product_spec", "technical_spec"],
    "file_folder": ["folder", "directory", "file_organizer", "document_folder"],
    "news_article": ["news_article", "article", "news", "press_article"],
    "budget": ["budget", "financial_budget", "budget_plan", "budget_report"],
    "invoice": ["invoice", "bill", "receipt", "payment_invoice"],
    "presentation": ["presentation", "slides", "deck", "powerpoint"],
    "questionnaire": ["questionnaire", "survey", "poll", "feedback_form"],
    "resume": ["resume", "cv", "application", "curriculum_vitae"],
    "memo": ["memo", "memorandum", "internal_memo", "business_memo"],
}

CATEGORIES: list[str] = list(CATEGORY_KEYWORDS)
DEFAULT_CATEGORY = "letter"

METADATA_FIELDS = ["sender_email", "file_extension", "file_size", "timestamp", "source_system"]

METADATA_TYPE = T.StructType(
    [
        T.StructField("sender_email", T.StringType()),
        T.StructField("file_extension", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("source_system", T.StringType()),
    ]
)

FEATURES_TYPE = T.StructType(
    [
        T.StructField("word_count", T.LongType()),
        T.StructField("sentence_count", T.LongType()),
        T.StructField("avg_word_length", T.DoubleType()),
        T.StructField("tech_term_density", T.DoubleType()),
        T.StructField("formatting_complexity", T.DoubleType()),
        T.StructField("has_tables", T.BooleanType()),
        T.StructField("has_mixed_content", T.BooleanType()),
        T.StructField("file_extension", T.StringType()),
        T.StructField("sender_domain", T.StringType()),
        T.StructField("is_internal", T.BooleanType()),
        T.StructField("semantic_similarity_flag", T.BooleanType()),
    ]
)

FEATURE_NAMES = FEATURES_TYPE.fieldNames()

# One routing example; `timestamp` is epoch seconds.
EXAMPLE_TYPE = T.StructType(
    [
        T.StructField("routing_decision", T.StringType()),
        T.StructField("features", FEATURES_TYPE),
        T.StructField("ml_confidence", T.DoubleType()),
        T.StructField("llm_confidence", T.DoubleType()),
        T.StructField("ml_correct", T.BooleanType()),
        T.StructField("llm_correct", T.BooleanType()),
        T.StructField("actual_category", T.StringType()),
        T.StructField("processing_time_ml", T.DoubleType()),
        T.StructField("processing_time_llm", T.DoubleType()),
        T.StructField("cost_ml", T.DoubleType()),
        T.StructField("cost_llm", T.DoubleType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)

# One line of the feedback log: any kind of feedback, fields of the other kinds null.
FEEDBACK_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("metadata", METADATA_TYPE),
        T.StructField("predicted_category", T.StringType()),
        T.StructField("correct_category", T.StringType()),
        *EXAMPLE_TYPE.fields,
    ]
)

GROUND_TRUTH_TYPE = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("metadata", METADATA_TYPE),
        T.StructField("true_category", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)

LABELLED_NAMES_TYPE = T.StructType(
    [T.StructField("filename", T.StringType()), T.StructField("label", T.StringType())]
)
