"""Derived views for the checks: the same expressions run in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsluice.schema import CATEGORIES


def pick(place: str) -> str:
    whens = " ".join(f"WHEN {number} THEN '{name}'" for number, name in enumerate(CATEGORIES))
    return f"CASE {place} {whens} END"


def hundredths(factor: int) -> str:
    return f"CAST((doc_id * {factor}) % 100 AS DOUBLE) / 100"


# Columns of the table under the views.
LABEL, OTHER = "label_name", "other_name"
BASE = {LABEL: pick("(doc_id * 7) % 16"), OTHER: pick("(doc_id * 7 + 1) % 16")}
ML_CATEGORY = f"CASE WHEN doc_id % 5 = 0 THEN {OTHER} ELSE {LABEL} END"
LLM_CATEGORY = f"CASE WHEN doc_id % 7 = 0 THEN {OTHER} ELSE {LABEL} END"
CENTS = "lpad(CAST((doc_id * 61) % 100 AS STRING), 2, '0')"

DOC_META = {
    "doc_id": "doc_id",
    "content": "text",
    "lang": "lang",
    "source": "source",
    "file_size": "n_chars",
    "file_extension": "CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'TXT' END",
    "sender_email": (
        "CASE doc_id % 5 WHEN 0 THEN 'user@company.com' WHEN 1 THEN 'ops@mail.corp.example' "
        "WHEN 2 THEN 'a@b@example.org' WHEN 3 THEN 'no-at-sign' END"
    ),
    "ts_s": "1704067200 + doc_id * 420",
    "label": LABEL,
    "filename": (
        f"concat({LABEL}, CASE doc_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '.' END, "
        "CAST(2000 + doc_id % 25 AS STRING), '_v', CAST(doc_id % 9 AS STRING), "
        "CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TIF' WHEN 2 THEN '.docx' WHEN 3 THEN '.xlsx' "
        "WHEN 4 THEN '.png' WHEN 5 THEN '.pptx' ELSE '' END)"
    ),
    "ml_confidence": hundredths(37),
    "llm_confidence": hundredths(61),
    "load": hundredths(13),
}

ML_RESULTS = {
    "doc_id": "doc_id",
    "category": ML_CATEGORY,
    "confidence": hundredths(37),
    "processing_time_ms": "CAST(doc_id % 20 AS DOUBLE) / 4",
    "cost": "CASE WHEN doc_id % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END",
    "ts_s": "1704067200 + doc_id * 420",
}

# The calls for documents of one source failed, so they have no result.
LLM_RESULTS = {
    "doc_id": "doc_id",
    "category": LLM_CATEGORY,
    "confidence": hundredths(61),
    "processing_time_ms": "CAST(500 + (doc_id * 13) % 500 AS DOUBLE)",
    "cost": "CASE WHEN doc_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END",
    "ts_s": "1704067200 + doc_id * 420",
    "original_length": "n_chars",
    "sample_length": "least(n_chars, 2000)",
}
LLM_ANSWERED = "source <> 'src3'"

LLM_ANSWERS = {
    "doc_id": "doc_id",
    "call_error": f"CASE WHEN {LLM_ANSWERED} THEN NULL ELSE 'call failed' END",
    "response": (
        "CASE doc_id % 8 "
        f"WHEN 0 THEN concat('{{\"category\": \"', {LABEL}, '\", \"confidence\": 0.', {CENTS}, ', \"reasoning\": \"clear\"}}') "
        f"WHEN 1 THEN concat('Here it is: {{\"category\": \"', {LABEL}, '\", \"confidence\": 0.', {CENTS}, '}} as asked.') "
        f"WHEN 2 THEN concat('{{\"category\": \"', {LABEL}, '\", \"confidence\": \"0.', {CENTS}, '\"}}') "
        f"WHEN 3 THEN concat('{{\"category\": \"', {LABEL}, '\", \"confidence\": 0.', {CENTS}, '}} or {{}}') "
        f"WHEN 4 THEN concat('Category: ', upper({LABEL}), ', Confidence: 0.', {CENTS}) "
        "WHEN 5 THEN 'I cannot say.' "
        f"WHEN 6 THEN concat('{{\"category\": \"contract\", \"confidence\": 1.', {CENTS}, '}}') "
        f"ELSE concat('{{\"category\": \"', upper({LABEL}), '\", \"confidence\": 0.', {CENTS}, ', \"reasoning\": \"mixed case\"}}') END"
    ),
}

ROUTING_ANSWERS = {
    "doc_id": "doc_id",
    "response": (
        "CASE doc_id % 4 WHEN 0 THEN 'ROUTE: ML because it is simple' WHEN 1 THEN 'route: llm, it is hard' "
        "WHEN 2 THEN 'ROUTE: LLM or ROUTE: ML' ELSE 'no idea' END"
    ),
}

ROUTES = {
    "doc_id": "doc_id",
    "ts_s": "1704067200 + doc_id * 420",
    "decision": f"CASE WHEN {hundredths(37)} < 0.35 THEN 'LLM' ELSE 'ML' END",
    "predicted": hundredths(37),
    "threshold": "CAST(60 + (doc_id % 4) * 5 AS DOUBLE) / 100",
    "decision_time_ms": "CAST(doc_id % 10 AS DOUBLE)",
}

# Results of a batch: one row in nine failed.
BATCH = {
    "doc_id": "doc_id",
    "path": f"concat('/inbox/', lang, '/', {LABEL}, '.', CAST(doc_id AS STRING), '.txt')",
    "content": "text",
    "category": f"CASE WHEN doc_id % 9 <> 0 THEN {ML_CATEGORY} END",
    "confidence": f"CASE WHEN doc_id % 9 <> 0 THEN {hundredths(37)} END",
    "decision": "CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'LLM' ELSE 'ML' END END",
    "processing_time_ms": "CAST(doc_id % 20 AS DOUBLE) / 4",
    "predicted": hundredths(61),
    "reasoning": "CASE WHEN doc_id % 9 <> 0 THEN concat('looks like ', lang) END",
    "sender_email": "CAST(NULL AS STRING)",
    "file_size": "n_chars",
    "file_extension": "'txt'",
    "error": "CASE WHEN doc_id % 9 = 0 THEN 'broken file' END",
}

HISTORY = {
    "doc_id": "doc_id",
    "ts_s": "1704067200 + doc_id * 420",
    "actual_confidence": hundredths(61),
    "total_time_ms": "CAST(doc_id % 50 AS DOUBLE) / 2",
}

# Predictions of two models on a split of the documents.
PREDICTIONS_ONE = {
    "doc_id": "doc_id",
    "label": LABEL,
    "prediction": ML_CATEGORY,
    "model": "'first'",
    "split": "CASE WHEN doc_id % 5 < 4 THEN 'train' ELSE 'test' END",
}
PREDICTIONS_TWO = {**PREDICTIONS_ONE, "prediction": LLM_CATEGORY, "model": "'second'"}

VIEWS: dict[str, tuple[dict[str, str], str]] = {
    "doc_meta": (DOC_META, "TRUE"),
    "ml_results": (ML_RESULTS, "TRUE"),
    "llm_results": (LLM_RESULTS, LLM_ANSWERED),
    "llm_answers": (LLM_ANSWERS, "TRUE"),
    "routing_answers": (ROUTING_ANSWERS, "TRUE"),
    "routes": (ROUTES, "TRUE"),
    "batch": (BATCH, "TRUE"),
    "history": (HISTORY, "TRUE"),
    "predictions_one": (PREDICTIONS_ONE, "TRUE"),
    "predictions_two": (PREDICTIONS_TWO, "TRUE"),
}


def spark_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    columns, condition = VIEWS[name]
    documents = spark.read.parquet(f"{folder}/documents.parquet").filter(condition)
    based = documents.selectExpr("*", *[f"{rule} AS {column}" for column, rule in BASE.items()])
    return based.selectExpr(*[f"{rule} AS {column}" for column, rule in columns.items()])


def sql_views(*names: str) -> str:
    """`WITH RECURSIVE name AS (...), ...` for DuckDB, to be followed by more views or a SELECT."""
    base = ", ".join(f"{rule} AS {column}" for column, rule in BASE.items())
    parts = []
    for name in names:
        columns, condition = VIEWS[name]
        chosen = ", ".join(f"{rule} AS {column}" for column, rule in columns.items())
        parts.append(f"{name} AS (SELECT {chosen} FROM labelled_documents WHERE {condition})")
    return f"WITH RECURSIVE labelled_documents AS (SELECT *, {base} FROM documents),\n" + ",\n".join(parts)


# One row per event: the request stream of the router.
EVENT_ROWS = """
event_rows AS (
  SELECT event_id AS doc_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
    CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS predicted,
    CAST((event_id * 13) % 100 AS DOUBLE) / 100 AS load,
    CASE WHEN event_id % 19 = 0 THEN 'LLM' WHEN event_id % 23 = 0 THEN 'ML' END AS forced
  FROM events)
"""


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet").selectExpr(
        "event_id AS doc_id",
        "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS ts_s",
        "CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS predicted",
        "CAST((event_id * 13) % 100 AS DOUBLE) / 100 AS load",
        "CASE WHEN event_id % 19 = 0 THEN 'LLM' WHEN event_id % 23 = 0 THEN 'ML' END AS forced",
    )
