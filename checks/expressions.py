"""Checks of projections, predicates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, r6, rounded
from checks.views import spark_view, sql_views
from docsluice.functions import text
from docsluice.functions.answers import parse_category_answer, parse_routing_answer
from docsluice.functions.names import keyword_matches, preprocess_filename
from docsluice.functions.prompts import routing_prompt
from docsluice.functions.results import clamp, cost_mills
from docsluice.operators.features import VECTOR_NAMES, feature_vector, with_features, with_filename_columns
from docsluice.operators.results import (
    check_documents,
    format_results,
    keep_or_drop,
    normalize_results,
    project_results,
)
from docsluice.plans.classify import category_prompts
from docsluice.schema import CATEGORIES, CATEGORY_KEYWORDS, FEATURE_NAMES

DOCS = sql_views("doc_meta")
KNOWN = ", ".join(f"'{category}'" for category in CATEGORIES)


@check(
    "valid_documents",
    DOCS + " SELECT doc_id, CASE WHEN trim(content, E' \\n\\t\\r') = '' THEN 'Empty document content' END AS error FROM doc_meta",
)
def valid_documents(spark, folder):
    return check_documents(spark_view(spark, folder, "doc_meta")).select("doc_id", "error")


@check(
    "normalize_result",
    sql_views("llm_answers")
    + f""", raw AS (SELECT doc_id, regexp_extract(response, '(?i)category["\\s]*:["\\s]*([a-zA-Z_]+)', 1) AS category,
      TRY_CAST(regexp_extract(response, '(?i)confidence["\\s]*:["\\s]*([0-9.]+)', 1) AS DOUBLE) AS confidence FROM llm_answers)
    SELECT doc_id, CASE WHEN lower(category) IN ({KNOWN}) THEN lower(category) ELSE 'letter' END AS category,
      round(CASE WHEN confidence IS NOT NULL THEN greatest(0.0, least(1.0, confidence)) END, 6) AS confidence FROM raw""",
)
def normalize_result(spark, folder):
    from docsluice.functions.answers import CATEGORY_PAIR, CONFIDENCE_PAIR

    raw = spark_view(spark, folder, "llm_answers").select(
        "doc_id",
        F.regexp_extract("response", CATEGORY_PAIR, 1).alias("category"),
        F.regexp_extract("response", CONFIDENCE_PAIR, 1).try_cast("double").alias("confidence"),
    )
    return rounded(normalize_results(raw), "confidence")


@check(
    "result_projection",
    sql_views("batch")
    + """ SELECT path, category, confidence, decision AS classifier_used, processing_time_ms,
      CAST(length(content) AS BIGINT) AS content_length, file_size, file_extension,
      predicted AS predicted_ml_confidence, reasoning,
      CASE WHEN length(content) > 200 THEN concat(left(content, 200), '...') ELSE content END AS content_preview,
      concat('{"file_extension":"txt","file_size":', CAST(file_size AS STRING), '}') AS metadata FROM batch""",
)
def result_projection(spark, folder):
    return project_results(spark_view(spark, folder, "batch"), detailed=True)


@check(
    "preview",
    DOCS
    + " SELECT doc_id, CASE WHEN length(content) > 200 THEN concat(left(content, 200), '...') ELSE content END AS preview FROM doc_meta",
)
def preview(spark, folder):
    return spark_view(spark, folder, "doc_meta").select("doc_id", text.preview(F.col("content")).alias("preview"))


@check("split_errors", sql_views("batch") + " SELECT doc_id, category, confidence FROM batch WHERE error IS NULL")
def split_errors(spark, folder):
    return keep_or_drop(spark_view(spark, folder, "batch"), "drop").select("doc_id", "category", "confidence")


@check(
    "format_result",
    sql_views("batch")
    + """ SELECT doc_id, CASE WHEN error IS NOT NULL THEN concat('ERROR processing ', path, ': ', error)
      ELSE concat(string_split(path, '/')[-1], ' -> ', category, ' (', printf('%.3f', confidence), ' via ', decision, ')') END AS line
      FROM batch""",
)
def format_result(spark, folder):
    return format_results(spark_view(spark, folder, "batch")).select("doc_id", "line")


@check(
    "clamp_load",
    DOCS + " SELECT doc_id, round(greatest(0.0, least(1.0, load * 1.6 - 0.3)), 6) AS load FROM doc_meta",
)
def clamp_load(spark, folder):
    raw = F.col("load") * F.lit(1.6) - F.lit(0.3)
    return spark_view(spark, folder, "doc_meta").select("doc_id", r6(clamp(raw)).alias("load"))


@check(
    "routing_cost",
    sql_views("routes")
    + " SELECT doc_id, CAST(CASE WHEN decision = 'LLM' THEN 10 ELSE 1 END AS BIGINT) AS cost_mills FROM routes",
)
def routing_cost(spark, folder):
    return spark_view(spark, folder, "routes").select("doc_id", cost_mills(F.col("decision")).alias("cost_mills"))


@check(
    "normalize_ws",
    DOCS + " SELECT doc_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS content FROM doc_meta",
)
def normalize_ws(spark, folder):
    return spark_view(spark, folder, "doc_meta").select("doc_id", text.normalize_ws(F.col("content")).alias("content"))


# The two sources of file names: the derived ones and the addresses of the web pages.
STEM = "regexp_replace(filename, '^((.*/)?\\.*[^./][^/]*)\\.[^./]*$', '\\1')"
PROCESSED = (
    f"trim(regexp_replace(regexp_replace(translate(lower({STEM}), '._-', '   '), '[^a-zA-Z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
)
NAMES = (
    DOCS
    + f""", processed AS (SELECT doc_id, filename, label, {PROCESSED} AS processed_text FROM doc_meta)"""
)


@check(
    "preprocess_filename",
    DOCS
    + f""", names AS (SELECT concat('d', CAST(doc_id AS STRING)) AS name_id, filename FROM doc_meta
      UNION ALL SELECT concat('p', CAST(page_id AS STRING)), url FROM pages)
    SELECT name_id, {PROCESSED} AS processed_text FROM names""",
)
def preprocess_names(spark, folder):
    names = spark_view(spark, folder, "doc_meta").selectExpr("concat('d', CAST(doc_id AS STRING)) AS name_id", "filename")
    pages = spark.read.parquet(f"{folder}/pages.parquet").selectExpr(
        "concat('p', CAST(page_id AS STRING)) AS name_id", "url AS filename"
    )
    return names.unionByName(pages).select(
        "name_id", preprocess_filename(F.col("filename")).alias("processed_text")
    )


FLAG_COLUMNS = """CAST(length(processed_text) AS BIGINT) AS name_length,
  CAST(CASE WHEN processed_text = '' THEN 0 ELSE len(string_split(processed_text, ' ')) END AS BIGINT) AS name_word_count,
  regexp_matches(filename, '[0-9]') AS has_numbers, contains(filename, '_') AS has_underscore,
  contains(filename, '-') AS has_hyphen, contains(filename, '.') AS has_dot, """ + ", ".join(
    f"CAST(CASE WHEN suffix(lower(filename), '.{kind}') THEN 1 ELSE 0 END AS BIGINT) AS extension_{kind}"
    for kind in ("pdf", "tif", "png", "docx", "pptx", "xlsx")
)
KEYWORD_COLUMNS = ", ".join(
    "(" + " OR ".join(f"contains(processed_text, '{keyword}')" for keyword in keywords) + f") AS contains_{category}"
    for category, keywords in CATEGORY_KEYWORDS.items()
)


@check("filename_features", NAMES + f" SELECT doc_id, processed_text, {FLAG_COLUMNS} FROM processed")
def filename_features(spark, folder):
    named = with_filename_columns(spark_view(spark, folder, "doc_meta").select("doc_id", "filename"))
    return named.drop("filename", *[f"contains_{category}" for category in CATEGORIES])


@check("keyword_flags", NAMES + f" SELECT doc_id, {KEYWORD_COLUMNS} FROM processed")
def keyword_flags(spark, folder):
    named = with_filename_columns(spark_view(spark, folder, "doc_meta").select("doc_id", "filename"))
    return named.select("doc_id", *[f"contains_{category}" for category in CATEGORIES])


KEYWORD_ROWS = ", ".join(
    f"('{category}', '{keyword}')" for category, keywords in CATEGORY_KEYWORDS.items() for keyword in keywords
)


@check(
    "keyword_join",
    NAMES
    + f""", keywords(category, keyword) AS (VALUES {KEYWORD_ROWS})
    SELECT doc_id, category, keyword FROM processed JOIN keywords ON contains(processed_text, keyword)""",
)
def keyword_join(spark, folder):
    processed = preprocess_filename(F.col("filename"))
    names = spark_view(spark, folder, "doc_meta").select("doc_id", processed.alias("processed_text"))
    return names.select("doc_id", F.explode(keyword_matches(F.col("processed_text"))).alias("match")).select(
        "doc_id", "match.category", "match.keyword"
    )


FEATURES = """, parts AS (SELECT *, length(trim(content, E' \\n\\t\\r')) >= 10 AS usable,
    list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '') AS words,
    list_filter(list_transform(string_split(content, chr(10)), lambda l: length(trim(l, E' \\n\\t\\r'))), lambda n: n > 0) AS lines,
    CASE WHEN contains(sender_email, '@') THEN string_split(sender_email, '@')[-1] ELSE '' END AS domain FROM doc_meta),
  features AS (SELECT doc_id, content, load, ml_confidence,
    CAST(CASE WHEN usable THEN len(words) ELSE 0 END AS BIGINT) AS word_count,
    CAST(CASE WHEN usable THEN greatest(1, len(list_filter(string_split(content, '.'), lambda s: trim(s, E' \\n\\t\\r') <> ''))) ELSE 1 END AS BIGINT) AS sentence_count,
    CASE WHEN usable THEN CAST(list_sum(list_transform(words, lambda w: length(w))) AS DOUBLE) / len(words) ELSE 0.0 END AS avg_word_length,
    CASE WHEN usable THEN CAST(len(list_filter(words, lambda w: length(w) > 8)) AS DOUBLE) / len(words) ELSE 0.0 END AS tech_term_density,
    CASE WHEN usable THEN (CAST(length(content) - length(replace(content, chr(10), '')) + length(content) - length(replace(content, chr(9), ''))
      + 2 * (length(content) - length(replace(content, '|', ''))) AS DOUBLE)
      + (length(content) - length(replace(content, '-', ''))) * CAST(0.1 AS DOUBLE)) / length(content) ELSE 0.0 END AS formatting_complexity,
    usable AND (contains(content, '|') OR contains(content, chr(9)) OR contains(lower(content), 'table')) AS has_tables,
    usable AND len(lines) > 1 AND coalesce(list_var_pop(lines), 0) > 500 AS has_mixed_content,
    lower(coalesce(nullif(file_extension, ''), 'txt')) AS file_extension,
    domain AS sender_domain,
    regexp_matches(lower(domain), 'company|corp|internal|\\.local') AS is_internal,
    usable AND len(list_distinct(list_transform(words[1:50], lambda w: length(w)))) > 10 AS semantic_similarity_flag
    FROM parts)"""
DOC_FEATURES = DOCS + FEATURES


@check(
    "doc_features",
    DOC_FEATURES
    + """ SELECT doc_id, word_count, sentence_count, round(avg_word_length, 6) AS avg_word_length,
      round(tech_term_density, 6) AS tech_term_density, round(formatting_complexity, 6) AS formatting_complexity,
      has_tables, has_mixed_content, file_extension, sender_domain, is_internal, semantic_similarity_flag,
      CAST(length(content) AS BIGINT) AS content_length FROM features""",
)
def doc_features(spark, folder):
    featured = with_features(spark_view(spark, folder, "doc_meta"))
    flat = featured.select("doc_id", "features.*", F.length("content").cast("long").alias("content_length"))
    return rounded(flat, "avg_word_length", "tech_term_density", "formatting_complexity")


VECTOR_SQL = ", ".join(
    f"CAST(file_extension = '{name.removeprefix('file_extension_')}' AS INTEGER) * CAST(1 AS DOUBLE) AS {name}"
    if name.startswith("file_extension_")
    else f"round(CAST({name} AS DOUBLE), 6) AS {name}"
    if name in VECTOR_NAMES[:5]
    else f"CAST(CAST({name} AS INTEGER) AS DOUBLE) AS {name}"
    for name in VECTOR_NAMES
)


@check("feature_vector", DOC_FEATURES + f" SELECT doc_id, {VECTOR_SQL} FROM features")
def vector(spark, folder):
    featured = with_features(spark_view(spark, folder, "doc_meta"))
    columns = feature_vector(F.col("features"))
    flat = featured.select("doc_id", *[column.alias(name) for name, column in columns.items()])
    return rounded(flat, *VECTOR_NAMES[:5])


def sample_sql(limit: int) -> str:
    collapsed = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"
    return f""", collapsed AS (SELECT *, {collapsed} AS body FROM doc_meta),
  cut AS (SELECT *, left(body, {limit}) AS head, {limit} - instr(reverse(left(body, {limit})), ' ') AS space FROM collapsed),
  sampled AS (SELECT *, CASE WHEN length(body) <= {limit} THEN body
    WHEN contains(head, ' ') AND space > {limit} * 0.8 THEN concat(left(head, space), '...') ELSE concat(head, '...') END AS sample FROM cut)"""


@check("sample_document", DOCS + sample_sql(200) + " SELECT doc_id, sample FROM sampled")
def sample_document(spark, folder):
    return spark_view(spark, folder, "doc_meta").select(
        "doc_id", text.sample_document(F.col("content"), 200).alias("sample")
    )


def prompt_sql() -> str:
    """The question as DuckDB builds it from `sampled`."""
    categories = ", ".join(CATEGORIES)
    fields = """concat('{', concat_ws(',', '"sender_email":"' || sender_email || '"',
      '"file_extension":"' || file_extension || '"', '"file_size":' || CAST(file_size AS STRING)), '}')"""
    return f"""concat('Sort this document into exactly one category.', chr(10), chr(10), 'Categories: {categories}',
      chr(10), chr(10), 'Metadata: ', {fields}, chr(10), chr(10), 'Text:', chr(10), sample, chr(10), chr(10),
      'Answer with one JSON object: {{"category": a name from the list, "confidence": a number from 0 to 1, "reasoning": one sentence}}')"""


@check("classification_prompt", DOCS + sample_sql(2000) + f" SELECT doc_id, {prompt_sql()} AS prompt FROM sampled")
def classification(spark, folder):
    return category_prompts(spark_view(spark, folder, "doc_meta"))


ROUTING_PROMPT_SQL = """concat('Choose the classifier for this document: ML (cheap and fast) or LLM (costly, better on hard texts).',
  chr(10), chr(10), 'Opening:', chr(10), left(content, 800), chr(10), chr(10),
  'words=', CAST(word_count AS STRING), ' technical=', {tech_term_density}, ' formatting=', {formatting_complexity},
  ' tables=', CAST(has_tables AS STRING), ' mixed=', CAST(has_mixed_content AS STRING), ' type=', file_extension,
  ' expected_ml_confidence=', {ml_confidence}, chr(10), chr(10),
  'Simple layout, a clear category or an expected confidence over 0.7 speak for ML; technical, ',
  'mixed or ambiguous content or one under 0.5 speak for LLM. Answer "ROUTE: ML" or "ROUTE: LLM" and why.')""".format(
    **{
        name: f"concat(CAST(CAST(round({name} * 100) AS BIGINT) // 100 AS STRING), '.', lpad(CAST(CAST(round({name} * 100) AS BIGINT) % 100 AS STRING), 2, '0'))"
        for name in ("tech_term_density", "formatting_complexity", "ml_confidence")
    }
)

@check("routing_prompt", DOC_FEATURES + f" SELECT doc_id, {ROUTING_PROMPT_SQL} AS prompt FROM features")
def routing_question(spark, folder):
    featured = with_features(spark_view(spark, folder, "doc_meta"))
    features = {name: F.col("features")[name] for name in FEATURE_NAMES}
    return featured.select(
        "doc_id", routing_prompt(F.col("content"), features, F.col("ml_confidence")).alias("prompt")
    )


PARSED = """, found AS (SELECT doc_id, response, regexp_extract(response, '(?s)\\{.*\\}') AS obj,
    regexp_extract(response, '(?i)category["\\s]*:["\\s]*([a-zA-Z_]+)', 1) AS category_text,
    regexp_extract(response, '(?i)confidence["\\s]*:["\\s]*([0-9.]+)', 1) AS confidence_text FROM llm_answers),
  tried AS (SELECT *, obj <> '' AND json_valid(obj) AS valid,
    CASE WHEN obj <> '' AND json_valid(obj) THEN json_extract_string(obj, '$.category') END AS json_category,
    CASE WHEN obj <> '' AND json_valid(obj) THEN TRY_CAST(json_extract_string(obj, '$.confidence') AS DOUBLE) END AS json_confidence,
    CASE WHEN obj <> '' AND json_valid(obj) THEN json_extract_string(obj, '$.reasoning') END AS json_reasoning FROM found),
  parsed AS (SELECT doc_id,
    CASE WHEN obj <> '' THEN CASE WHEN json_category IS NOT NULL AND json_confidence IS NOT NULL THEN json_category ELSE 'unknown' END
      WHEN category_text <> '' AND confidence_text <> '' AND TRY_CAST(confidence_text AS DOUBLE) IS NOT NULL THEN lower(category_text)
      ELSE 'unknown' END AS category,
    CASE WHEN obj <> '' THEN CASE WHEN json_category IS NOT NULL AND json_confidence IS NOT NULL THEN json_confidence ELSE 0.0 END
      WHEN category_text <> '' AND confidence_text <> '' THEN coalesce(TRY_CAST(confidence_text AS DOUBLE), 0.0)
      ELSE 0.0 END AS confidence,
    CASE WHEN obj <> '' THEN CASE WHEN json_category IS NOT NULL AND json_confidence IS NOT NULL
        THEN coalesce(json_reasoning, 'No reasoning provided') ELSE 'Parsing error: not a usable answer' END
      WHEN category_text <> '' AND confidence_text <> '' AND TRY_CAST(confidence_text AS DOUBLE) IS NULL THEN 'Parsing error: not a usable answer'
      ELSE response END AS reasoning FROM tried)"""


@check(
    "parse_llm_response",
    sql_views("llm_answers") + PARSED + " SELECT doc_id, category, round(confidence, 6) AS confidence, reasoning FROM parsed",
)
def parse_llm_response(spark, folder):
    answers = spark_view(spark, folder, "llm_answers")
    parsed = answers.select("doc_id", parse_category_answer(F.col("response")).alias("answer"))
    return rounded(parsed.select("doc_id", "answer.*"), "confidence")


ROUTE_ANSWER = """CASE WHEN contains(upper(response), 'ROUTE: ML') THEN 'ML' WHEN contains(upper(response), 'ROUTE: LLM') THEN 'LLM'
    WHEN p < 0.6 THEN 'LLM' ELSE 'ML' END"""
ROUTE_CONFIDENCE = """CASE WHEN contains(upper(response), 'ROUTE: ML') THEN least(0.9, p + 0.1)
    WHEN contains(upper(response), 'ROUTE: LLM') THEN greatest(0.1, p - 0.1) ELSE p END"""


@check(
    "parse_routing_response",
    sql_views("doc_meta", "routing_answers")
    + f""", both_rows AS (SELECT doc_id, ml_confidence AS p, response FROM doc_meta JOIN routing_answers USING (doc_id))
    SELECT doc_id, {ROUTE_ANSWER} AS decision, round({ROUTE_CONFIDENCE}, 6) AS confidence FROM both_rows""",
)
def parse_routing_response(spark, folder):
    rows = spark_view(spark, folder, "doc_meta").select("doc_id", "ml_confidence")
    joined = rows.join(spark_view(spark, folder, "routing_answers"), "doc_id")
    parsed = joined.select(
        "doc_id", parse_routing_answer(F.col("response"), F.col("ml_confidence")).alias("answer")
    )
    return rounded(parsed.select("doc_id", "answer.*"), "confidence")


@check("content_hash", DOCS + " SELECT doc_id, sha256(content) AS content_hash FROM doc_meta")
def content_hash(spark, folder):
    return spark_view(spark, folder, "doc_meta").select(
        "doc_id", text.content_hash(F.col("content")).alias("content_hash")
    )
