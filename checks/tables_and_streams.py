"""Checks of sources, sinks and streams: data derived from the given tables is written, read back and compared."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from checks import relations
from checks.registry import check, rounded, table
from checks.relations import EXAMPLE_SQL, JUDGED, PATH, UNION_SQL, tail_sql
from checks.routes import CONFIG, EVENTS, fold_sql
from checks.views import event_rows, spark_view, sql_views
from docsluice.config import RoutingConfig
from docsluice.functions.names import suffix
from docsluice.operators import feedback, metrics, results
from docsluice.operators.features import with_features
from docsluice.operators.routing import route_under_budget
from docsluice.plans import learning
from docsluice.session import fresh_path, reliable, stored_bytes
from docsluice.sources import files, tables
from docsluice.sources.json_items import json_items
from docsluice.sources.registry import published
from docsluice.sources.upserts import files_of
from docsluice.streaming import streams


def text_files(spark, folder):
    """Text files of a hundred documents each, in a folder of their own."""
    path = fresh_path(spark, "texts")
    documents = table(spark, folder, "documents").select("doc_id", "text", F.expr("doc_id div 100 AS part"))
    in_files = documents.repartition("part").sortWithinPartitions("part", "doc_id")
    in_files.select("part", "text").write.partitionBy("part").text(path)
    return path


def part_of(path):
    return F.regexp_extract(path, r"part=(\d+)/", 1).cast("long").alias("part")


PARTS = "WITH parts AS (SELECT doc_id // 100 AS part, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY 1)"


@check("scan_files", PARTS + " SELECT part, CAST(strlen(body) + 1 AS BIGINT) AS file_size, 'txt' AS file_extension FROM parts")
def scan_files(spark, folder):
    found = files.scan_files(spark, [f"{text_files(spark, folder)}/*"])
    return found.select(
        part_of("path"),
        F.col("length").alias("file_size"),
        F.regexp_replace(suffix(F.col("path")), r"\.", "").alias("file_extension"),
    )


@check("scan_text", PARTS + " SELECT part, trim(body, E' \\n\\t\\r') AS content FROM parts")
def scan_text(spark, folder):
    found = files.extract_documents(files.scan_files(spark, [f"{text_files(spark, folder)}/*"]))
    return found.select(part_of("path"), "content")


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text as the bytes of a word-processor file, one paragraph per line; every tenth file is cut short."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for batch in batches:
        data = []
        for number, text in zip(batch["doc_id"], batch["text"]):
            lines = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
            table_part = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
                package.writestr(
                    "word/document.xml",
                    f'<w:document xmlns:w="{space}"><w:body>{lines}{table_part}</w:body></w:document>',
                )
            content = buffer.getvalue()
            data.append(content[: len(content) // 2] if number % 10 == 0 else content)
        yield pd.DataFrame(
            {
                "path": [f"/inbox/{number}.docx" for number in batch["doc_id"]],
                "length": [len(content) for content in data],
                "content": data,
            }
        )


def docx_rows(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.mapInPandas(packed, "path string, length long, content binary")


@check(
    "scan_docx",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN trim(text, E' \\n\\t\\r') END AS content, doc_id % 10 = 0 AS failed FROM documents""",
)
def scan_docx(spark, folder):
    found = files.extract_documents(docx_rows(spark, folder))
    number = F.regexp_extract("path", r"(\d+)\.docx", 1).cast("long")
    return found.select(number.alias("doc_id"), "content", F.col("error").isNotNull().alias("failed"))


@check(
    "extract_documents",
    """SELECT concat('t', CAST(doc_id AS STRING)) AS name, 'md' AS file_extension, trim(text, E' \\n\\t\\r') AS content, CAST(NULL AS VARCHAR) AS error FROM documents
    UNION ALL SELECT concat('w', CAST(doc_id AS STRING)), 'docx', trim(text, E' \\n\\t\\r'), NULL FROM documents WHERE doc_id % 10 <> 0
    UNION ALL SELECT concat('p', CAST(page_id AS STRING)), 'pdf', upper(url), NULL FROM pages
    UNION ALL SELECT concat('x', CAST(page_id AS STRING)), 'html', trim(html, E' \\n\\t\\r'), NULL FROM pages""",
)
def extract_documents(spark, folder):
    """Plain texts, word-processor files, a format with a reader of the caller's, and an unknown one."""
    as_file = ["path", "length", "content"]
    plain = table(spark, folder, "documents").select(
        F.format_string("/inbox/t%d.MD", "doc_id").alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )
    word = docx_rows(spark, folder).select(F.replace("path", F.lit("/inbox/"), F.lit("/inbox/w")).alias("path"), "length", "content")
    pages = table(spark, folder, "pages")
    own = pages.select(
        F.format_string("/inbox/p%d.pdf", "page_id").alias("path"),
        F.octet_length("url").cast("long").alias("length"),
        F.encode("url", "UTF-8").alias("content"),
    )
    other = pages.select(
        F.format_string("/inbox/x%d.html", "page_id").alias("path"),
        F.octet_length("html").cast("long").alias("length"),
        F.encode("html", "UTF-8").alias("content"),
    )
    rows = plain.select(as_file).unionByName(word).unionByName(own).unionByName(other)
    found = files.extract_documents(rows, {"pdf": lambda data: data.decode().upper()})
    return results.keep_or_drop(found, "drop").select(
        F.regexp_extract("path", r"([a-z]\d+)\.", 1).alias("name"), "file_extension", "content", "error"
    )


@check(
    "scan_explicit_files",
    """WITH kinds AS (SELECT CASE page_id % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'TXT' WHEN 2 THEN 'csv' ELSE 'bin' END AS kind, url FROM pages)
    SELECT lower(kind) AS file_extension, CAST(sum(length(url) + 1) AS BIGINT) AS file_size, CAST(sum(length(url) + 1) - 1 AS BIGINT) AS characters
    FROM kinds WHERE kind <> 'csv' GROUP BY kind""",
)
def scan_explicit_files(spark, folder):
    """Files named by themselves or by a wildcard are read whatever their type; in a folder only supported types are; what is missing is left out."""
    path = fresh_path(spark, "kinds")
    pages = table(spark, folder, "pages")
    for place, kind in enumerate(("log", "TXT", "csv", "bin")):
        lines = pages.filter(F.col("page_id") % 4 == place).select("url").coalesce(1)
        lines.write.option("extension", kind).option("quote", "\u0000").csv(f"{path}/{kind}")
    one = spark.read.format("binaryFile").load(f"{path}/bin/*.bin").select("path").first().path
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = files.scan_files(spark, [f"{path}/log/*.log", f"{path}/TXT/*.TXT", f"{path}/csv", one, f"{path}/missing/*.txt"])
    texts = files.extract_documents(found)
    return texts.select("file_extension", "file_size", F.length("content").cast("long").alias("characters"))


@check("scan_labelled_csv", sql_views("doc_meta") + " SELECT filename, label FROM doc_meta")
def scan_labelled_csv(spark, folder):
    path = fresh_path(spark, "labelled")
    spark_view(spark, folder, "doc_meta").select("filename", "label").write.option("header", True).csv(path)
    return tables.read_labelled_names(spark, path)


@check("write_results", sql_views("batch") + " SELECT path, category, confidence, error FROM batch")
def write_results(spark, folder):
    path = fresh_path(spark, "results")
    tables.write_results(spark_view(spark, folder, "batch").select("path", "category", "confidence", "error"), path)
    return spark.read.schema("path string, category string, confidence double, error string").json(path)


def feedback_file(spark, folder):
    """The log with all kinds of feedback, appended kind by kind, and with broken lines among them."""
    path = fresh_path(spark, "feedback")
    # Narrow next to the texts, and needed for every kind.
    docs = reliable(with_features(spark_view(spark, folder, "doc_meta")).select("doc_id", "features"))
    for rows in (
        relations.performance_rows(spark, folder).join(docs, "doc_id"),
        relations.correction_rows(spark, folder).join(docs, "doc_id"),
        relations.comparative_rows(spark, folder).join(docs, "doc_id"),
    ):
        tables.append_feedback(feedback.feedback_log(rows), path)
    broken = table(spark, folder, "documents").select(
        F.concat(F.lit('{"type": "performance_feedback", "routing_decision": '), F.col("doc_id").cast("string"))
    )
    broken.write.mode("append").text(path)
    return path


@check(
    "record_round_trip",
    sql_views("doc_meta", "batch")
    + """ SELECT d.doc_id, length(d.content) AS content_length, b.decision AS routing_decision, b.category, n.n AS read_back FROM batch b
    JOIN doc_meta d USING (doc_id) CROSS JOIN (SELECT count(*) AS n FROM batch WHERE error IS NULL) n WHERE b.error IS NULL""",
)
def record_round_trip(spark, folder):
    """History of classified documents; their feedback is appended to the log and all of it comes back with its features."""
    batch = spark_view(spark, folder, "batch").select("doc_id", "category", "confidence", "decision", "predicted", "processing_time_ms", "error")
    classified = batch.withColumn("classifier_type", F.col("decision"))
    history, rows = learning.record(classified, spark_view(spark, folder, "doc_meta"))
    path = fresh_path(spark, "recorded")
    tables.append_feedback(feedback.feedback_log(rows), path)
    back = tables.read_feedback(spark, path).filter("features.word_count IS NOT NULL").count()
    return history.select("doc_id", "content_length", "routing_decision", "category", F.lit(back).cast("long").alias("read_back"))


@check(
    "load_feedback",
    UNION_SQL + " SELECT routing_decision, round(ml_confidence, 6) AS ml_confidence, actual_category FROM log WHERE type = 'performance_feedback'",
)
def load_feedback(spark, folder):
    found = tables.read_feedback(spark, feedback_file(spark, folder))
    return rounded(found.select("routing_decision", "ml_confidence", "actual_category"), "ml_confidence")


@check(
    "load_feedback_first",
    sql_views("batch") + """ SELECT doc_id % 3 AS append, count(*) AS n FROM batch WHERE error IS NULL AND doc_id % 3 < 2 GROUP BY 1""",
)
def load_feedback_first(spark, folder):
    """Of three appends the lines of the first two, by the number of their lines."""
    path = fresh_path(spark, "feedback")
    docs = with_features(spark_view(spark, folder, "doc_meta")).select("doc_id", "features")
    rows = relations.performance_rows(spark, folder).join(docs, "doc_id").withColumn("timestamp", F.col("doc_id").cast("double"))
    for part in range(3):
        tables.append_feedback(feedback.feedback_log(rows.filter(F.col("doc_id") % 3 == part)), path)
    first = rows.filter(F.col("doc_id") % 3 < 2).count()
    found = tables.read_feedback(spark, path, limit=first)
    return found.groupBy((F.col("timestamp").cast("long") % 3).alias("append")).agg(F.count("*").alias("n"))


@check(
    "append_feedback",
    UNION_SQL + " SELECT type, coalesce(actual_category, correct_category) AS category, count(*) AS n FROM log GROUP BY 1, 2",
)
def append_feedback(spark, folder):
    log = tables.read_feedback_log(spark, feedback_file(spark, folder))
    category = F.coalesce("actual_category", "correct_category").alias("category")
    return log.groupBy("type", category).agg(F.count("*").alias("n"))


@check(
    "load_examples",
    sql_views("doc_meta", "ml_results", "llm_results")
    + f""", examples AS (SELECT {EXAMPLE_SQL} FROM ml_results m JOIN llm_results l USING (doc_id))
    SELECT routing_decision, ml_confidence, llm_confidence, ml_correct, llm_correct, actual_category, cost_ml, cost_llm,
      coalesce(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')), 0) * CAST(length(trim(content, E' \\n\\t\\r')) >= 10 AS BIGINT) AS word_count
    FROM examples JOIN (SELECT doc_id, content FROM doc_meta) USING (doc_id)""",
)
def load_examples(spark, folder):
    path = fresh_path(spark, "examples")
    ml, llm = relations.both(spark, folder)
    docs = with_features(spark_view(spark, folder, "doc_meta"))
    features = docs.select("doc_id", "features", F.col("ts_s").cast("double").alias("timestamp"))
    tables.write_examples(results.example_pairs(ml, llm).join(features, "doc_id").drop("doc_id"), path)
    return tables.read_examples(spark, path).select(
        "routing_decision",
        "ml_confidence",
        "llm_confidence",
        "ml_correct",
        "llm_correct",
        "actual_category",
        "cost_ml",
        "cost_llm",
        F.col("features.word_count").alias("word_count"),
    )


@check(
    "load_example_arrays",
    sql_views("ml_results", "llm_results")
    + f""", examples AS (SELECT {EXAMPLE_SQL} FROM ml_results m JOIN llm_results l USING (doc_id))
    SELECT routing_decision, ml_confidence, llm_confidence, actual_category, cost_ml, cost_llm FROM examples""",
)
def load_example_arrays(spark, folder):
    """Examples from files that hold one JSON array each."""
    path = fresh_path(spark, "arrays")
    rows = results.example_pairs(*relations.both(spark, folder))
    parts = rows.groupBy((F.col("doc_id") % 50).alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    parts.select("part", F.to_json("rows").alias("value")).write.partitionBy("part").text(path)
    columns = ["routing_decision", "ml_confidence", "llm_confidence", "actual_category", "cost_ml", "cost_llm"]
    return tables.read_examples(spark, f"{path}/*", whole_file=True).select(*columns)


FILE_BYTES = 128 << 20


@check(
    "split_json_files",
    """SELECT CASE doc_id % 2 WHEN 0 THEN 'array' ELSE 'object' END AS kind, doc_id, length(text) AS n_chars, sha256(text) AS text_sha256, source
    FROM documents""",
)
def split_json_files(spark, folder):
    """Half of the documents in two or more files of one array each, half in as many of one object each, read in the ranges that Spark cuts."""
    # Two of each per so many bytes: a task writes a file.
    files = 4 * max(1, -(-stored_bytes(spark, f"{folder}/documents.parquet") // FILE_BYTES))
    documents = table(spark, folder, "documents").withColumn("text", F.concat("text", F.lit(' {"a\\": [}],\\')))
    row = F.struct("doc_id", "text", "source")
    parts = []
    for half, (kind, line, opened, closed) in enumerate((
        ("array", F.to_json(row, {"pretty": "true"}), "[", "]"),
        ("object", F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('": '), F.to_json(row)), "{", "}"),
    )):
        path = fresh_path(spark, kind)
        # Text files have a line per row and none around them: the brackets are rows of their own.
        chosen = documents.filter(F.col("doc_id") % 2 == half)
        rows = chosen.select((F.col("doc_id") % files).alias("part"), F.concat(line, F.lit(",")).alias("value"), F.lit(1).alias("place"))
        ends = spark.createDataFrame([(part, *end) for part in range(half, files, 2) for end in ((opened, 0), (closed, 2))], "part long, value string, place int")
        in_files = rows.unionByName(ends).repartition("part").sortWithinPartitions("part", "place")
        in_files.select("part", "value").write.partitionBy("part").text(path)
        items = json_items(spark, f"{path}/*")
        text = "item" if kind == "array" else F.regexp_replace("item", r'^\s*"\d+":', "")
        read = items.select(F.from_json(text, "doc_id long, text string, source string").alias("row")).select("row.*")
        plain = F.expr("left(text, length(text) - 13)")
        parts.append(read.select(F.lit(kind).alias("kind"), "doc_id", F.length(plain).cast("long").alias("n_chars"), F.sha2(plain, 256).alias("text_sha256"), "source"))
    return parts[0].unionByName(parts[1])


@check(
    "upsert_incremental",
    sql_views("doc_meta")
    + """, labelled AS (SELECT doc_id, sha256(content) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN upper(label) ELSE label END AS true_category, 'manual' AS source, ts_s
        FROM doc_meta JOIN labels USING (doc_id)),
    second AS (SELECT * FROM labelled WHERE doc_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY ts_s DESC, doc_id DESC) = 1),
    versions AS (SELECT * FROM second UNION ALL SELECT * FROM labelled WHERE doc_id % 3 = 2
      UNION ALL SELECT doc_id, content_hash, lower(true_category), 'checked', ts_s + 1 FROM second WHERE doc_id % 5 = 0)
    SELECT doc_id, content_hash, true_category, source, ts_s, TRUE AS others_kept_their_files FROM versions
    QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY ts_s DESC, doc_id DESC) = 1""",
)
def upsert_incremental(spark, folder):
    """Three upserts into hash buckets, the last of which reads the table itself, and one of nothing; untouched buckets keep their files."""
    path = fresh_path(spark, "merged")
    truth = reliable(relations.ground_truth(spark, folder))
    for part in (0, 1):
        tables.merge_ground_truth(spark, path, truth.filter(F.col("doc_id") % 3 == part), buckets=16)
    stored = tables.read_merged_ground_truth(spark, path)
    checked = stored.filter("doc_id % 5 = 0").withColumns(
        {"true_category": F.lower("true_category"), "source": F.lit("checked"), "ts_s": F.col("ts_s") + 1}
    )
    tables.merge_ground_truth(spark, path, truth.filter("doc_id % 3 = 2").unionByName(checked))
    # One more row touches one bucket, and is older than what stands there.
    one = tables.read_merged_ground_truth(spark, path).orderBy("content_hash").limit(1).withColumn("ts_s", F.lit(0).cast("long"))
    last = tables.merge_ground_truth(spark, path, one)
    before, after = (files_of(spark, path, version) for version in (last - 1, last))
    kept = sum(before[number] == after[number] for number in after) == len(after) - 1
    return tables.read_merged_ground_truth(spark, path).select(
        "doc_id", "content_hash", "true_category", "source", "ts_s", F.lit(kept).alias("others_kept_their_files")
    )


@check(
    "load_ground_truth",
    sql_views("doc_meta")
    + relations.TRUTH
    + """ SELECT sha256(d.content) AS content_hash, arg_max(l.true_category, l.ts_s) AS true_category,
      arg_max(CASE WHEN length(d.content) > 200 THEN concat(left(d.content, 200), '...') ELSE d.content END, l.ts_s) AS content,
      max(l.ts_s) AS ts_s FROM labelled l JOIN doc_meta d USING (doc_id) GROUP BY 1""",
)
def load_ground_truth(spark, folder):
    path = fresh_path(spark, "truth")
    tables.write_ground_truth(path, relations.ground_truth(spark, folder))
    return tables.read_ground_truth(spark, path).select("content_hash", "true_category", "content", "ts_s")


@check("load_history", sql_views("history") + tail_sql("history", 700) + " SELECT * FROM tail")
def load_history(spark, folder):
    path = fresh_path(spark, "history")
    tables.write_history(spark_view(spark, folder, "history"), path, keep=1000)
    return tables.read_history(spark, path, keep=700)


@check(
    "learn_from_feedback",
    JUDGED.replace("FROM judged)", "FROM (SELECT * FROM judged ORDER BY ts_s DESC, doc_id DESC LIMIT 5000))")
    + """ SELECT rows, judged, correct, ml_mistakes, llm_mistakes, rows >= 200 AS retrained,
      round(CASE WHEN rows >= 10 AND correct / judged < 0.7 THEN greatest(0.1, least(0.9, CAST(0.75 AS DOUBLE) + 0.1 *
        CASE WHEN ml_mistakes > llm_mistakes THEN CASE WHEN mistake_confidence < 0.8 THEN 0.05 ELSE 0.02 END
          WHEN llm_mistakes > ml_mistakes THEN -0.03 ELSE 0 END)) ELSE CAST(0.75 AS DOUBLE) END, 6) AS threshold FROM evidence""",
)
def learn_from_feedback(spark, folder):
    features = with_features(spark_view(spark, folder, "doc_meta")).select("doc_id", "features")
    rows = relations.judged(spark, folder).join(features, "doc_id")
    rows = rows.withColumn("timestamp", F.col("ts_s").cast("double"))
    update, model = learning.learn_from_feedback(rows, 0.75, RoutingConfig(), iterations=3, depth=3)
    return update.select(
        "rows", "judged", "correct", "ml_mistakes", "llm_mistakes", "threshold", F.lit(model is not None).alias("retrained")
    )


FILE_ROWS = 1_000_000


def in_order(spark, frame, order, parts):
    """A stream that meets the rows in that many micro-batches, in their order."""
    source = fresh_path(spark, "arriving")
    bounds = frame.approxQuantile(order, [part / parts for part in range(1, parts)], 0.0)
    place = sum((F.col(order) >= bound).cast("int") for bound in bounds)
    # As many files for every micro-batch, one if it is small.
    files = max(1, -(-frame.count() // (parts * FILE_ROWS)))
    for part in range(parts):
        rows = frame.filter(place == part)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(source)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(source)


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def finished(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@check(
    "stream_usage",
    """SELECT CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS hour_s, count(*) AS total,
      count(*) FILTER (event_id * 37 % 100 < 35) AS llm_count,
      CAST(sum(CASE WHEN event_id * 37 % 100 < 35 THEN 10 ELSE 1 END) AS BIGINT) AS cost_mills FROM events
    GROUP BY 1 HAVING hour_s + 3600 <= (SELECT max(epoch(ts)) - 600 FROM events)""",
)
def stream_usage(spark, folder):
    """All hours the watermark has passed when the stream ends."""
    out = fresh_path(spark, "usage")
    routes = event_stream(spark, folder).select(
        F.expr("timestamp_seconds(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)) AS ts"),
        F.when(F.col("event_id") * 37 % 100 < 35, "LLM").otherwise("ML").alias("decision"),
    )
    finished(streams.to_table(streams.stream_usage(routes), out, fresh_path(spark, "usage-log")))
    return spark.read.parquet(out)


@check(
    "stream_usage_corrected",
    """WITH rows AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, event_id * 37 % 100 < 35 AS is_llm,
        CASE WHEN event_id % 10 < 7 THEN 0 ELSE event_id % 3 + 1 END AS part FROM events),
    marks AS (SELECT part, max(max(ts_s)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
      FROM (SELECT part, ts_s FROM rows) GROUP BY part),
    timed AS (SELECT rows.*, ts_s - ts_s % 3600 AS hour_s, coalesce(ts_s - ts_s % 3600 + 3600 <= newest - 600, FALSE) AS is_late
      FROM rows JOIN marks USING (part))
    SELECT hour_s, count(*) AS total, count(*) FILTER (is_llm) AS llm_count, CAST(sum(CASE WHEN is_llm THEN 10 ELSE 1 END) AS BIGINT) AS cost_mills,
      count(*) FILTER (is_late) AS late, count(DISTINCT part) FILTER (is_late) AS corrections, count(*) FILTER (is_late) AS kept_aside
    FROM timed GROUP BY hour_s""",
)
def stream_usage_corrected(spark, folder):
    """Usage per hour over four micro-batches, the last three of which bring late rows for hours all over."""
    root, source = fresh_path(spark, "corrected"), fresh_path(spark, "parts")
    rows = table(spark, folder, "events").select(
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts_s"),
        F.when(F.col("event_id") * 37 % 100 < 35, "LLM").otherwise("ML").alias("decision"),
        F.when(F.col("event_id") % 10 < 7, 0).otherwise(F.col("event_id") % 3 + 1).alias("part"),
    )
    for part in range(4):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source)
    finished(streams.run_batches(stream, streams.usage_sink(root), fresh_path(spark, "corrected-log")))
    aside = spark.read.parquet(f"{root}/late").groupBy("hour_s").agg(F.count("*").alias("kept_aside"))
    usage = streams.read_usage(spark, root).join(aside, "hour_s", "left").fillna(0, ["kept_aside"])
    return usage.select("hour_s", "total", "llm_count", "cost_mills", "late", "corrections", "kept_aside")


def request_stream(spark, folder):
    return event_stream(spark, folder).selectExpr(
        "event_id AS doc_id",
        "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS ts_s",
        "CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS predicted",
        "CAST((event_id * 13) % 100 AS DOUBLE) / 100 AS load",
        "CASE WHEN event_id % 19 = 0 THEN 'LLM' WHEN event_id % 23 = 0 THEN 'ML' END AS forced",
    )


ROUTED = EVENTS + fold_sql("event_rows") + " SELECT doc_id, hour_s, earlier, earlier_llm, threshold, decision, threshold_after FROM routed"


@check("stream_route", ROUTED)
def stream_route(spark, folder):
    out = fresh_path(spark, "routes")
    with streams.state_store(spark):
        routed = streams.stream_routes(request_stream(spark, folder), CONFIG)
        finished(streams.to_table(routed, out, fresh_path(spark, "routes-log")))
    return spark.read.parquet(out)


@check(
    "stream_route_mixed",
    EVENTS + fold_sql("event_rows") + """ SELECT r.doc_id, r.hour_s, earlier, earlier_llm, threshold, decision, threshold_after
    FROM routed r JOIN event_rows e ON e.doc_id = r.doc_id WHERE e.ts_s < (SELECT max(ts_s) FROM event_rows) - 3600""",
)
def stream_route_mixed(spark, folder):
    """Four micro-batches whose rows are mixed over half an hour of each other: the decisions of the batch router once the watermark has passed."""
    rows = event_rows(spark, folder)
    mixed = rows.withColumn("_arrival", F.col("ts_s") + F.pmod(F.xxhash64("doc_id"), F.lit(1800)))
    out = fresh_path(spark, "routes")
    arriving = in_order(spark, mixed, "_arrival", 4).drop("_arrival")
    with streams.state_store(spark, idle_batches=True):
        routed = streams.stream_routes_in_order(arriving, CONFIG, "1 hour")
        finished(streams.to_table(routed, out, fresh_path(spark, "routes-log")))
    return spark.read.parquet(out)


@check("stream_route_batches", ROUTED)
def stream_route_batches(spark, folder):
    """The same with the batch router inside each of four micro-batches, for hours too busy for one task."""
    out, state = fresh_path(spark, "routes"), fresh_path(spark, "counters")
    sink = streams.routing_sink(out, state, CONFIG)
    requests = in_order(spark, event_rows(spark, folder), "ts_s", 4)
    finished(streams.run_batches(requests, sink, fresh_path(spark, "routes-log")))
    return spark.read.parquet(out).drop("batch")


@check(
    "stream_feedback",
    PATH + " SELECT (SELECT count(*) FROM judged) AS stored, path.* FROM path",
)
def stream_feedback(spark, folder):
    """Feedback stored by a stream of three micro-batches, and the threshold at every update point on the way."""
    stored, state = fresh_path(spark, "stored"), fresh_path(spark, "state")
    sink = streams.learning_sink(stored, state, RoutingConfig(), 0.75)
    rows = relations.judged(spark, folder).withColumn("timestamp", F.col("ts_s").cast("double"))
    finished(streams.run_batches(in_order(spark, rows, "timestamp", 3), sink, fresh_path(spark, "learning-log")))
    count = spark.read.parquet(f"{stored}/rows").count()
    points = spark.read.parquet(state).filter("rows IS NOT NULL").drop("batch")
    return points.withColumn("stored", F.lit(count).cast("long"))


@check(
    "stream_learned_route",
    JUDGED.rstrip()
    + """, sizes AS (SELECT count(*) AS n FROM judged)
    SELECT batch, batch > 0 AND n * batch >= 4 * 200 AS predictor_in_use, TRUE AS same_routes, TRUE AS threshold_of_the_version
    FROM sizes, range(0, 4) r(batch)""",
)
def stream_learned_route(spark, folder):
    """Four micro-batches, each routed by what those before it taught, against the batch router with the published versions."""
    features = with_features(spark_view(spark, folder, "doc_meta")).select("doc_id", "features")
    truth = relations.judged(spark, folder).drop("routing_decision", "ts_s")
    rows = relations.judged(spark, folder).select("doc_id", "ts_s", F.lit(0.1).alias("load"), F.lit(None).cast("string").alias("forced"))
    rows = reliable(rows.join(features, "doc_id"))

    def judge(batch, decided):
        routed = batch.join(decided.select("doc_id", F.col("decision").alias("routing_decision")), "doc_id").join(truth, "doc_id")
        return routed.select(
            "doc_id", "routing_decision", "features", "ml_confidence", "ml_correct", "llm_correct", F.col("ts_s").cast("double").alias("timestamp")
        )

    root = fresh_path(spark, "loop")
    sink = streams.learning_router_sink(root, RoutingConfig(), judge, iterations=3, depth=3)
    finished(streams.run_batches(in_order(spark, rows, "ts_s", 4), sink, fresh_path(spark, "loop-log")))
    found = None
    for batch in range(4):
        routed = spark.read.parquet(f"{root}/routes/batch={batch}")
        config = learning.learned_config(spark, f"{root}/registry", RoutingConfig(), batch)
        forecast = learning.learned_forecast(spark, f"{root}/registry", batch)(rows.join(routed.select("doc_id"), "doc_id"))
        counters = spark.read.parquet(f"{root}/counters/batch={batch - 1}") if batch else None
        again = route_under_budget(forecast, config, counters).select("doc_id", "decision", "threshold").exceptAll(routed.select("doc_id", "decision", "threshold"))
        entry = published(spark, f"{root}/registry", batch)
        points = spark.read.parquet(f"{root}/thresholds").filter(F.col("batch") < batch).agg(F.max_by("threshold", F.struct("arrived", "rows")).alias("threshold"))
        part = again.agg(F.count("*").alias("n")).crossJoin(points).select(
            F.lit(batch).cast("long").alias("batch"),
            F.lit(entry is not None and entry.predictor is not None).alias("predictor_in_use"),
            (F.col("n") == 0).alias("same_routes"),
            (F.coalesce("threshold", F.lit(0.75)) == config.base_threshold).alias("threshold_of_the_version"),
        )
        found = part if found is None else found.unionByName(part)
    return found


@check(
    "stream_stats",
    sql_views("history")
    + tail_sql("history", 100)
    + """ SELECT round(avg(total_time_ms), 6) AS avg_processing_time_ms,
      round(avg(CAST(actual_confidence > 0.8 AS INTEGER)), 6) AS routing_accuracy_estimate,
      (SELECT count(*) FROM history) AS total_classifications FROM tail""",
)
def stream_stats(spark, folder):
    """Statistics of the newest classifications, recomputed with each micro-batch."""
    stored, stats = (fresh_path(spark, name) for name in ("stored", "stats"))
    history = spark_view(spark, folder, "history")
    sink = streams.stats_sink(stored, stats, metrics.recent_history_stats, 100)
    finished(streams.run_batches(in_order(spark, history, "ts_s", 3), sink, fresh_path(spark, "stats-log")))
    newest = spark.read.parquet(stats).orderBy(F.col("batch").desc()).limit(1).drop("batch")
    newest = newest.withColumnRenamed("total", "total_classifications")
    return rounded(newest, "avg_processing_time_ms", "routing_accuracy_estimate")
