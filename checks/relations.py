"""Checks of joins, aggregates, windows and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, rounded, table
from checks.views import EVENT_ROWS, event_rows, spark_view, sql_views
from docsluice.config import RoutingConfig
from docsluice.functions.text import content_hash
from docsluice.operators import evaluation, feedback, metrics, ordering, results, splits
from docsluice.operators.features import with_filename_columns

PAIRS = sql_views("ml_results", "llm_results")
ML_COST = "coalesce(nullif(m.cost, 0), 0.001)"
LLM_COST = "coalesce(nullif(l.cost, 0), 0.01)"


def both(spark, folder):
    return spark_view(spark, folder, "ml_results"), spark_view(spark, folder, "llm_results")


@check(
    "compare_classifiers",
    PAIRS
    + f""" SELECT doc_id, m.category AS ml_category, m.confidence AS ml_confidence, l.category AS llm_category,
      l.confidence AS llm_confidence, m.category = l.category AS agreement,
      round(abs(m.confidence - l.confidence), 6) AS confidence_diff,
      round(l.processing_time_ms / greatest(m.processing_time_ms, 1.0), 6) AS speed_ratio,
      round({LLM_COST} / {ML_COST}, 6) AS cost_ratio FROM ml_results m JOIN llm_results l USING (doc_id)""",
)
def compare_classifiers(spark, folder):
    compared = results.compare_classifiers(*both(spark, folder))
    return rounded(compared, "confidence_diff", "speed_ratio", "cost_ratio")


EXAMPLE_SQL = f"""doc_id, CASE WHEN l.confidence > m.confidence THEN 'LLM' ELSE 'ML' END AS routing_decision,
  m.confidence AS ml_confidence, l.confidence AS llm_confidence, m.category = l.category AS ml_correct,
  m.category = l.category AS llm_correct, m.category AS actual_category,
  m.processing_time_ms AS processing_time_ml, l.processing_time_ms AS processing_time_llm,
  CAST({ML_COST} AS DOUBLE) AS cost_ml, CAST({LLM_COST} AS DOUBLE) AS cost_llm"""


@check(
    "bootstrap_examples",
    sql_views("doc_meta", "ml_results", "llm_results")
    + f""", sampled AS (SELECT doc_id FROM doc_meta ORDER BY md5(concat('42-', CAST(doc_id AS STRING))), doc_id LIMIT 500)
    SELECT {EXAMPLE_SQL} FROM sampled JOIN ml_results m USING (doc_id) JOIN llm_results l USING (doc_id)""",
)
def bootstrap_examples(spark, folder):
    from docsluice.plans.learning import bootstrap_examples as bootstrap

    ml, llm = both(spark, folder)
    docs = spark_view(spark, folder, "doc_meta")
    examples = bootstrap(
        docs,
        lambda sampled: ml.join(sampled.select("doc_id"), "doc_id", "left_semi"),
        lambda sampled: llm.join(sampled.select("doc_id"), "doc_id", "left_semi"),
        max_samples=500,
    )
    return examples.drop("features", "timestamp")


# Ground truth: labelled documents with good quality; equal contents share one truth, the newest.
TRUTH = """, labelled AS (SELECT d.doc_id, d.content, CASE WHEN d.doc_id % 3 = 0 THEN upper(d.label) ELSE d.label END AS true_category, d.ts_s
    FROM doc_meta d JOIN labels USING (doc_id)),
  truth AS (SELECT sha256(content) AS content_hash, arg_max(true_category, ts_s) AS true_category FROM labelled GROUP BY 1)"""


def ground_truth(spark, folder):
    docs = spark_view(spark, folder, "doc_meta")
    labelled = docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id").select(
        "doc_id",
        "content",
        F.expr("CASE WHEN doc_id % 3 = 0 THEN upper(label) ELSE label END AS true_category"),
        F.lit("manual").alias("source"),
        "ts_s",
    )
    return feedback.ground_truth_rows(labelled)


@check(
    "comparative_feedback",
    sql_views("doc_meta", "ml_results", "llm_results")
    + TRUTH
    + f""" SELECT doc_id, 'ML' AS routing_decision, m.confidence AS ml_confidence, l.confidence AS llm_confidence,
      lower(m.category) = lower(t.true_category) AS ml_correct, lower(l.category) = lower(t.true_category) AS llm_correct,
      coalesce(t.true_category, m.category) AS actual_category, m.processing_time_ms AS processing_time_ml,
      l.processing_time_ms AS processing_time_llm, CAST({ML_COST} AS DOUBLE) AS cost_ml, CAST({LLM_COST} AS DOUBLE) AS cost_llm
    FROM doc_meta d JOIN ml_results m USING (doc_id) JOIN llm_results l USING (doc_id)
    LEFT JOIN truth t ON t.content_hash = sha256(d.content)""",
)
def comparative_feedback(spark, folder):
    hashes = spark_view(spark, folder, "doc_meta").select("doc_id", content_hash(F.col("content")).alias("content_hash"))
    truth = feedback.upsert_ground_truth(ground_truth(spark, folder))
    return results.comparative_feedback(*both(spark, folder), hashes, truth)


@check(
    "upsert_ground_truth",
    sql_views("doc_meta")
    + """, versions AS (SELECT doc_id, content, CASE WHEN doc_id % 3 = 0 THEN upper(label) ELSE label END AS true_category, 'manual' AS source, ts_s
        FROM doc_meta JOIN labels USING (doc_id)
      UNION ALL SELECT doc_id, content, lower(label), 'user_correction', 1704067200 + doc_id * 420 + 1 FROM doc_meta JOIN labels USING (doc_id) WHERE quality = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sha256(content) ORDER BY ts_s DESC, doc_id DESC) AS place FROM versions)
    SELECT doc_id, sha256(content) AS content_hash, CASE WHEN length(content) > 200 THEN concat(left(content, 200), '...') ELSE content END AS content,
      true_category, CAST(1 AS DOUBLE) AS confidence_score, source, ts_s FROM ranked WHERE place = 1""",
)
def upsert_ground_truth(spark, folder):
    doubtful = table(spark, folder, "labels").filter("quality = 0").select("doc_id")
    later = spark_view(spark, folder, "doc_meta").join(doubtful, "doc_id").select(
        "doc_id",
        "content",
        F.lower("label").alias("true_category"),
        F.lit("user_correction").alias("source"),
        (F.col("ts_s") + 1).alias("ts_s"),
    )
    return feedback.upsert_ground_truth(ground_truth(spark, folder), feedback.ground_truth_rows(later))


@check(
    "fallback_result",
    PAIRS
    + """ SELECT m.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.category ELSE m.category END AS category,
      CASE WHEN l.doc_id IS NOT NULL THEN l.confidence ELSE m.confidence END AS confidence,
      CASE WHEN l.doc_id IS NOT NULL THEN l.cost ELSE m.cost END AS cost,
      CASE WHEN l.doc_id IS NOT NULL THEN 'LLM' ELSE 'ML' END AS classifier_type
    FROM ml_results m LEFT JOIN llm_results l USING (doc_id)""",
)
def fallback_result(spark, folder):
    ml, llm = both(spark, folder)
    return results.fall_back(ml.select("doc_id"), llm, ml)


@check(
    "batch_summary",
    sql_views("batch")
    + """ SELECT count(*) FILTER (error IS NULL) AS successful, count(*) AS total,
      round(count(*) FILTER (error IS NULL) / count(*), 6) AS success_rate,
      round(avg(confidence) FILTER (error IS NULL), 6) AS avg_confidence,
      round(sum(processing_time_ms) FILTER (error IS NULL), 6) AS total_time_ms FROM batch""",
)
def batch_summary(spark, folder):
    summary = metrics.batch_summary(spark_view(spark, folder, "batch"))
    return rounded(summary, "success_rate", "avg_confidence", "total_time_ms")


@check(
    "category_counts",
    sql_views("batch") + " SELECT category, count(*) AS n FROM batch WHERE error IS NULL GROUP BY 1 ORDER BY 1",
)
def category_counts(spark, folder):
    return metrics.category_counts(results.keep_or_drop(spark_view(spark, folder, "batch"), "drop"))


def tail_sql(view: str, n: int) -> str:
    return f", tail AS (SELECT * FROM {view} ORDER BY ts_s DESC, doc_id DESC LIMIT {n})"


@check(
    "ml_metrics",
    sql_views("ml_results")
    + tail_sql("ml_results", 100)
    + """ SELECT round(avg(confidence), 6) AS avg_confidence, round(avg(processing_time_ms), 6) AS avg_processing_time_ms,
      (SELECT count(*) FROM ml_results) AS total_predictions FROM tail""",
)
def ml_metrics(spark, folder):
    found = metrics.classifier_metrics(spark_view(spark, folder, "ml_results"))
    return rounded(found, "avg_confidence", "avg_processing_time_ms")


@check(
    "llm_metrics",
    sql_views("llm_results")
    + tail_sql("llm_results", 100)
    + """ SELECT round(avg(confidence), 6) AS avg_confidence, round(avg(processing_time_ms), 6) AS avg_processing_time_ms,
      round(avg(sample_length / original_length), 6) AS avg_sample_ratio, count(*) AS recent_classifications,
      (SELECT count(*) FROM llm_results) AS total_classifications FROM tail""",
)
def llm_metrics(spark, folder):
    found = metrics.llm_metrics(spark_view(spark, folder, "llm_results"))
    return rounded(found, "avg_confidence", "avg_processing_time_ms", "avg_sample_ratio")


@check(
    "llm_distribution",
    sql_views("llm_results") + tail_sql("llm_results", 100) + " SELECT category, count(*) AS n FROM tail GROUP BY 1",
)
def llm_distribution(spark, folder):
    return metrics.recent_distribution(spark_view(spark, folder, "llm_results"))


ROUTING_STATS = """ SELECT round(avg(CAST(decision = 'ML' AS INTEGER)), 6) AS recent_ml_ratio,
  round(avg(CAST(decision = 'LLM' AS INTEGER)), 6) AS recent_llm_ratio, round(avg(predicted), 6) AS avg_predicted_confidence,
  round(avg(decision_time_ms), 6) AS avg_decision_time_ms, round(avg(threshold), 6) AS avg_threshold,
  (SELECT count(*) FROM routes) AS total_decisions FROM tail"""


@check("routing_stats", sql_views("routes") + tail_sql("routes", 1000) + ROUTING_STATS)
def routing_stats(spark, folder):
    found = metrics.routing_stats(spark_view(spark, folder, "routes"))
    return rounded(found, *[name for name in found.columns if name != "total_decisions"])


@check(
    "system_stats",
    sql_views("routes", "ml_results", "llm_results", "history")
    + """, r AS (SELECT * FROM routes ORDER BY ts_s DESC, doc_id DESC LIMIT 1000),
    m AS (SELECT * FROM ml_results ORDER BY ts_s DESC, doc_id DESC LIMIT 100),
    l AS (SELECT * FROM llm_results ORDER BY ts_s DESC, doc_id DESC LIMIT 100),
    h AS (SELECT * FROM history ORDER BY ts_s DESC, doc_id DESC LIMIT 100),
    lines(section, metric, value) AS (
      SELECT 'routing', 'recent_ml_ratio', avg(CAST(decision = 'ML' AS INTEGER)) FROM r
      UNION ALL SELECT 'routing', 'recent_llm_ratio', avg(CAST(decision = 'LLM' AS INTEGER)) FROM r
      UNION ALL SELECT 'routing', 'avg_predicted_confidence', avg(predicted) FROM r
      UNION ALL SELECT 'routing', 'avg_decision_time_ms', avg(decision_time_ms) FROM r
      UNION ALL SELECT 'routing', 'avg_threshold', avg(threshold) FROM r
      UNION ALL SELECT 'routing', 'total_decisions', count(*) FROM routes
      UNION ALL SELECT 'ml', 'avg_confidence', avg(confidence) FROM m
      UNION ALL SELECT 'ml', 'avg_processing_time_ms', avg(processing_time_ms) FROM m
      UNION ALL SELECT 'ml', 'total_predictions', count(*) FROM ml_results
      UNION ALL SELECT 'llm', 'avg_confidence', avg(confidence) FROM l
      UNION ALL SELECT 'llm', 'avg_processing_time_ms', avg(processing_time_ms) FROM l
      UNION ALL SELECT 'llm', 'avg_sample_ratio', avg(sample_length / original_length) FROM l
      UNION ALL SELECT 'llm', 'recent_classifications', count(*) FROM l
      UNION ALL SELECT 'llm', 'total_classifications', count(*) FROM llm_results
      UNION ALL SELECT 'system', 'avg_processing_time_ms', avg(total_time_ms) FROM h
      UNION ALL SELECT 'system', 'routing_accuracy_estimate', avg(CAST(actual_confidence > 0.8 AS INTEGER)) FROM h
      UNION ALL SELECT 'system', 'total_classifications', count(*) FROM history)
    SELECT section, metric, round(CAST(value AS DOUBLE), 6) AS value FROM lines""",
)
def system_stats(spark, folder):
    found = metrics.system_stats(
        routing=metrics.routing_stats(spark_view(spark, folder, "routes")),
        ml=metrics.classifier_metrics(spark_view(spark, folder, "ml_results")),
        llm=metrics.llm_metrics(spark_view(spark, folder, "llm_results")),
        system=metrics.history_stats(spark_view(spark, folder, "history")),
    )
    return rounded(found, "value")


# Feedback of all kinds, as rows of one log.
PERFORMANCE_SQL = """SELECT b.doc_id, 'performance_feedback' AS type, decision AS routing_decision, predicted AS ml_confidence,
    category AS actual_category, CASE WHEN decision = 'ML' THEN processing_time_ms END AS processing_time_ml,
    CASE WHEN decision <> 'ML' THEN processing_time_ms END AS processing_time_llm, CAST(0.001 AS DOUBLE) AS cost_ml,
    CAST(0.01 AS DOUBLE) AS cost_llm, CAST(1704067200 + doc_id * 420 AS DOUBLE) AS timestamp
  FROM batch b WHERE error IS NULL"""
CORRECTION_SQL = """SELECT doc_id, 'user_correction' AS type, CASE WHEN doc_id % 2 = 0 THEN 'anonymous' ELSE concat('u', CAST(doc_id % 10 AS STRING)) END AS user_id,
    sha256(content) AS content_hash, m.category AS predicted_category, upper(d.label) AS correct_category, 'ML' AS routing_decision,
    CAST(0.5 AS DOUBLE) AS ml_confidence, lower(m.category) = lower(d.label) AS ml_correct, CAST(NULL AS BOOLEAN) AS llm_correct,
    upper(d.label) AS actual_category, CAST(d.ts_s AS DOUBLE) AS timestamp
  FROM doc_meta d JOIN ml_results m USING (doc_id)"""


def performance_rows(spark, folder):
    batch = results.keep_or_drop(spark_view(spark, folder, "batch"), "drop")
    return feedback.performance_feedback(batch.withColumn("ts_s", F.expr("1704067200 + doc_id * 420")))


def correction_rows(spark, folder):
    docs = spark_view(spark, folder, "doc_meta").select(
        "doc_id",
        "content",
        F.expr("CASE WHEN doc_id % 2 = 1 THEN concat('u', CAST(doc_id % 10 AS STRING)) END AS user_id"),
        F.upper("label").alias("correct_category"),
        "ts_s",
    )
    predicted = spark_view(spark, folder, "ml_results").select("doc_id", F.col("category").alias("predicted_category"))
    return feedback.user_corrections(docs.join(predicted, "doc_id"))


def comparative_rows(spark, folder):
    rows = comparative_feedback(spark, folder)
    return rows.select("*", F.lit("performance_feedback").alias("type"))


@check("performance_feedback", sql_views("batch") + " " + PERFORMANCE_SQL)
def performance_feedback(spark, folder):
    return performance_rows(spark, folder)


@check("user_correction", sql_views("doc_meta", "ml_results") + " " + CORRECTION_SQL)
def user_correction(spark, folder):
    return correction_rows(spark, folder)


UNION_SQL = (
    sql_views("doc_meta", "ml_results", "llm_results", "batch")
    + TRUTH
    + f""", performance AS ({PERFORMANCE_SQL}), corrections AS ({CORRECTION_SQL}),
  comparisons AS (SELECT doc_id, 'ML' AS routing_decision, m.confidence AS ml_confidence, coalesce(t.true_category, m.category) AS actual_category
    FROM doc_meta d JOIN ml_results m USING (doc_id) JOIN llm_results l USING (doc_id) LEFT JOIN truth t ON t.content_hash = sha256(d.content)),
  log AS (SELECT type, routing_decision, ml_confidence, actual_category, CAST(NULL AS VARCHAR) AS correct_category, CAST(NULL AS VARCHAR) AS user_id FROM performance
    UNION ALL SELECT type, routing_decision, ml_confidence, actual_category, correct_category, user_id FROM corrections
    UNION ALL SELECT 'performance_feedback', routing_decision, ml_confidence, actual_category, NULL, NULL FROM comparisons)"""
)


def all_feedback(spark, folder):
    return feedback.feedback_log(
        performance_rows(spark, folder), correction_rows(spark, folder), comparative_rows(spark, folder)
    )


@check("feedback_union", UNION_SQL + " SELECT * FROM log")
def feedback_union(spark, folder):
    return all_feedback(spark, folder).select(
        "type", "routing_decision", "ml_confidence", "actual_category", "correct_category", "user_id"
    )


@check(
    "feedback_stats",
    UNION_SQL
    + """ SELECT 'total' AS kind, 'all' AS name, count(*) AS n FROM log
    UNION ALL SELECT 'type', type, count(*) FROM log GROUP BY 2
    UNION ALL SELECT 'category', coalesce(actual_category, correct_category), count(*) FROM log
      WHERE coalesce(actual_category, correct_category) IS NOT NULL GROUP BY 2""",
)
def feedback_stats(spark, folder):
    return metrics.feedback_stats(all_feedback(spark, folder))


HOURLY = """SELECT ts_s - ts_s % 3600 AS hour_s, count(*) AS total, count(*) FILTER (decision = 'LLM') AS llm_count,
  CAST(sum(CASE WHEN decision = 'LLM' THEN 10 ELSE 1 END) AS BIGINT) AS cost_mills,
  round(count(*) FILTER (decision = 'LLM') / count(*), 6) AS llm_ratio FROM {0} GROUP BY 1"""
DECIDED_EVENTS = "WITH " + EVENT_ROWS + """, decided AS (SELECT doc_id, ts_s, CASE WHEN predicted < 0.35 THEN 'LLM' ELSE 'ML' END AS decision FROM event_rows)"""


def decided_events(spark, folder):
    return event_rows(spark, folder).select(
        "doc_id", "ts_s", F.when(F.col("predicted") < 0.35, "LLM").otherwise("ML").alias("decision")
    )


@check("hourly_usage", DECIDED_EVENTS + " " + HOURLY.format("decided"))
def hourly_usage(spark, folder):
    return rounded(metrics.hourly_usage(decided_events(spark, folder)), "llm_ratio")


@check(
    "running_usage",
    DECIDED_EVENTS
    + """ SELECT doc_id, count(*) OVER earlier AS n, CAST(coalesce(sum(CAST(decision = 'LLM' AS INTEGER)) OVER earlier, 0) AS BIGINT) AS llm,
      CAST(coalesce(sum(CASE WHEN decision = 'LLM' THEN 10 ELSE 1 END) OVER earlier, 0) AS BIGINT) AS mills FROM decided
    WINDOW earlier AS (PARTITION BY ts_s - ts_s % 3600 ORDER BY ts_s, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_usage(spark, folder):
    from docsluice.functions.results import cost_mills
    from docsluice.operators.routing import hour_of

    decided = decided_events(spark, folder).withColumn("hour_s", hour_of(F.col("ts_s")))
    amounts = {
        "n": F.lit(1),
        "llm": (F.col("decision") == "LLM").cast("long"),
        "mills": cost_mills(F.col("decision")),
    }
    return ordering.running_totals(decided, ["hour_s"], ["ts_s", "doc_id"], amounts).select(
        "doc_id", "n", "llm", "mills"
    )


# Examples with correctness where the documents are labelled, unknown elsewhere.
JUDGED = (
    sql_views("doc_meta", "ml_results", "llm_results")
    + """, judged AS (SELECT doc_id, d.ts_s, CASE WHEN doc_id % 3 = 0 THEN 'LLM' ELSE 'ML' END AS routing_decision, m.confidence AS ml_confidence,
      CASE WHEN b.doc_id IS NOT NULL THEN m.category = d.label END AS ml_correct,
      CASE WHEN b.doc_id IS NOT NULL THEN l.category = d.label END AS llm_correct
    FROM doc_meta d JOIN ml_results m USING (doc_id) JOIN llm_results l USING (doc_id) LEFT JOIN labels b USING (doc_id)),
  flags AS (SELECT *, ml_correct IS NOT NULL AND llm_correct IS NOT NULL AS known,
    CASE WHEN routing_decision = 'ML' THEN (ml_correct AND NOT llm_correct) OR ml_correct = llm_correct ELSE llm_correct AND NOT ml_correct END AS right_route,
    routing_decision = 'ML' AND llm_correct AND NOT ml_correct AS ml_mistake,
    routing_decision = 'LLM' AND ml_correct AND NOT llm_correct AS llm_mistake FROM judged),
  evidence AS (SELECT count(*) AS rows, count(*) FILTER (known) AS judged, count(*) FILTER (known AND right_route) AS correct,
    count(*) FILTER (ml_mistake) AS ml_mistakes, count(*) FILTER (llm_mistake) AS llm_mistakes,
    avg(ml_confidence) FILTER (ml_mistake) AS mistake_confidence FROM flags)"""
)


def judged(spark, folder):
    ml, llm = both(spark, folder)
    docs = spark_view(spark, folder, "doc_meta").select("doc_id", "label", "ts_s")
    known = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("known"))
    joined = (
        docs.join(ml.select("doc_id", F.col("category").alias("ml"), F.col("confidence").alias("ml_confidence")), "doc_id")
        .join(llm.select("doc_id", F.col("category").alias("llm")), "doc_id")
        .join(known, "doc_id", "left")
    )
    return joined.select(
        "doc_id",
        "ts_s",
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'LLM' ELSE 'ML' END AS routing_decision"),
        "ml_confidence",
        F.when(F.col("known"), F.col("ml") == F.col("label")).alias("ml_correct"),
        F.when(F.col("known"), F.col("llm") == F.col("label")).alias("llm_correct"),
    )


@check(
    "routing_accuracy",
    JUDGED + " SELECT judged, correct, round(correct / judged, 6) AS accuracy FROM evidence",
)
def routing_accuracy(spark, folder):
    return rounded(feedback.routing_accuracy(judged(spark, folder)), "accuracy")


@check(
    "threshold_update",
    JUDGED
    + """ SELECT rows, judged, correct, ml_mistakes, llm_mistakes, round(mistake_confidence, 6) AS mistake_confidence,
      round(correct / judged, 6) AS accuracy,
      round(CASE WHEN rows >= 10 AND correct / judged < 0.7 THEN greatest(0.1, least(0.9, CAST(0.75 AS DOUBLE) + 0.1 *
        CASE WHEN ml_mistakes > llm_mistakes THEN CASE WHEN mistake_confidence < 0.8 THEN 0.05 ELSE 0.02 END
          WHEN llm_mistakes > ml_mistakes THEN -0.03 ELSE 0 END)) ELSE CAST(0.75 AS DOUBLE) END, 6) AS threshold FROM evidence""",
)
def threshold_update(spark, folder):
    update = feedback.threshold_update(judged(spark, folder), 0.75, RoutingConfig())
    return rounded(update, "accuracy", "mistake_confidence")


# Every update point adjusts what the one before it left, on the evidence of the newest 5,000 rows up to it.
PATH = (
    JUDGED
    + """, numbered AS (SELECT *, row_number() OVER (ORDER BY ts_s, doc_id) AS place FROM flags),
  points AS (SELECT place AS arrived, least(place, 5000) AS buffered FROM numbered WHERE least(place, 5000) >= 100 AND least(place, 5000) % 50 = 0),
  seen AS (SELECT arrived, count(*) AS rows, count(*) FILTER (known) AS judged, count(*) FILTER (known AND right_route) AS correct,
    count(*) FILTER (ml_mistake) AS ml_mistakes, count(*) FILTER (llm_mistake) AS llm_mistakes,
    avg(ml_confidence) FILTER (ml_mistake) AS mistake_confidence
    FROM points JOIN numbered ON place BETWEEN arrived - 4999 AND arrived GROUP BY arrived),
  moves AS (SELECT *, row_number() OVER (ORDER BY arrived) AS step, CASE WHEN rows >= 10 AND correct / judged < 0.7 THEN
      CASE WHEN ml_mistakes > llm_mistakes THEN CASE WHEN mistake_confidence < 0.8 THEN 5000 ELSE 2000 END
        WHEN llm_mistakes > ml_mistakes THEN -3000 ELSE 0 END ELSE 0 END AS move FROM seen),
  walk AS (SELECT step, CASE WHEN move = 0 THEN 750000 ELSE greatest(100000, least(900000, 750000 + move)) END AS value FROM moves WHERE step = 1
    UNION ALL SELECT m.step, CASE WHEN move = 0 THEN value ELSE greatest(100000, least(900000, value + move)) END FROM walk w JOIN moves m ON m.step = w.step + 1),
  path AS (SELECT arrived, rows, judged, correct, ml_mistakes, llm_mistakes, CAST(value AS DOUBLE) / 1000000 AS threshold FROM moves JOIN walk USING (step))"""
)


@check("threshold_path", PATH + " SELECT * FROM path")
def threshold_path(spark, folder):
    path = feedback.threshold_path(judged(spark, folder), 0.75, RoutingConfig(), ["ts_s", "doc_id"], rows_per_chunk=1000)
    return path.drop("ts_s", "doc_id")


@check(
    "update_points",
    "WITH "
    + EVENT_ROWS
    + """, counted AS (SELECT ts_s, doc_id, row_number() OVER (ORDER BY ts_s, doc_id) AS arrived FROM event_rows)
    SELECT ts_s, doc_id, arrived, least(arrived, 5000) AS buffered, least(arrived, 5000) >= 200 AS retrain
    FROM counted WHERE least(arrived, 5000) >= 100 AND least(arrived, 5000) % 50 = 0""",
)
def update_points(spark, folder):
    return feedback.update_points(event_rows(spark, folder), ["ts_s", "doc_id"])


@check(
    "extension_top8",
    sql_views("doc_meta")
    + """ SELECT lower(regexp_extract(filename, '^((.*/)?\\.*[^./][^/]*)(\\.[^./]*)$', 3)) AS extension, count(*) AS n
    FROM doc_meta GROUP BY 1 ORDER BY n DESC, extension LIMIT 8""",
)
def extension_top8(spark, folder):
    return evaluation.top_extensions(spark_view(spark, folder, "doc_meta"))


@check("label_distribution", sql_views("doc_meta") + " SELECT label, count(*) AS n FROM doc_meta GROUP BY 1")
def label_distribution(spark, folder):
    return evaluation.label_distribution(spark_view(spark, folder, "doc_meta"))


PREDICTIONS = sql_views("predictions_one", "predictions_two") + (
    ", predictions AS (SELECT * FROM predictions_one UNION ALL SELECT * FROM predictions_two)"
)


def predictions(spark, folder):
    return spark_view(spark, folder, "predictions_one").unionByName(spark_view(spark, folder, "predictions_two"))


@check(
    "model_accuracy",
    PREDICTIONS
    + " SELECT model, split, round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy, count(*) AS n FROM predictions GROUP BY 1, 2",
)
def model_accuracy(spark, folder):
    return rounded(evaluation.model_accuracy(predictions(spark, folder)), "accuracy")


@check(
    "best_model",
    PREDICTIONS
    + """ SELECT model, round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy FROM predictions WHERE split = 'test'
    GROUP BY 1 ORDER BY avg(CAST(label = prediction AS INTEGER)) DESC, model LIMIT 1""",
)
def best_model(spark, folder):
    accuracy = evaluation.model_accuracy(predictions(spark, folder))
    return rounded(evaluation.best_model(accuracy, ["first", "second"]), "accuracy")


@check(
    "classification_report",
    sql_views("predictions_one")
    + """, classes AS (SELECT DISTINCT label AS class FROM predictions_one UNION SELECT DISTINCT prediction FROM predictions_one),
    totals AS (SELECT class, count(*) FILTER (label = class AND prediction = class) AS hits, count(*) FILTER (label = class) AS support,
      count(*) FILTER (prediction = class) AS predicted FROM predictions_one JOIN classes ON label = class OR prediction = class GROUP BY 1),
    scores AS (SELECT class, hits, support, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision,
      CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM totals),
    full_scores AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM scores),
    lines AS (SELECT class, precision, recall, f1, support FROM full_scores
      UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM full_scores
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM full_scores
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM full_scores)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM lines""",
)
def classification_report(spark, folder):
    report = evaluation.classification_report(spark_view(spark, folder, "predictions_one"))
    return rounded(report, "precision", "recall", "f1")


@check(
    "confusion_matrix",
    sql_views("predictions_one")
    + """, classes AS (SELECT label AS class FROM predictions_one UNION SELECT prediction FROM predictions_one)
    SELECT a.class AS label, b.class AS prediction,
      (SELECT count(*) FROM predictions_one p WHERE p.label = a.class AND p.prediction = b.class) AS n FROM classes a, classes b""",
)
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(spark_view(spark, folder, "predictions_one"))


@check(
    "regression_metrics",
    PAIRS
    + """ SELECT round(avg((m.confidence - l.confidence) ** 2), 6) AS mse, round(avg(abs(m.confidence - l.confidence)), 6) AS mae
    FROM ml_results m JOIN llm_results l USING (doc_id)""",
)
def regression_metrics(spark, folder):
    ml, llm = both(spark, folder)
    pairs = ml.select("doc_id", F.col("confidence").alias("predicted")).join(
        llm.select("doc_id", F.col("confidence").alias("actual")), "doc_id"
    )
    return rounded(evaluation.regression_metrics(pairs), "mse", "mae")


@check(
    "bootstrap_success",
    PAIRS
    + """ SELECT (SELECT count(*) FROM ml_results JOIN llm_results USING (doc_id)) AS examples, count(*) AS documents,
      round((SELECT count(*) FROM ml_results JOIN llm_results USING (doc_id)) / count(*), 6) AS success_rate FROM ml_results""",
)
def bootstrap_success(spark, folder):
    ml, llm = both(spark, folder)
    return rounded(metrics.bootstrap_success(results.example_pairs(ml, llm), ml), "success_rate")


@check(
    "last_n",
    sql_views("history") + tail_sql("history", 100) + " SELECT * FROM tail",
)
def last_n(spark, folder):
    return ordering.newest(spark_view(spark, folder, "history"), 100)


@check(
    "stratified_split",
    sql_views("doc_meta")
    + """, placed AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42-', CAST(doc_id AS STRING))), doc_id) AS place,
      round(count(*) OVER (PARTITION BY label) * 0.2) AS wanted FROM doc_meta)
    SELECT doc_id, label, CASE WHEN place <= wanted THEN 'test' ELSE 'train' END AS split FROM placed""",
)
def stratified_split(spark, folder):
    return splits.stratified_split(spark_view(spark, folder, "doc_meta").select("doc_id", "label"))


@check(
    "ordered_split",
    sql_views("doc_meta")
    + """ SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY ts_s, doc_id) <= floor((SELECT count(*) FROM doc_meta) * CAST(0.8 AS DOUBLE))
      THEN 'train' ELSE 'validation' END AS split FROM doc_meta""",
)
def ordered_split(spark, folder):
    docs = spark_view(spark, folder, "doc_meta").select("doc_id", "ts_s")
    return splits.ordered_split(docs, ["ts_s", "doc_id"]).select("doc_id", "split")


@check(
    "sample_n",
    sql_views("doc_meta")
    + " SELECT doc_id, lang FROM doc_meta ORDER BY md5(concat('42-', CAST(doc_id AS STRING))), doc_id LIMIT 200",
)
def sample_n(spark, folder):
    return splits.sample_n(spark_view(spark, folder, "doc_meta").select("doc_id", "lang"), 200)


@check("head_n", sql_views("doc_meta") + " SELECT doc_id, lang FROM doc_meta ORDER BY doc_id LIMIT 100")
def head_n(spark, folder):
    return splits.head_n(spark_view(spark, folder, "doc_meta").select("doc_id", "lang"), 100)


@check(
    "label_encode",
    sql_views("doc_meta")
    + """, codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_encoded FROM (SELECT DISTINCT label FROM doc_meta))
    SELECT doc_id, label, label_encoded FROM doc_meta JOIN codes USING (label)""",
)
def label_encode(spark, folder):
    return evaluation.encode_labels(spark_view(spark, folder, "doc_meta").select("doc_id", "label")).select(
        "doc_id", "label", "label_encoded"
    )


def prepare_sql() -> str:
    from checks.expressions import FLAG_COLUMNS, KEYWORD_COLUMNS, NAMES

    return (
        NAMES
        + f""", codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_encoded FROM (SELECT DISTINCT label FROM doc_meta))
    SELECT doc_id, label, label_encoded, processed_text, {FLAG_COLUMNS}, {KEYWORD_COLUMNS} FROM processed JOIN codes USING (label)"""
    )


@check("prepare_data", prepare_sql())
def prepare_data(spark, folder):
    named = with_filename_columns(spark_view(spark, folder, "doc_meta").select("doc_id", "label", "filename"))
    return evaluation.encode_labels(named).drop("filename")


@check(
    "route_union",
    sql_views("routes", "ml_results", "llm_results")
    + """ SELECT doc_id, category, confidence, 'ML' AS classifier_type FROM ml_results JOIN routes USING (doc_id) WHERE decision = 'ML'
    UNION ALL SELECT doc_id, category, confidence, 'LLM' FROM llm_results JOIN routes USING (doc_id) WHERE decision = 'LLM'""",
)
def route_union(spark, folder):
    routes = spark_view(spark, folder, "routes")
    return results.by_route(routes, *both(spark, folder))
