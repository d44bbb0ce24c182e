"""Whole classification, its filter, the learned state, and reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsluice.operators.features import with_features
from pyspark.sql import functions as F

from docsluice.config import RoutingConfig, TermConfig
from docsluice.operators import feedback, metrics
from docsluice.operators.prefilter import likely_among
from docsluice.operators.results import format_results
from docsluice.operators.splits import stratified_split
from docsluice.plans import learning
from docsluice.plans.classify import classify, hybrid_classify, llm_classify


def test_filter_keeps_all_wanted_rows_and_few_others(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("_bits"))
    keys = spark.range(0, 20_000, 100).select(F.col("id").alias("doc_id"))
    kept = {row.doc_id for row in likely_among(rows, keys).collect()}
    assert set(range(0, 20_000, 100)) <= kept and len(kept) < 260
    assert likely_among(rows, keys.filter("false")).count() == 0


def documents(spark):
    rows = [(1, "a text for the cheap one"), (2, "a text for the costly one"), (3, "  \n"), (4, "nobody knows this text"), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, content string")
    return frame.selectExpr("*", "'a@b.c' AS sender_email", "'txt' AS file_extension", "10L AS file_size", "doc_id AS ts_s", "0.0 AS load")


def cheap(docs):
    assert "content" in docs.columns
    return docs.filter("contains(content, 'cheap')").selectExpr("doc_id", "'memo' AS category", "0.9 AS confidence")


def costly(prompts):
    answer = F.when(F.contains("prompt", F.lit("costly")), '{"category": "email", "confidence": 0.7, "reasoning": "r"}')
    return prompts.select("doc_id", answer.alias("response"), F.when(answer.isNull(), "refused").alias("call_error"))


def test_documents_without_any_result_are_errors(spark):
    def sure(featured):
        return featured.withColumn("predicted", F.when(F.col("doc_id") == 1, 0.9).otherwise(0.1))

    found = {r.doc_id: r for r in hybrid_classify(documents(spark), cheap, costly, RoutingConfig(), forecast=sure).collect()}
    assert (found[1].category, found[1].classifier_type, found[1].cost) == ("memo", "ML", 0.001)
    assert (found[2].category, found[2].classifier_type, found[2].cost, found[2].reasoning) == ("email", "LLM", 0.01, "r")
    assert (found[3].error, found[5].error) == ("Empty document content",) * 2
    assert (found[4].category, found[4].cost, found[4].error) == (None, None, "No classifier gave a result")


def test_each_classifier_alone(spark):
    alone = {r.doc_id: r for r in classify(documents(spark), RoutingConfig(), ml=cheap).collect()}
    assert alone[1].category == "memo" and alone[4].error == "No classifier gave a result"
    asked = []

    def ask(prompts):
        asked.extend(row.doc_id for row in prompts.collect())
        return costly(prompts)

    by_llm = {r.doc_id: r for r in llm_classify(documents(spark), ask).collect()}
    assert sorted(asked) == [1, 2, 4]
    assert (by_llm[1].category, by_llm[1].confidence) == ("letter", 0.0) and by_llm[3].error == "Empty document content"
    with pytest.raises(ValueError):
        classify(documents(spark), RoutingConfig())


def test_learned_threshold(spark, tmp_path):
    path, config = str(tmp_path / "state"), RoutingConfig(base_threshold=0.75)
    assert learning.learned_config(spark, path, config) == config
    learning.save_state(spark, path, 1, 0.7)
    learning.save_state(spark, path, 2, 0.65)
    assert learning.learned_config(spark, path, config).base_threshold == 0.65
    assert learning.learned_config(spark, path, config, 1).base_threshold == 0.7
    assert learning.learned_config(spark, path, config, 0) == config


def test_published_versions_stand(spark, tmp_path):
    from docsluice.operators.confidence import train_confidence
    from docsluice.sources.registry import load_predictor, publish, published

    root = str(tmp_path / "registry")
    assert published(spark, root) is None and load_predictor(spark, root, None) is None
    content = F.expr("repeat(concat('word', CAST(id % 7 AS STRING), ' '), CAST(5 + id % 40 AS INT))")
    docs = spark.range(120).select(
        F.col("id").alias("doc_id"), content.alias("content"), F.lit(None).cast("string").alias("sender_email"),
        F.lit("txt").alias("file_extension"), F.lit(9).cast("long").alias("file_size"),
    )
    rows = with_features(docs).select("doc_id", "features", (F.col("doc_id") % 40 / 40).alias("ml_confidence"), F.col("doc_id").cast("double").alias("timestamp"))
    model = train_confidence(rows, ["timestamp", "doc_id"], 3, 3)
    publish(spark, root, 3, 0.7)
    publish(spark, root, 5, 0.65, model)
    assert publish(spark, root, 8, 0.6) == published(spark, root)
    assert [published(spark, root, n) and (published(spark, root, n).threshold, published(spark, root, n).predictor) for n in (2, 4, 7, 9)] == [
        None, (0.7, None), (0.65, 5), (0.6, 5)
    ]
    # What is published already stays, whatever a repeated job brings.
    assert publish(spark, root, 5, 0.1).threshold == 0.65
    assert learning.learned_forecast(spark, root, 4)(rows).select("predicted").distinct().collect()[0][0] == 0.6
    fresh, stored = (sorted(f(rows).select("doc_id", "predicted").collect()) for f in (learning.forecast_with(model), learning.learned_forecast(spark, root)))
    assert fresh == stored and len({r.predicted for r in stored}) > 3
    # A version that was not finished is not seen.
    (tmp_path / "registry" / "manifest" / ".draft").write_text("{")
    assert published(spark, root).version == 8


def test_record_keeps_features_and_metadata(spark):
    results = spark.createDataFrame(
        [(1, "memo", 0.9, "ML", "ML", 0.6, None), (2, None, None, None, "LLM", 0.4, "failed")],
        "doc_id long, category string, confidence double, classifier_type string, decision string, predicted double, error string",
    )
    history, rows = learning.record(results, documents(spark))
    assert [(r.doc_id, r.content_length) for r in history.collect()] == [(1, 24)]
    logged = feedback.feedback_log(rows).collect()
    assert len(logged) == 1 and logged[0].features.word_count == 6 and logged[0].metadata.sender_email == "a@b.c"


def test_null_labels_are_split_like_others(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "a").alias("label"))
    found = {(r.label, r.split): r["count"] for r in stratified_split(rows).groupBy("label", "split").count().collect()}
    assert found == {("a", "train"): 80, ("a", "test"): 20, (None, "train"): 80, (None, "test"): 20}


def test_result_styles(spark):
    rows = spark.createDataFrame([("p", "memo", 0.5, "ML", None)], "path string, category string, confidence double, decision string, error string")
    detailed = format_results(rows, "detailed").first().line
    assert detailed.splitlines() == ["path: p", "category: memo", "confidence: 0.5", "decision: ML"]
    with pytest.raises(ValueError):
        format_results(rows, "xml")


def test_statistics_with_settings_and_feedback(spark):
    rows = spark.createDataFrame([("performance_feedback", "memo", None)], "type string, actual_category string, correct_category string")
    stats = metrics.system_stats(feedback=metrics.feedback_stats(rows), settings=metrics.settings(spark, RoutingConfig(), load=0.4))
    found = {(r.section, r.metric): r.value for r in stats.collect()}
    assert found["feedback", "category memo"] == 1 and found["settings", "load"] == 0.4 and found["settings", "base_threshold"] == 0.75


def test_history_of_the_costly_model(spark):
    rows = documents(spark).withColumn("classifier_type", F.when(F.col("doc_id") == 2, "LLM").otherwise("ML")).selectExpr(
        "*", "'memo' AS category", "0.5 AS confidence", "3.0 AS processing_time_ms"
    )
    found = feedback.llm_history_rows(rows).collect()
    assert [(r.doc_id, r.original_length, r.sample_length) for r in found] == [(2, 25, 25)]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        TermConfig(max_features=0)
    with pytest.raises(ValueError):
        RoutingConfig(feedback_buffer=0)
