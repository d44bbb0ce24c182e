"""Statistics over results, histories and feedback."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.config import RoutingConfig
from docsluice.functions.results import cost_mills
from docsluice.operators.ordering import newest
from docsluice.operators.routing import hour_of


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over results with an `error` column."""
    ok = F.col("error").isNull()
    return results.agg(
        F.count_if(ok).alias("successful"),
        F.count("*").alias("total"),
        F.try_divide(F.count_if(ok), F.count("*")).alias("success_rate"),
        F.avg(F.when(ok, F.col("confidence"))).alias("avg_confidence"),
        F.sum(F.when(ok, F.col("processing_time_ms"))).alias("total_time_ms"),
    )


def category_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def classifier_metrics(history: DataFrame, recent: int = 100) -> DataFrame:
    """Averages over the newest rows and the count of all."""
    tail = newest(history, recent).agg(
        F.avg("confidence").alias("avg_confidence"), F.avg("processing_time_ms").alias("avg_processing_time_ms")
    )
    return _side_by_side(tail, history.agg(F.count("*").alias("total_predictions")))


def llm_metrics(history: DataFrame, recent: int = 100) -> DataFrame:
    """Like `classifier_metrics`, with the share of the text that was sent."""
    tail = newest(history, recent).agg(
        F.avg("confidence").alias("avg_confidence"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"),
        F.avg(F.try_divide("sample_length", "original_length")).alias("avg_sample_ratio"),
        F.count("*").alias("recent_classifications"),
    )
    return _side_by_side(tail, history.agg(F.count("*").alias("total_classifications")))


def recent_distribution(history: DataFrame, recent: int = 100) -> DataFrame:
    return newest(history, recent).groupBy("category").agg(F.count("*").alias("n"))


def routing_stats(routes: DataFrame, recent: int = 1000) -> DataFrame:
    tail = newest(routes, recent).agg(
        F.avg((F.col("decision") == "ML").cast("double")).alias("recent_ml_ratio"),
        F.avg((F.col("decision") == "LLM").cast("double")).alias("recent_llm_ratio"),
        F.avg("predicted").alias("avg_predicted_confidence"),
        F.avg("decision_time_ms").alias("avg_decision_time_ms"),
        F.avg("threshold").alias("avg_threshold"),
    )
    return _side_by_side(tail, routes.agg(F.count("*").alias("total_decisions")))


def recent_history_stats(tail: DataFrame) -> DataFrame:
    """Time and estimated routing accuracy: a high confidence counts as a good route."""
    return tail.agg(
        F.coalesce(F.avg("total_time_ms"), F.lit(0.0)).alias("avg_processing_time_ms"),
        F.coalesce(F.avg((F.col("actual_confidence") > 0.8).cast("double")), F.lit(0.0)).alias(
            "routing_accuracy_estimate"
        ),
    )


def history_stats(history: DataFrame, recent: int = 100) -> DataFrame:
    """Statistics of the newest classifications, and the number of all."""
    tail = recent_history_stats(newest(history, recent))
    return _side_by_side(tail, history.agg(F.count("*").alias("total_classifications")))


def system_stats(**sections: DataFrame) -> DataFrame:
    """Statistics as rows (section, metric, value).

    A section is a one-row frame of numbers, such as load or settings (see `settings`),
    or rows (kind, name, n), such as `feedback_stats`.
    """
    return reduce(DataFrame.unionByName, [_section(name, frame) for name, frame in sections.items()])


def settings(spark: SparkSession, config: RoutingConfig, **more: float) -> DataFrame:
    """The numbers of a configuration, and others such as the load, as a one-row frame."""
    numbers = {**asdict(config), **more}
    return spark.createDataFrame(
        [tuple(float(value) for value in numbers.values())], ", ".join(f"{name} double" for name in numbers)
    )


def _section(name: str, frame: DataFrame) -> DataFrame:
    section = F.lit(name).alias("section")
    if frame.columns == ["kind", "name", "n"]:
        return frame.select(section, F.concat_ws(" ", "kind", "name").alias("metric"), F.col("n").cast("double").alias("value"))
    rows = frame.select(F.explode(_entries(frame)).alias("entry"))
    return rows.select(section, "entry.metric", "entry.value")


def _entries(frame: DataFrame) -> Column:
    return F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
            for name in frame.columns
        ]
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Rows (kind, name, n): all feedback, by type and by category, in one pass."""
    category = F.coalesce(
        F.nullif(F.col("actual_category"), F.lit("")), F.nullif(F.col("correct_category"), F.lit(""))
    )
    keyed = feedback.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")),
                F.struct(F.lit("type").alias("kind"), F.coalesce(F.col("type"), F.lit("unknown")).alias("name")),
                F.struct(F.lit("category").alias("kind"), category.alias("name")),
            )
        ).alias("key")
    )
    return keyed.filter("key.name IS NOT NULL").groupBy("key.kind", "key.name").agg(F.count("*").alias("n"))


def hourly_usage(routes: DataFrame) -> DataFrame:
    """Counts, cost and share of costly calls per hour."""
    llm = F.count_if(F.col("decision") == "LLM")
    return routes.groupBy(hour_of(F.col("ts_s")).alias("hour_s")).agg(
        F.count("*").alias("total"),
        llm.alias("llm_count"),
        F.sum(cost_mills(F.col("decision"))).alias("cost_mills"),
        F.try_divide(llm, F.count("*")).alias("llm_ratio"),
    )


def bootstrap_success(examples: DataFrame, sampled: DataFrame) -> DataFrame:
    """Share of the sampled documents that gave an example."""
    made = examples.agg(F.count("*").alias("examples"))
    tried = sampled.agg(F.count("*").alias("documents"))
    return _side_by_side(made, tried).withColumn("success_rate", F.try_divide("examples", "documents"))


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row: each brings its own columns, and the aggregate takes the one known value."""
    filled = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), rows)
    return filled.agg(*[F.max(name).alias(name) for name in filled.columns])
