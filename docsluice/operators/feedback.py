"""Feedback rows, ground truth, and what is learned from them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.config import MAX_CHARS, RoutingConfig
from docsluice.functions.text import content_hash, preview, sample_document
from docsluice.operators.ordering import in_chunks, newest_per_key, running_totals
from docsluice.schema import FEEDBACK_TYPE
from docsluice.session import reliable

# When feedback is acted upon, and the changes of the threshold.
FIRST_UPDATE, UPDATE_STEP, RETRAIN_FROM = 100, 50, 200
MIN_FEEDBACK, ENOUGH_ACCURACY = 10, 0.7
RAISE_UNSURE, RAISE_SURE, LOWER = 0.05, 0.02, -0.03


def history_rows(classified: DataFrame) -> DataFrame:
    """Classification history from classified documents."""
    return classified.select(
        "doc_id",
        "ts_s",
        F.length("content").cast("long").alias("content_length"),
        F.col("decision").alias("routing_decision"),
        F.col("predicted").alias("predicted_confidence"),
        F.col("confidence").alias("actual_confidence"),
        "category",
        "classifier_type",
        F.col("processing_time_ms").alias("total_time_ms"),
    )


def llm_history_rows(classified: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """History of the costly model from classified documents: the input of its metrics."""
    costly = classified.filter("classifier_type = 'LLM'")
    sample = F.length(sample_document(F.col("content"), max_chars)).cast("long")
    return costly.select(
        "doc_id",
        "ts_s",
        "category",
        "confidence",
        "processing_time_ms",
        F.length("content").cast("long").alias("original_length"),
        sample.alias("sample_length"),
    )


def carried(rows: DataFrame) -> list[str]:
    """What describes a document in feedback, as far as the rows have it."""
    return [name for name in ("features", "metadata") if name in rows.columns]


def performance_feedback(classified: DataFrame) -> DataFrame:
    """One feedback row per classified document; the time goes to the classifier that ran.

    The structs `features` and `metadata` are kept, if there.
    """
    to_ml = F.col("decision") == "ML"
    return classified.select(
        "doc_id",
        F.lit("performance_feedback").alias("type"),
        F.col("decision").alias("routing_decision"),
        F.col("predicted").alias("ml_confidence"),
        F.col("category").alias("actual_category"),
        F.when(to_ml, F.col("processing_time_ms")).alias("processing_time_ml"),
        F.when(~to_ml, F.col("processing_time_ms")).alias("processing_time_llm"),
        F.lit(0.001).alias("cost_ml"),
        F.lit(0.01).alias("cost_llm"),
        F.col("ts_s").cast("double").alias("timestamp"),
        *carried(classified),
    )


def user_corrections(corrections: DataFrame) -> DataFrame:
    """Feedback from rows (doc_id, content, user_id, predicted_category, correct_category, ts_s), with `features` and `metadata` if there."""
    return corrections.select(
        "doc_id",
        F.lit("user_correction").alias("type"),
        F.coalesce(F.col("user_id"), F.lit("anonymous")).alias("user_id"),
        content_hash(F.col("content")).alias("content_hash"),
        "predicted_category",
        "correct_category",
        F.lit("ML").alias("routing_decision"),
        F.lit(0.5).alias("ml_confidence"),
        (F.lower("predicted_category") == F.lower("correct_category")).alias("ml_correct"),
        F.lit(None).cast("boolean").alias("llm_correct"),
        F.col("correct_category").alias("actual_category"),
        F.col("ts_s").cast("double").alias("timestamp"),
        *carried(corrections),
    )


def feedback_log(*kinds: DataFrame) -> DataFrame:
    """All kinds of feedback in the schema of the log."""
    return reduce(DataFrame.unionByName, [_in_log_schema(kind) for kind in kinds])


def _in_log_schema(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[
            (F.col(field.name) if field.name in rows.columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in FEEDBACK_TYPE.fields
        ]
    )


def routing_accuracy(feedback: DataFrame) -> DataFrame:
    """Share of right routes among rows that say for both classifiers whether they were correct."""
    return feedback.agg(*[column.alias(name) for name, column in _accuracy().items()]).withColumn(
        "accuracy", F.try_divide("correct", "judged")
    )


def _accuracy() -> dict[str, Column]:
    ml, llm = F.col("ml_correct"), F.col("llm_correct")
    judged = ml.isNotNull() & llm.isNotNull()
    # Sending a document to the costly model is right only if the cheap one would have failed.
    right = F.when(F.col("routing_decision") == "ML", ml | ~llm).otherwise(llm & ~ml)
    return {"judged": F.count_if(judged), "correct": F.count_if(judged & right)}


def threshold_update(feedback: DataFrame, current: float, config: RoutingConfig) -> DataFrame:
    """One row: the evidence in the feedback and the threshold that follows from it."""
    ml, llm, decision = F.col("ml_correct"), F.col("llm_correct"), F.col("routing_decision")
    ml_mistake = (decision == "ML") & llm & ~ml
    llm_mistake = (decision == "LLM") & ml & ~llm
    evidence = feedback.agg(
        F.count("*").alias("rows"),
        *[column.alias(name) for name, column in _accuracy().items()],
        F.count_if(ml_mistake).alias("ml_mistakes"),
        F.count_if(llm_mistake).alias("llm_mistakes"),
        F.avg(F.when(ml_mistake, F.col("ml_confidence"))).alias("mistake_confidence"),
    )
    adjustment = (
        F.when(
            F.col("ml_mistakes") > F.col("llm_mistakes"),
            F.when(F.col("mistake_confidence") < 0.8, RAISE_UNSURE).otherwise(RAISE_SURE),
        )
        .when(F.col("llm_mistakes") > F.col("ml_mistakes"), LOWER)
        .otherwise(0.0)
    )
    poor = (F.col("rows") >= MIN_FEEDBACK) & (F.col("accuracy") < ENOUGH_ACCURACY)
    moved = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.lit(current) + adjustment * config.learning_rate))
    return evidence.withColumn("accuracy", F.try_divide("correct", "judged")).withColumn(
        "threshold", F.round(F.when(poor, moved).otherwise(F.lit(current)), 6)
    )


def update_points(
    feedback: DataFrame, order: list[str], rows_per_chunk: int = 200_000, buffer: int = RoutingConfig.feedback_buffer
) -> DataFrame:
    """The feedback rows at whose arrival the threshold is updated, and whether the predictor is retrained."""
    counted = running_totals(feedback, [], order, {"earlier": F.lit(1)}, rows_per_chunk)
    held = _due(counted.withColumn("arrived", F.col("earlier") + 1), buffer)
    return held.select(*order, "arrived", "buffered", (F.col("buffered") >= RETRAIN_FROM).alias("retrain"))


def _due(arrived: DataFrame, buffer: int) -> DataFrame:
    held = arrived.withColumn("buffered", F.least(F.col("arrived"), F.lit(buffer)))
    return held.filter((F.col("buffered") >= FIRST_UPDATE) & (F.col("buffered") % UPDATE_STEP == 0))


def threshold_path(
    feedback: DataFrame,
    current: float,
    config: RoutingConfig,
    order: list[str],
    earlier: int = 0,
    rows_per_chunk: int = 200_000,
    moved_from: int = 0,
) -> DataFrame:
    """The threshold after every update point: order, arrived, rows, judged, correct, ml_mistakes, llm_mistakes, threshold.

    Each point adjusts what the point before it left, on the evidence of the newest
    `feedback_buffer` rows up to it. `earlier` rows came before the first given one;
    points up to the row number `moved_from` were acted upon before and are left out.
    Sums over the buffer are differences of running totals.
    """
    ml, llm, decision = F.col("ml_correct"), F.col("llm_correct"), F.col("routing_decision")
    judged = ml.isNotNull() & llm.isNotNull()
    right = F.when(decision == "ML", ml | ~llm).otherwise(llm & ~ml)
    ml_mistake = (decision == "ML") & llm & ~ml
    known = ml_mistake & F.col("ml_confidence").isNotNull()
    marks = {
        "judged": judged,
        "correct": judged & right,
        "ml_mistakes": ml_mistake,
        "llm_mistakes": (decision == "LLM") & ml & ~llm,
        "unsure": known,
    }
    amounts = {name: F.coalesce(mark, F.lit(False)).cast("int") for name, mark in marks.items()}
    # Confidences in millionths, so that their sum is exact.
    millionths = F.when(F.coalesce(known, F.lit(False)), F.round(F.col("ml_confidence") * 1_000_000)).otherwise(0)
    amounts |= {"sureness": millionths.cast("long"), "earlier": F.lit(1)}
    counted = running_totals(feedback, [], order, {f"_{name}": amount for name, amount in amounts.items()}, rows_per_chunk)
    # Totals up to and with the row, and the same at the row that has just left the buffer.
    upto = reliable(
        counted.select(
            *order,
            (F.col("_earlier") + 1 + F.lit(earlier)).alias("arrived"),
            *[(F.col(f"_{name}") + amount).alias(name) for name, amount in amounts.items() if name != "earlier"],
        )
    )
    names = [name for name in amounts if name != "earlier"]
    left = upto.select(
        (F.col("arrived") + config.feedback_buffer).alias("arrived"), *[F.col(name).alias(f"_{name}") for name in names]
    )
    points = _due(upto, config.feedback_buffer).filter(F.col("arrived") > moved_from).join(left, "arrived", "left")
    evidence = points.select(
        *order,
        "arrived",
        F.col("buffered").alias("rows"),
        *[(F.col(name) - F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in names],
    )
    accuracy = F.try_divide("correct", "judged")
    unsure = F.try_divide(F.col("sureness"), F.col("unsure")) < 800_000
    step = (
        F.when(F.col("ml_mistakes") > F.col("llm_mistakes"), F.when(unsure, RAISE_UNSURE).otherwise(RAISE_SURE))
        .when(F.col("llm_mistakes") > F.col("ml_mistakes"), LOWER)
        .otherwise(0.0)
    )
    poor = (F.col("rows") >= MIN_FEEDBACK) & (accuracy < ENOUGH_ACCURACY)
    moved = F.when(poor, F.round(step * config.learning_rate * 1_000_000)).otherwise(0).cast("long")
    return _clamped_path(evidence.withColumn("_move", moved), "_move", order, current, rows_per_chunk).select(
        *order, "arrived", "rows", "judged", "correct", "ml_mistakes", "llm_mistakes", "threshold"
    )


# The bounds of the threshold, in millionths.
LOWEST, HIGHEST = 100_000, 900_000


def _kept_between(value: int) -> int:
    return min(HIGHEST, max(LOWEST, value))


def _clamped_path(points: DataFrame, move: str, order: list[str], start: float, rows_per_chunk: int) -> DataFrame:
    """Adds `threshold`: the start after all moves so far, kept between the bounds after each.

    A move kept between bounds is x -> min(high, max(low, x + shift)), and so is any
    number of them after each other: chunks are summed up on their own, the sums, a
    row per chunk, are followed in order, and each chunk is then walked from its start.
    """
    chunks = in_chunks(points, order, rows_per_chunk)

    def sum_up(rows: pd.DataFrame) -> pd.DataFrame:
        shift, low, high = 0, LOWEST, HIGHEST
        for step in rows.sort_values("chunk_row")[move]:
            if step:
                shift, low, high = shift + step, _kept_between(low + step), _kept_between(high + step)
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "shift": [shift], "low": [low], "high": [high]})

    summed = chunks.groupBy("chunk").applyInPandas(sum_up, "chunk long, shift long, low long, high long")
    starts, value = [], round(start * 1_000_000)
    for row in summed.orderBy("chunk").collect():
        starts.append((row.chunk, value))
        value = min(row.high, max(row.low, value + row["shift"])) if row["shift"] or row.low > LOWEST or row.high < HIGHEST else value
    spark = points.sparkSession
    started = chunks.join(F.broadcast(spark.createDataFrame(starts, "chunk long, _start long")), "chunk")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_row")
        value, path = int(rows["_start"].iloc[0]), []
        for step in rows[move]:
            value = _kept_between(value + step) if step else value
            path.append(value / 1_000_000)
        return rows.drop(columns=["chunk", "chunk_row", "_start"]).assign(threshold=path)

    schema = points.withColumn("threshold", F.lit(0.0)).schema
    return started.groupBy("chunk").applyInPandas(walk, schema)


def ground_truth_rows(labelled: DataFrame) -> DataFrame:
    """Ground truth from rows (doc_id, content, true_category, source, ts_s), not yet reduced to one per content."""
    return labelled.select(
        "doc_id",
        content_hash(F.col("content")).alias("content_hash"),
        preview(F.col("content")).alias("content"),
        "true_category",
        F.lit(1.0).alias("confidence_score"),
        "source",
        "ts_s",
    )


def upsert_ground_truth(*versions: DataFrame) -> DataFrame:
    """The newest ground truth of each content."""
    return newest_per_key(reduce(DataFrame.unionByName, versions), "content_hash")
