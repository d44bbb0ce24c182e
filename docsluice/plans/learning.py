"""Jobs around the router: training data, training, learning from feedback."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.config import RoutingConfig, TermConfig
from docsluice.operators.confidence import ConfidenceModel, train_confidence
from docsluice.operators.evaluation import best_model, model_accuracy
from docsluice.operators.features import with_features
from docsluice.operators.feedback import (
    RETRAIN_FROM,
    history_rows,
    performance_feedback,
    threshold_update,
)
from docsluice.operators.learners import estimators, fit_assembly, predict, prepare, train_models
from docsluice.operators.ordering import newest
from docsluice.operators.results import example_pairs
from docsluice.operators.splits import sample_n, stratified_split
from docsluice.plans.classify import Classifier, Forecast, forecast_with
from docsluice.session import reliable
from docsluice.sources.registry import Published, load_predictor, publish, published


def bootstrap_examples(
    docs: DataFrame, ml: Classifier, llm: Classifier, max_samples: int = 1000, seed: int = 42
) -> DataFrame:
    """Routing examples from a sample of documents on which both classifiers run."""
    sampled = reliable(sample_n(docs, max_samples, seed=seed))
    examples = example_pairs(ml(sampled), llm(sampled))
    features = with_features(sampled).select("doc_id", "features", F.col("ts_s").cast("double").alias("timestamp"))
    return examples.join(features, "doc_id")


@dataclass(frozen=True)
class TrainedModels:
    assembly: PipelineModel
    feature_names: list[str]
    models: dict[str, Transformer]
    problems: dict[str, str]
    labels: list[str]
    predictions: DataFrame
    accuracy: DataFrame
    best: str


def train(
    named: DataFrame, learners: dict | None = None, config: TermConfig = TermConfig(), fit_on: str = "train"
) -> TrainedModels:
    """Trains all learners on rows (doc_id, filename, label) and picks the best.

    `fit_on="all"` builds the vocabulary from the test rows too.
    """
    split = reliable(stratified_split(prepare(named, config=config)))
    assembly, names = fit_assembly(split if fit_on == "all" else split.filter("split = 'train'"), config)
    labels = [row.label for row in split.select("label").distinct().orderBy("label").collect()]
    code = F.array_position(F.lit(labels), F.col("label")) - 1
    rows = assembly.transform(split).select("doc_id", "label", "split", "features", code.alias("label_encoded"))
    learners = learners or estimators()
    models, problems = train_models(rows.filter("split = 'train'"), learners)
    if not models:
        raise ValueError(f"no model could be trained: {problems}")
    predictions = None
    for name, model in models.items():
        part = predict(rows, name, model, labels)
        predictions = part if predictions is None else predictions.unionByName(part)
    kept = reliable(predictions.select("doc_id", "model", "split", "label", "prediction", "confidence"))
    accuracy = model_accuracy(kept)
    best = best_model(accuracy, list(learners)).first().model
    return TrainedModels(assembly, names, models, problems, labels, kept, accuracy, best)


def ml_predict(
    docs: DataFrame, assembly: PipelineModel, name: str, model: Transformer, labels: list[str],
    config: TermConfig = TermConfig(), text: str = "filename",
) -> DataFrame:
    """Rows (doc_id, category, confidence, cost, reasoning); row by row, without a shuffle."""
    rows = assembly.transform(prepare(docs, text, config))
    return predict(rows.select("doc_id", "features"), name, model, labels).select(
        "doc_id",
        F.col("prediction").alias("category"),
        "confidence",
        F.lit(0.001).alias("cost"),
        # Fixed value: the wording that readers of results know.
        F.lit(f"ML prediction using {name}").alias("reasoning"),
    )


def learn_from_feedback(
    feedback: DataFrame, current: float, config: RoutingConfig, iterations: int = 100, depth: int = 6
) -> tuple[DataFrame, ConfidenceModel | None]:
    """The new threshold, and the confidence predictor retrained if there is enough feedback.

    `feedback` has the columns of a routing example and doc_id; its newest rows count.
    """
    recent = reliable(newest(feedback, config.feedback_buffer, "timestamp"))
    update = threshold_update(recent, current, config)
    model = None
    if recent.count() >= RETRAIN_FROM:
        model = train_confidence(recent, ["timestamp", "doc_id"], iterations, depth)
    return update, model


def save_state(spark: SparkSession, root: str, version: int, threshold: float, predictor: ConfidenceModel | None = None) -> Published:
    """Publishes a version of what was learned, for the next run of the router."""
    return publish(spark, root, version, threshold, predictor)


def learned_config(spark: SparkSession, root: str, config: RoutingConfig, version: int | None = None) -> RoutingConfig:
    """The configuration with the threshold published last, or last up to a version; unchanged if there is none."""
    entry = published(spark, root, version)
    return config if entry is None else replace(config, base_threshold=entry.threshold)


def learned_forecast(spark: SparkSession, root: str, version: int | None = None) -> Forecast:
    """The forecast with the predictor published last, or last up to a version."""
    return forecast_with(load_predictor(spark, root, published(spark, root, version)))


def record(results: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History and feedback rows of classified documents.

    `results` are those of `hybrid_classify`, with `processing_time_ms` if it was
    measured; `docs` their documents. Documents with an error leave no trace.
    """
    metadata = F.struct(
        F.col("sender_email"),
        F.col("file_extension"),
        F.col("file_size"),
        F.col("ts_s").cast("string").alias("timestamp"),
        F.lit(None).cast("string").alias("source_system"),
    )
    described = with_features(docs).select("doc_id", "ts_s", "content", "features", metadata.alias("metadata"))
    timed = results if "processing_time_ms" in results.columns else results.withColumn("processing_time_ms", F.lit(None).cast("double"))
    classified = timed.filter("error IS NULL").join(described, "doc_id")
    return history_rows(classified), performance_feedback(classified)
