"""Forecast of how sure the cheap classifier will be."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.functions.results import clamp
from docsluice.operators.evaluation import regression_metrics
from docsluice.operators.features import VECTOR_NAMES, feature_vector
from docsluice.operators.routing import UNTRAINED_CONFIDENCE
from docsluice.operators.splits import ordered_split
from docsluice.session import reliable

MIN_EXAMPLES = 50


@dataclass(frozen=True)
class ConfidenceModel:
    pipeline: PipelineModel
    examples: int
    mse: float
    mae: float


def train_confidence(
    examples: DataFrame, order: list[str], iterations: int = 100, depth: int = 6, seed: int = 42
) -> ConfidenceModel | None:
    """Fits on rows (features, ml_confidence, order...); None with fewer than 50 examples."""
    numbers = [value.alias(name) for name, value in _numbers(F.col("features")).items()]
    # The split goes through the rows several times, what the features are made from once.
    examples = reliable(examples.select(*order, "ml_confidence", *numbers))
    count = examples.count()
    if count < MIN_EXAMPLES:
        return None
    rows = ordered_split(examples, order).cache()
    assembler = VectorAssembler(inputCols=[f"_{name}" for name in VECTOR_NAMES], outputCol="_vector")
    regressor = GBTRegressor(
        featuresCol="_vector",
        labelCol="ml_confidence",
        predictionCol="_predicted",
        maxIter=iterations,
        maxDepth=depth,
        stepSize=0.1,
        seed=seed,
    )
    train = assembler.transform(rows.filter("split = 'train'"))
    pipeline = PipelineModel([assembler, regressor.fit(train)])
    checked = pipeline.transform(rows.filter("split = 'validation'"))
    quality = regression_metrics(checked, "ml_confidence", "_predicted").first()
    rows.unpersist()
    return ConfidenceModel(pipeline, count, quality.mse, quality.mae)


def predict_confidence(df: DataFrame, model: ConfidenceModel | PipelineModel | None = None) -> DataFrame:
    """Adds `predicted` from the struct `features`; a fixed value as long as there is no model."""
    if model is None:
        return df.withColumn("predicted", F.lit(UNTRAINED_CONFIDENCE))
    pipeline = model.pipeline if isinstance(model, ConfidenceModel) else model
    scored = pipeline.transform(df.withColumns(_numbers(F.col("features"))))
    return scored.select(*df.columns, clamp(F.col("_predicted"), 0.1, 0.95).alias("predicted"))


def _numbers(features: Column) -> dict[str, Column]:
    """The feature vector under names that meet no other column; what is missing counts as 0."""
    return {f"_{name}": F.coalesce(value, F.lit(0.0)) for name, value in feature_vector(features).items()}


def save_confidence(model: ConfidenceModel, path: str, spark: SparkSession) -> None:
    """Stores the predictor with the names of its features and its quality."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame(
        [(VECTOR_NAMES, model.examples, model.mse, model.mae)], "names array<string>, examples long, mse double, mae double"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")


def load_confidence(path: str, spark: SparkSession) -> ConfidenceModel:
    summary = spark.read.parquet(f"{path}/summary").first()
    if summary.names != VECTOR_NAMES:
        raise ValueError("the predictor was trained on other features")
    return ConfidenceModel(PipelineModel.load(f"{path}/pipeline"), summary.examples, summary.mse, summary.mae)
