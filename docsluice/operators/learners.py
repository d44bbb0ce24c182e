"""Cheap classifiers trained with Spark ML."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.config import TermConfig
from docsluice.functions.names import FLAGGED_SUFFIXES
from docsluice.operators.boosting import SoftmaxBoosting
from docsluice.operators.features import with_filename_columns
from docsluice.operators.kernel_svm import KernelSVM
from docsluice.operators.terms import fit_vocabulary, term_pipeline, with_terms
from docsluice.schema import CATEGORIES

NAME_COLUMNS = [
    "name_length",
    "name_word_count",
    "has_numbers",
    "has_underscore",
    "has_hyphen",
    "has_dot",
    *[f"extension_{kind}" for kind in FLAGGED_SUFFIXES],
    *[f"contains_{category}" for category in CATEGORIES],
]

# In this order; of equally good models the first wins.
MODEL_NAMES = ["Random Forest", "Gradient Boosting", "Logistic Regression", "SVM", "Naive Bayes"]


def prepare(df: DataFrame, filename: str = "filename", config: TermConfig = TermConfig()) -> DataFrame:
    """Adds the file-name columns and the terms of the processed name."""
    return with_terms(with_filename_columns(df, filename), "processed_text", config)


def fit_assembly(prepared: DataFrame, config: TermConfig = TermConfig()) -> tuple[PipelineModel, list[str]]:
    """Transformer from prepared rows to `features`, with the name of each entry."""
    vocabulary = fit_vocabulary(prepared, config)
    terms = term_pipeline(vocabulary)
    numbers = VectorAssembler(inputCols=NAME_COLUMNS + ["term_vector"], outputCol="features")
    known = [row.term for row in vocabulary.orderBy("index").select("term").collect()]
    return PipelineModel([terms, numbers]), NAME_COLUMNS + [f"tfidf {term}" for term in known]


def estimators(
    trees: int = 100, iterations: int = 1000, boosting: int = 100, seed: int = 42, parallel: int = 4
) -> dict:
    """The learners by name; `parallel` of the trees of a boosting round, or machines of classes, are fitted at a time."""
    columns = {"featuresCol": "features", "labelCol": "label_encoded"}
    return {
        "Random Forest": RandomForestClassifier(numTrees=trees, seed=seed, **columns),
        "Gradient Boosting": SoftmaxBoosting(rounds=boosting, seed=seed, parallel=parallel),
        "Logistic Regression": LogisticRegression(maxIter=iterations, **columns),
        "SVM": KernelSVM(iterations=iterations, seed=seed, parallel=parallel),
        "Naive Bayes": NaiveBayes(modelType="multinomial", **columns),
    }


def train_models(train: DataFrame, learners: dict) -> tuple[dict[str, Transformer], dict[str, str]]:
    """Fitted models by name, and the reason for each that could not be fitted."""
    models, problems = {}, {}
    rows = train.select("features", F.col("label_encoded").cast("double").alias("label_encoded")).cache()
    try:
        for name, learner in learners.items():
            try:
                models[name] = learner.fit(rows)
            except Exception as error:  # one learner failing must not stop the others
                problems[name] = str(error)
    finally:
        rows.unpersist()
    return models, problems


def predict(rows: DataFrame, name: str, model: Transformer, labels: list[str]) -> DataFrame:
    """Adds `prediction` (a label), `confidence` (the largest class probability) and `model`."""
    scored = model.transform(rows)
    named = F.get(F.lit(labels), F.col("prediction").cast("int"))
    return scored.select(
        *rows.columns,
        named.alias("prediction"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
        F.lit(name).alias("model"),
    )


def feature_importance(model: Transformer, names: list[str], spark: SparkSession, top: int = 20) -> DataFrame:
    """The most important features of a tree model; one row per feature at most."""
    if not hasattr(model, "featureImportances"):
        raise ValueError("the model gives no feature importances")
    weights = model.featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(names, weights)), "feature string, importance double")
    return rows.orderBy(F.col("importance").desc(), "feature").limit(top)


SUMMARY = "names array<string>, labels array<string>, best string, features array<string>, settings string"


def save_models(
    folder: str,
    assembly: PipelineModel,
    models: dict[str, Transformer],
    labels: list[str],
    best: str,
    spark: SparkSession,
    feature_names: list[str] = (),
    config: TermConfig = TermConfig(),
) -> None:
    """Stores the assembly, the models, their names and labels, the names of the features and the term settings."""
    assembly.write().overwrite().save(f"{folder}/assembly")
    for name, model in models.items():
        PipelineModel([model]).write().overwrite().save(f"{folder}/models/{name.replace(' ', '_')}")
    row = (list(models), labels, best, list(feature_names), json.dumps(asdict(config)))
    spark.createDataFrame([row], SUMMARY).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def load_models(folder: str, spark: SparkSession) -> tuple[PipelineModel, dict[str, Transformer], list[str], str]:
    """The assembly, the models by name, the labels and the name of the best model."""
    summary = spark.read.schema(SUMMARY).json(f"{folder}/summary").first()
    models = {
        name: PipelineModel.load(f"{folder}/models/{name.replace(' ', '_')}").stages[0] for name in summary.names
    }
    return PipelineModel.load(f"{folder}/assembly"), models, summary.labels, summary.best


def load_settings(folder: str, spark: SparkSession) -> tuple[list[str], TermConfig]:
    """The names of the features and the term settings stored with the models."""
    summary = spark.read.schema(SUMMARY).json(f"{folder}/summary").first()
    settings = json.loads(summary.settings)
    words = settings["stop_words"]
    return summary.features, TermConfig(**{**settings, "stop_words": None if words is None else tuple(words)})
