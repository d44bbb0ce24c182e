"""Quality of predictions: frames with `label` and `prediction`, and `model`, `split` where several are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions.names import suffix
from docsluice.operators.ordering import running_totals
from docsluice.session import bounded, reliable


def model_accuracy(predictions: DataFrame) -> DataFrame:
    """Accuracy per model and split."""
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return predictions.groupBy("model", "split").agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def best_model(accuracy: DataFrame, listed: list[str], split: str = "test") -> DataFrame:
    """The model with the highest accuracy; of equal ones the first listed."""
    place = F.array_position(F.lit(listed), F.col("model"))
    return (
        accuracy.filter(F.col("split") == split)
        .orderBy(F.col("accuracy").desc(), place)
        .limit(1)
        .select("model", "accuracy")
    )


def _pair_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts for every pair of occurring classes, zeros included."""
    counts = reliable(_pair_counts(predictions))
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("class")).filter("class IS NOT NULL").distinct()
    # The matrix is the feature itself: a row per pair of classes, whatever the number of predictions.
    numbered = reliable(running_totals(classes, [], ["class"], {"number": F.lit(1)}))
    every = F.sequence(F.lit(0).cast("long"), F.lit(numbered.count() - 1).cast("long"))
    wanted = numbered.select(F.col("class").alias("label"), F.explode(every).alias("number"))
    pairs = wanted.join(numbered.withColumnRenamed("class", "prediction"), "number").drop("number")
    return pairs.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    counts = _pair_counts(predictions)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")

    def side(label: str, hits: Column, support: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(label).alias("class"),
            hits.alias("hits"),
            support.alias("support"),
            predicted.alias("predicted"),
        )

    sides = counts.select(
        F.explode(
            F.array(side("label", hit, F.col("n"), none), side("prediction", none, none, F.col("n")))
        ).alias("side")
    ).select("side.*")
    totals = sides.groupBy("class").agg(*[F.sum(name).alias(name) for name in ("hits", "support", "predicted")])
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    per_class = totals.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        F.coalesce(
            F.try_divide(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
            F.lit(0.0),
        ),
    )
    scores = ["precision", "recall", "f1"]
    overall = per_class.agg(
        F.sum("support").alias("support"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(name).alias(f"macro_{name}") for name in scores],
        *[
            F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(f"weighted_{name}")
            for name in scores
        ],
    )
    def line(title: str, prefix: str) -> Column:
        values = [F.col(prefix.format(name)).alias(name) for name in scores]
        return F.struct(F.lit(title).alias("class"), *values, F.col("support"))

    lines = overall.select(
        F.explode(
            F.array(
                line("accuracy", "accuracy"),
                line("macro avg", "macro_{}"),
                line("weighted avg", "weighted_{}"),
            )
        ).alias("line")
    ).select("line.*")
    return per_class.select("class", *scores, "support").unionByName(lines)


def regression_metrics(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    return predictions.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), label)


def top_extensions(df: DataFrame, filename: str = "filename", n: int = 8) -> DataFrame:
    counts = df.groupBy(suffix(F.col(filename)).alias("extension")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "extension").limit(n)


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds `label_encoded`: the place of the label in the alphabet of all labels, from 0."""
    labels = df.select(label).filter(F.col(label).isNotNull()).distinct()
    codes = running_totals(labels, [], [label], {"label_encoded": F.lit(1)})
    return df.join(bounded(codes), label, "left")
