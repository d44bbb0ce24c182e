"""Multinomial naive Bayes: sums over sparse entries, and scores as one product per batch of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.operators.terms import entries
from docsluice.session import reliable


def fit_bayes(
    vectors: DataFrame, vocabulary: DataFrame, label: str = "label", alpha: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Relations of the model: (label, place, log_prior) and (index, log_likelihoods by place).

    One pass over the sparse vectors; what it leaves has a row per class and term.
    The number of classes is not limited.
    """
    spark = vectors.sparkSession
    # The place -1 stands among the term numbers for the document itself.
    document = F.array(F.struct(F.lit(-1).alias("index"), F.lit(1.0).alias("weight")))
    rows = vectors.select(F.col(label).alias("label"), F.inline(F.concat(document, entries(F.col("term_vector")))))
    sums = reliable(rows.groupBy("label", "index").agg(F.sum("weight").alias("weight")))
    is_document = F.col("index") == -1
    classes = (
        sums.groupBy("label")
        .agg(
            F.sum(F.when(is_document, F.col("weight"))).alias("documents"),
            F.coalesce(F.sum(F.when(~is_document, F.col("weight"))), F.lit(0.0)).alias("weight"),
        )
        .orderBy("label")
        .collect()
    )
    if not classes:
        raise ValueError("there are no rows to learn from")
    documents = sum(row.documents for row in classes)
    priors = spark.createDataFrame(
        [(row.label, place, row.documents / documents, row.weight) for place, row in enumerate(classes)],
        "label string, place int, share double, weight double",
    )
    size = vocabulary.count()
    totals = F.lit([row.weight + alpha * size for row in classes])
    counted = (
        sums.filter(~is_document)
        .join(priors.select(F.col("label").alias("_label"), "place"), F.col("label").eqNullSafe(F.col("_label")))
        .groupBy("index")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("weight")))).alias("_counts"))
    )
    likelihoods = vocabulary.select("index").join(counted, "index", "left").select(
        "index",
        F.transform(
            totals,
            lambda total, place: F.log((F.coalesce(F.try_element_at("_counts", place), F.lit(0.0)) + alpha) / total),
        ).alias("log_likelihoods"),
    )
    return priors.select("label", "place", F.log("share").alias("log_prior")), likelihoods


def score_bayes(
    vectors: DataFrame, priors: DataFrame, likelihoods: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Rows (key, category, confidence), scored where the vectors are; a document without known terms gets the likeliest class."""
    classes = priors.orderBy("place").collect()
    labels = [row.label for row in classes]
    prior = np.array([row.log_prior for row in classes])
    terms = likelihoods.orderBy("index").toArrow()
    # The model: a row per vocabulary term, a column per class.
    matrix = np.zeros((max(terms.column("index").to_pylist(), default=-1) + 1, len(labels)))
    if len(terms):
        matrix[terms.column("index").to_numpy()] = np.array(terms.column("log_likelihoods").to_pylist())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("_entries")
            sizes = found.value_lengths().to_numpy(zero_copy_only=False)
            parts = found.flatten()
            index, weight = parts.field("index").to_numpy(), parts.field("weight").to_numpy()
            scores = np.tile(prior, (batch.num_rows, 1))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            for number in range(len(labels)):
                scores[:, number] += np.bincount(row, weight * matrix[index, number], batch.num_rows)
            best = scores.argmax(axis=1)
            top = scores[np.arange(batch.num_rows), best]
            yield pa.RecordBatch.from_pydict(
                {
                    key: batch.column(key),
                    "category": pa.array([labels[place] for place in best], pa.string()),
                    "confidence": pa.array(1 / np.exp(scores - top[:, None]).sum(axis=1)),
                }
            )

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(key, entries(F.col("term_vector")).alias("_entries"))
    return rows.mapInArrow(score, f"{key} {kind}, category string, confidence double")
