"""Naive Bayes over blocks of classes against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docsluice.operators.bayes import fit_bayes, score_bayes
from docsluice.operators.bayes_blocks import _slices, fit_bayes_blocks, score_bayes_blocks

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("label", StringType()), StructField("term_vector", VectorUDT())])


def frames(spark, rows, size):
    stored = [(key, label, Vectors.sparse(size, dict(sorted(terms.items())))) for key, label, terms in rows]
    return spark.createDataFrame(stored, SCHEMA), spark.range(size).select(F.col("id").cast("int").alias("index"))


def plain(rows, size, alpha):
    documents, counts = Counter(label for _, label, _ in rows), defaultdict(Counter)
    for _, label, terms in rows:
        for term, n in terms.items():
            counts[label][term] += n
    order = sorted(documents, key=lambda label: (label is not None, label or ""))
    for key, _, terms in rows:
        scores = []
        for label in order:
            total = sum(counts[label].values()) + alpha * size
            scores.append(math.log(documents[label] / len(rows)) + sum(n * math.log((counts[label][t] + alpha) / total) for t, n in terms.items()))
        top = max(scores)
        yield key, order[scores.index(top)], 1 / sum(math.exp(score - top) for score in scores)


@pytest.mark.parametrize("classes, documents, alpha", [(1024, 16384, 1.0), (2, 7, 0.5)])
def test_blocks_against_plain_loops(spark, classes, documents, alpha):
    draw = random.Random(8)
    rows = []
    for number in range(150):
        label = draw.choice(["a", "b", "c", "d", "e", None])
        terms = {draw.randrange(12) + (ord(label) - 97 if label else 6): float(draw.randint(1, 4)) for _ in range(draw.randrange(6))}
        rows.append((number if number % 10 else 3, label, terms))
    rows += [(None, "a", {0: 1.0}), (900, "a", {}), (901, "z", {})]
    vectors, vocabulary = frames(spark, rows, 20)
    model = fit_bayes_blocks(vectors, vocabulary, alpha=alpha)
    found = score_bayes_blocks(vectors, model, classes=classes, documents=documents).collect()
    expected = list(plain(rows, 20, alpha))
    key = lambda row: (row[0] is not None, row[0] or 0, row[1] or "", round(row[2], 9))
    assert [(a, b, round(c, 9)) for a, b, c in sorted(map(tuple, found), key=key)] == [(a, b, round(c, 9)) for a, b, c in sorted(expected, key=key)]
    whole = score_bayes(vectors, *fit_bayes(vectors, vocabulary, alpha=alpha)).collect()
    assert sorted((r.doc_id or -1, r.category or "", round(r.confidence, 9)) for r in whole) == sorted((a or -1, b or "", round(c, 9)) for a, b, c in expected)


def test_fifty_thousand_classes(spark):
    count = 50_000
    number = F.col("id")
    places = F.array_sort(F.array_distinct(F.array(number % 200, 200 + F.expr("id div 200") % 250)))
    rows = spark.range(count).select(number.alias("doc_id"), number.cast("string").alias("label"), places.cast("array<string>").alias("terms"))
    counter = CountVectorizerModel.from_vocabulary([str(n) for n in range(450)], "terms", "term_vector")
    vectors = counter.transform(rows).drop("terms")
    vocabulary = spark.range(450).select(F.col("id").cast("int").alias("index"))
    model = fit_bayes_blocks(vectors, vocabulary)
    assert model.count() == count
    asked = vectors.filter("doc_id % 500 = 7")
    found = score_bayes_blocks(asked, model, classes=4096).collect()
    # Every class has two terms of its own pair: alone both, 199 + 249 others one, the rest none.
    one, none = 2.0, 1.0
    chances = (one * one) / (one * one + (199 + 249) * one + (count - 449) * none)
    assert len(found) == count // 500
    assert all(row.category == str(row.doc_id) and abs(row.confidence - chances) < 1e-9 for row in found)


def test_no_rows(spark):
    vectors, vocabulary = frames(spark, [(1, "a", {0: 1.0})], 2)
    with pytest.raises(ValueError):
        fit_bayes_blocks(vectors.filter("false"), vocabulary)
    with pytest.raises(ValueError):
        fit_bayes_blocks(vectors, vocabulary, alpha=0)
    assert score_bayes_blocks(vectors.filter("false"), fit_bayes_blocks(vectors, vocabulary)).count() == 0


def test_slices_hold_all_vectors():
    ends = np.cumsum([0, 3, 0, 9, 1, 1, 1, 0, 0])
    for most in (1, 2, 4, 100):
        cuts = list(_slices(ends, most))
        assert [first for first, _ in cuts] == [0, *[last for _, last in cuts[:-1]]] and cuts[-1][1] == len(ends)
