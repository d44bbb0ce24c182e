"""Gradient boosting of several classes at once: a tree per class and round on the gradients of one softmax.

In every round the tree of class k fits Newton's step (y_k - p_k) / (p_k (1 - p_k)),
weighted by p_k (1 - p_k), so that a leaf holds the sum of the gradients over that of the
weights. All trees of a round see the same chances. The scores of the training rows are
a table that is written once a round; trees are fitted by Spark and then kept as small
arrays, which score rows where they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.operators.vectors import columns_of, parts
from docsluice.session import reliable

# Steps beyond this come from rows that are all but certain; they are cut, as usual for Newton's steps.
LARGEST_STEP = 4.0
LEAST_WEIGHT = 1e-6

# Nodes of a tree: feature (-1: leaf), threshold, left child, right child, value.
Tree = list[list[float]]


def tree_nodes(model) -> Tree:
    """The nodes of a fitted tree, the root first."""
    nodes: Tree = []

    def add(node) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(node.prediction())])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            nodes[at][0], nodes[at][1] = int(split.featureIndex()), float(split.threshold())
            nodes[at][2], nodes[at][3] = add(node.leftChild()), add(node.rightChild())
        return at

    add(model._java_obj.rootNode())
    return nodes


class Forest:
    """Trees by round and class as arrays; scores batches of vectors."""

    def __init__(self, rounds: list[list[Tree]], start: list[float], rate: float) -> None:
        self.rounds, self.start, self.rate = rounds, np.array(start), rate
        used = {int(node[0]) for trees in rounds for tree in trees for node in tree if node[0] >= 0}
        self.used = np.array(sorted(used), np.int64)

    def scores(self, vectors: pd.DataFrame) -> np.ndarray:
        entries = columns_of(vectors, self.used)
        found = np.tile(self.start, (len(vectors), 1))
        for trees in self.rounds:
            for number, tree in enumerate(trees):
                found[:, number] += self.rate * self._walk(np.array(tree), entries)
        return found

    def _walk(self, tree: np.ndarray, entries: np.ndarray) -> np.ndarray:
        at = np.zeros(len(entries), np.int64)
        while True:
            feature = tree[at, 0].astype(np.int64)
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return tree[at, 4]
            value = entries[inner, np.searchsorted(self.used, feature[inner])]
            at[inner] = np.where(value <= tree[at[inner], 1], tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)


def _scores(rounds: list[list[Tree]], start: list[float], rate: float):
    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        forest = Forest(rounds, start, rate)
        for vectors in batches:
            yield pd.Series(list(forest.scores(vectors)))

    return scores


def softmax(scores: str) -> Column:
    """Chances from scores, none of which overflows."""
    shifted = _once(F.array_max(scores), lambda most: F.transform(scores, lambda score: F.exp(score - most)))
    total = lambda found: F.aggregate(found, F.lit(0.0), lambda total, y: total + y)
    return _once(shifted, lambda found: _once(total(found), lambda all_of: F.transform(found, lambda x: x / all_of)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


class SoftmaxBoostingModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `rawPrediction`, `probability` and `prediction`; `losses` has the mean training loss after each round."""

    trees = Param(Params._dummy(), "trees", "trees by round and class, as JSON", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "scores before the first round", TypeConverters.toListFloat)
    rate = Param(Params._dummy(), "rate", "share of a step that is taken", TypeConverters.toFloat)
    losses = Param(Params._dummy(), "losses", "mean training loss before the first and after each round", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, trees: str = "[]", start: list[float] = (), rate: float = 0.1, losses: list[float] = ()):
        super().__init__()
        self._setDefault(trees="[]", start=[], rate=0.1, losses=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scores = _scores(json.loads(self.getOrDefault("trees")), self.getOrDefault("start"), self.getOrDefault("rate"))
        scored = dataset.withColumn("_scores", scores(parts("features"))).withColumn("_chances", softmax("_scores"))
        best = (F.array_position("_chances", F.array_max("_chances")) - 1).cast("double")
        return (
            scored.withColumn("rawPrediction", array_to_vector("_scores"))
            .withColumn("probability", array_to_vector("_chances"))
            .withColumn("prediction", best)
            .drop("_scores", "_chances")
        )


class SoftmaxBoosting(Estimator):
    """`rounds` rounds of trees of the given depth; labels are 0, 1, ... in `label_encoded`, features in `features`."""

    def __init__(self, rounds: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42, parallel: int = 4):
        super().__init__()
        self.rounds, self.depth, self.rate, self.seed, self.parallel = rounds, depth, rate, seed, parallel

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        labelled = dataset.select("features", F.col("label_encoded").cast("int").alias("label"))
        counts = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}
        if not counts:
            raise ValueError("no rows to train on")
        total, classes = sum(counts.values()), max(counts) + 1
        start = [float(np.log(max(counts.get(k, 0), 0.5) / total)) for k in range(classes)]
        rows = self._scored(labelled.withColumn("scores", F.array(*[F.lit(x) for x in start])))
        # Friedman's factor for scores that are only told up to a common shift.
        rate = self.rate * (classes - 1) / classes if classes > 1 else self.rate
        rounds, losses = [], [self._loss(rows)]
        with ThreadPoolExecutor(self.parallel) as pool:
            for _ in range(self.rounds if classes > 1 else 0):
                trees = list(pool.map(lambda k: self._tree(rows, k), range(classes)))
                rounds.append(trees)
                step = _scores([trees], [0.0] * classes, rate)
                added = F.zip_with("scores", step(parts("features")), lambda a, b: a + b)
                rows = self._scored(rows.select("features", "label", added.alias("scores")))
                losses.append(self._loss(rows))
        return SoftmaxBoostingModel(trees=json.dumps(rounds), start=start, rate=rate, losses=losses)

    @staticmethod
    def _scored(rows: DataFrame) -> DataFrame:
        """The rows with their chances, written once: every pass of every tree of a round reads these."""
        return reliable(rows.withColumn("chances", softmax("scores")))

    def _tree(self, rows: DataFrame, number: int) -> Tree:
        chance = F.col("chances")[number]
        weight = F.greatest(chance * (1 - chance), F.lit(LEAST_WEIGHT))
        step = ((F.col("label") == number).cast("double") - chance) / weight
        cut = F.greatest(F.lit(-LARGEST_STEP), F.least(F.lit(LARGEST_STEP), step))
        learner = DecisionTreeRegressor(maxDepth=self.depth, labelCol="step", weightCol="weight", seed=self.seed)
        return tree_nodes(learner.fit(rows.select("features", cut.alias("step"), weight.alias("weight"))))

    @staticmethod
    def _loss(rows: DataFrame) -> float:
        return rows.agg(F.avg(-F.log(F.greatest(F.get("chances", F.col("label")), F.lit(1e-300))))).head()[0]
