"""A support vector machine with a radial kernel and class probabilities.

The kernel exp(-gamma |x - y|^2) is the mean over random waves of cos(w x + b) cos(w y + b),
so a linear machine over such waves is one with that kernel, up to the error of the mean,
and scores rows where they are. Waves follow from a seed and are made anew in every task.
A sigmoid per class, fitted to margins of rows that the machine did not see, turns
margins into chances, which are brought to the sum 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.operators.vectors import columns_of, parts

# Margins are counted in steps of 1/64 between -32 and 32: a sigmoid rests on 4097 counts per class at most.
STEPS, WIDEST = 64, 32
AT_ONCE = 1024
# One row in so many is kept from the machine, for the sigmoids.
HELD_BACK = 5


class Waves(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `waves`: sqrt(2 / count) cos(w x + b) with w from a normal distribution of variance 2 gamma."""

    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    count = Param(Params._dummy(), "count", "number of waves", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "entries of a feature vector", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the waves", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, gamma: float = 1.0, count: int = 256, size: int = 1, seed: int = 42):
        super().__init__()
        self._setDefault(gamma=1.0, count=256, size=1, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, count, size, seed = (self.getOrDefault(name) for name in ("gamma", "count", "size", "seed"))

        @F.pandas_udf("array<double>")
        def waves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            draw = np.random.default_rng(seed)
            directions = draw.normal(0.0, np.sqrt(2 * gamma), (size, count))
            phases = draw.uniform(0.0, 2 * np.pi, count)
            for vectors in batches:
                found = []
                # Rows become dense a few at a time.
                for at in range(0, len(vectors), AT_ONCE):
                    dense = columns_of(vectors.iloc[at : at + AT_ONCE], np.arange(size))
                    found.extend(np.sqrt(2 / count) * np.cos(dense @ directions + phases))
                yield pd.Series(found, dtype=object)

        return dataset.withColumn("waves", array_to_vector(waves(parts("features"))))


class Sigmoids(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability` and `prediction` from `rawPrediction`, the margins: 1 / (1 + exp(slope * margin + shift)) per class, brought to the sum 1."""

    slopes = Param(Params._dummy(), "slopes", "slope by class", TypeConverters.toListFloat)
    shifts = Param(Params._dummy(), "shifts", "shift by class", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, slopes: list[float] = (), shifts: list[float] = ()):
        super().__init__()
        self._setDefault(slopes=[], shifts=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        lines = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(self.getOrDefault("slopes"), self.getOrDefault("shifts"))])
        chances = F.zip_with(vector_to_array("rawPrediction"), lines, lambda m, line: 1 / (1 + F.exp(line["a"] * m + line["b"])))
        total = F.aggregate("_chances", F.lit(0.0), lambda total, chance: total + chance)
        even = F.transform("_chances", lambda chance: F.when(total > 0, chance / total).otherwise(1 / F.size("_chances")))
        best = (F.array_position("_even", F.array_max("_even")) - 1).cast("double")
        return (
            dataset.withColumn("_chances", chances)
            .withColumn("_even", even)
            .withColumn("prediction", best)
            .withColumn("probability", array_to_vector("_even"))
            .drop("_chances", "_even")
        )


def fit_sigmoid(margins: np.ndarray, hits: np.ndarray, misses: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that make the counts most likely, by Newton's method with halved steps; counts are smoothed at both ends."""
    n_hits, n_misses = hits.sum(), misses.sum()
    high, low = (n_hits + 1) / (n_hits + 2), 1 / (n_misses + 2)
    weight = hits + misses
    target = np.divide(hits * high + misses * low, weight, out=np.zeros(len(weight)), where=weight > 0)

    def loss(slope: float, shift: float) -> float:
        z = slope * margins + shift
        return float((weight * (np.logaddexp(0, z) - (1 - target) * z)).sum())

    slope, shift = 0.0, float(np.log((n_misses + 1) / (n_hits + 1)))
    best = loss(slope, shift)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(slope * margins + shift, -500, 500)))
        gradient = np.array([(weight * (target - p) * margins).sum(), (weight * (target - p)).sum()])
        spread = weight * p * (1 - p)
        hessian = np.array([[(spread * margins**2).sum(), (spread * margins).sum()], [(spread * margins).sum(), spread.sum()]]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-10 and loss(slope - size * step[0], shift - size * step[1]) > best:
            size /= 2
        slope, shift = slope - size * step[0], shift - size * step[1]
        now = loss(slope, shift)
        if best - now < 1e-9 * (1 + abs(best)):
            break
        best = now
    return float(slope), float(shift)


class KernelSVM(Estimator):
    """One machine per class against the rest; `gamma=None` takes 1 / (entries * variance of all entries).

    Labels are 0, 1, ... in `label_encoded`, features in `features`. A row in five, by
    its content, is held back for the sigmoids, unless a class would be left out on
    either side; then all rows serve both.
    """

    def __init__(self, iterations: int = 1000, waves: int = 256, gamma: float | None = None, seed: int = 42, parallel: int = 4, penalty: float = 1e-4):
        super().__init__()
        self.iterations, self.waves, self.width, self.seed, self.parallel, self.penalty = iterations, waves, gamma, seed, parallel, penalty

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        first = dataset.select("features").first()
        if first is None:
            raise ValueError("no rows to train on")
        size = first.features.size
        gamma = self.width or self._scale(dataset, size)
        raw = dataset.select("features", F.col("label_encoded").cast("double").alias("label_encoded"))
        waves = Waves(gamma=gamma, count=self.waves, size=size, seed=self.seed)
        rows = raw.withColumn("held", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(HELD_BACK)) == 0)
        # Only what the waves are made from is kept: they are made anew for each machine, which keeps them in its blocks.
        rows = rows.persist()
        try:
            sides = rows.groupBy("label_encoded").agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("used")).collect()
            split = all(row["held"] and row["used"] for row in sides)
            used = waves.transform(rows.filter("NOT held") if split else rows).select("waves", "label_encoded")
            columns = {"featuresCol": "waves", "labelCol": "label_encoded", "predictionCol": "margin_prediction"}
            machine = LinearSVC(maxIter=self.iterations, regParam=self.penalty, **columns)
            # One machine after the other: the blocks of one are kept at a time, and each fit is spread over all cores.
            classes = int(max(row["label_encoded"] for row in sides if row["label_encoded"] is not None)) + 1
            hit = F.col("label_encoded")
            machines = [machine.fit(used.withColumn("label_encoded", F.when(hit == number, 1.0).otherwise(0.0))) for number in range(classes)]
            model = OneVsRestModel(machines)
            model._set(classifier=machine, **columns)
            counts = self._counts(model.transform(waves.transform(rows.filter("held") if split else rows))).collect()
        finally:
            rows.unpersist()
        lines = []
        for number in range(len(model.models)):
            own = [row for row in counts if row["class"] == number]
            lines.append(fit_sigmoid(*(np.array([row[name] for row in own], float) for name in ("margin", "hits", "misses"))))
        return PipelineModel([waves, model, Sigmoids(slopes=[a for a, _ in lines], shifts=[b for _, b in lines])])

    @staticmethod
    def _scale(dataset: DataFrame, size: int) -> float:
        found = dataset.agg(Summarizer.metrics("mean", "normL2", "count").summary(F.col("features")).alias("s")).first().s
        spread = float((found.normL2.toArray() ** 2).sum() / (found["count"] * size) - found.mean.toArray().mean() ** 2)
        return 1 / (size * spread) if spread > 0 else 1.0

    @staticmethod
    def _counts(scored: DataFrame) -> DataFrame:
        """class, margin (rounded), hits, misses: at most 2 * STEPS * WIDEST + 1 rows per class."""
        each = scored.select("label_encoded", F.posexplode(vector_to_array("rawPrediction")).alias("class", "margin"))
        bounded = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("margin")))
        hit = F.col("label_encoded") == F.col("class")
        return each.groupBy("class", (F.round(bounded * STEPS) / STEPS).alias("margin")).agg(
            F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")
        )
