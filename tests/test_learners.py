"""The kernel machine and the boosting of several classes against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from docsluice.operators.boosting import SoftmaxBoosting
from docsluice.operators.kernel_svm import KernelSVM, Waves, fit_sigmoid
from docsluice.operators.learners import MODEL_NAMES, estimators, predict, train_models
from docsluice.operators.vectors import columns_of


def labelled(spark, rows):
    return spark.createDataFrame([(Vectors.dense(x) if n % 2 else Vectors.sparse(len(x), dict(enumerate(x))), float(y)) for n, (x, y) in enumerate(rows)], ["features", "label_encoded"])


def test_columns_of_vectors():
    stored = pd.DataFrame(
        {"type": [0, 1, 0], "indices": [[1, 4], None, []], "values": [[2.0, 5.0], [1.0, 2.0, 3.0, 4.0, 6.0], []]}
    )
    assert columns_of(stored, np.array([0, 1, 4])).tolist() == [[0, 2, 5], [1, 2, 6], [0, 0, 0]]
    assert columns_of(stored, np.array([], int)).shape == (3, 0)


def test_waves_approach_the_kernel(spark):
    draw = random.Random(3)
    points = [[draw.uniform(-1, 1) for _ in range(3)] for _ in range(12)]
    found = Waves(gamma=0.7, count=4096, size=3).transform(labelled(spark, [(x, 0) for x in points])).select(vector_to_array("waves").alias("w"), vector_to_array("features").alias("x")).collect()
    for a in found:
        for b in found:
            kernel = math.exp(-0.7 * sum((p - q) ** 2 for p, q in zip(a.x, b.x)))
            assert abs(np.dot(a.w, b.w) - kernel) < 0.08


def test_sigmoid_is_the_most_likely():
    draw = random.Random(8)
    margins = np.array([n / 8 - 4 for n in range(65)])
    hits = np.array([sum(draw.random() < 1 / (1 + math.exp(-1.7 * m + 0.4)) for _ in range(40)) for m in margins], float)
    slope, shift = fit_sigmoid(margins, hits, 40 - hits)
    assert abs(slope + 1.7) < 0.3 and abs(shift - 0.4) < 0.3

    def loss(a: float, b: float) -> float:
        high, low = (hits.sum() + 1) / (hits.sum() + 2), 1 / ((40 - hits).sum() + 2)
        p = 1 / (1 + np.exp(a * margins + b))
        t = hits * high + (40 - hits) * low
        return float(-(t * np.log(p) + (40 - t) * np.log(1 - p)).sum())

    assert all(loss(slope, shift) <= loss(slope + a, shift + b) for a in (-0.01, 0, 0.01) for b in (-0.01, 0, 0.01))
    # Margins that part the classes leave the sigmoid finite.
    assert all(map(math.isfinite, fit_sigmoid(np.array([-1.0, 1.0]), np.array([0.0, 9.0]), np.array([9.0, 0.0]))))


def test_radial_kernel_tells_a_ring_and_survives_storage(spark, tmp_path):
    draw = random.Random(4)
    rows = []
    for _ in range(400):
        angle, radius = draw.uniform(0, 2 * math.pi), draw.choice([0.3, 0.9, 1.5])
        rows.append(([radius * math.cos(angle), radius * math.sin(angle)], [0.3, 0.9, 1.5].index(radius)))
    data = labelled(spark, rows)
    models, problems = train_models(data, {"SVM": KernelSVM(iterations=40, waves=128)})
    assert not problems
    scored = predict(data.withColumn("row", F.monotonically_increasing_id()), "SVM", models["SVM"], ["a", "b", "c"])
    right = scored.filter(F.col("prediction") == F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("label_encoded").cast("int"))).count()
    assert right >= 360 and scored.filter("confidence IS NULL OR confidence < 1/3 - 1e-9 OR confidence > 1").isEmpty()
    PipelineModel([models["SVM"]]).write().overwrite().save(str(tmp_path / "svm"))
    again = predict(data, "SVM", PipelineModel.load(str(tmp_path / "svm")).stages[0], ["a", "b", "c"])
    assert again.select("prediction", "confidence").exceptAll(scored.select("prediction", "confidence")).isEmpty()


def plain_boosting(rows, classes: int, rounds: int, rate: float) -> list[float]:
    """Losses of boosting with stumps, by loops over all thresholds."""
    counts = [sum(y == k for _, y in rows) for k in range(classes)]
    scores = [[math.log(c / len(rows)) for c in counts] for _ in rows]

    def chances(s):
        total = sum(math.exp(x) for x in s)
        return [math.exp(x) / total for x in s]

    def loss():
        return -sum(math.log(chances(s)[y]) for s, (_, y) in zip(scores, rows)) / len(rows)

    losses = [loss()]
    for _ in range(rounds):
        now = [chances(s) for s in scores]
        for k in range(classes):
            weight = [p[k] * (1 - p[k]) for p in now]
            step = [max(-4.0, min(4.0, ((y == k) - p[k]) / w)) for (_, y), p, w in zip(rows, now, weight)]
            best = None
            for feature in range(len(rows[0][0])):
                values = sorted({x[feature] for x, _ in rows})
                for low, high in zip(values, values[1:]):
                    cut, gain, parts = (low + high) / 2, 0.0, []
                    for side in (True, False):
                        own = [n for n, (x, _) in enumerate(rows) if (x[feature] <= cut) == side]
                        mean = sum(step[n] * weight[n] for n in own) / sum(weight[n] for n in own)
                        gain += sum(weight[n] for n in own) * mean**2
                        parts.append((own, mean))
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, parts)
            for own, mean in best[1]:
                for n in own:
                    scores[n][k] += rate * mean
        losses.append(loss())
    return losses


def test_boosting_equals_plain_loops(spark, tmp_path):
    draw = random.Random(12)
    rows = [([float(draw.randint(0, 9)), float(draw.randint(0, 6)) / 2], 0) for _ in range(90)]
    rows = [(x, 0 if x[0] < 3 else 1 if x[1] + draw.random() > 2 else 2) for x, _ in rows]
    data = labelled(spark, rows)
    model = SoftmaxBoosting(rounds=6, depth=1).fit(data)
    losses = model.getOrDefault("losses")
    expected = plain_boosting(rows, 3, 6, 0.1 * 2 / 3)
    assert np.allclose(losses, expected, atol=1e-9)
    assert all(now < before for before, now in zip(losses, losses[1:]))
    deep = SoftmaxBoosting(rounds=8, depth=3, rate=0.5).fit(data)
    assert deep.transform(data).filter("prediction = label_encoded").count() >= 80
    PipelineModel([deep]).write().overwrite().save(str(tmp_path / "boosting"))
    again = PipelineModel.load(str(tmp_path / "boosting")).stages[0].transform(data)
    assert again.select("probability").exceptAll(deep.transform(data).select("probability")).isEmpty()


def test_boosting_of_one_class_and_of_nothing(spark):
    alone = SoftmaxBoosting(rounds=3).fit(labelled(spark, [([1.0], 0), ([2.0], 0)]))
    assert alone.transform(labelled(spark, [([3.0], 0)])).first().prediction == 0.0
    data = labelled(spark, [([1.0], 0)]).filter("false")
    models, problems = train_models(data, {name: estimators()[name] for name in ("SVM", "Gradient Boosting")})
    assert not models and set(problems) == {"SVM", "Gradient Boosting"} <= set(MODEL_NAMES)
