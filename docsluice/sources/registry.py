"""Published versions of what the router has learned: a threshold and a confidence predictor.

A version is one small file in `manifest`, named by its number. It is written under
another name and renamed, after the predictor it names is complete, so that a reader
meets a whole version or none. What stands under a number is never changed: a job that
runs again finds its version and leaves it. A version without a predictor of its own
names that of the version before.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from docsluice.operators.confidence import ConfidenceModel, load_confidence, save_confidence
from docsluice.session import exists, hadoop_place, read_text, write_once


@dataclass(frozen=True)
class Published:
    version: int
    threshold: float
    # Number of the version whose predictor is in use; None as long as none was trained.
    predictor: int | None


def publish(
    spark: SparkSession, root: str, version: int, threshold: float, predictor: ConfidenceModel | None = None
) -> Published:
    """Makes a version known; gives the one that stands under this number, which may be older."""
    name = f"{root}/manifest/{version:012d}.json"
    if exists(spark, name):
        return _read(spark, name)
    trained = version
    if predictor is None:
        before = published(spark, root, version - 1)
        trained = None if before is None else before.predictor
    else:
        save_confidence(predictor, _predictor(root, version), spark)
    # If another writer was first, that version stands.
    write_once(spark, name, json.dumps(asdict(Published(version, float(threshold), trained))))
    return _read(spark, name)


def published(spark: SparkSession, root: str, version: int | None = None) -> Published | None:
    """The newest version, or the newest not above the given one; None as long as there is none."""
    place, system = hadoop_place(spark, f"{root}/manifest")
    if not system.exists(place):
        return None
    names = [entry.getPath().getName() for entry in system.listStatus(place)]
    known = [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith(".")]
    known = [number for number in known if version is None or number <= version]
    return _read(spark, f"{root}/manifest/{max(known):012d}.json") if known else None


def load_predictor(spark: SparkSession, root: str, entry: Published | None) -> ConfidenceModel | None:
    """The predictor that a version uses."""
    return None if entry is None or entry.predictor is None else load_confidence(_predictor(root, entry.predictor), spark)


def _predictor(root: str, version: int) -> str:
    return f"{root}/predictors/{version:012d}"


def _read(spark: SparkSession, name: str) -> Published:
    return Published(**json.loads(read_text(spark, name)))
