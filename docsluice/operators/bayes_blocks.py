"""Multinomial naive Bayes over any number of classes: the model stays a table, a row per class, and is met block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.operators.terms import entries
from docsluice.session import reliable

CLASSES = 1024
DOCUMENTS = 16384
PRODUCTS = 1 << 22


def fit_bayes_blocks(vectors: DataFrame, vocabulary: DataFrame, label: str = "label", alpha: float = 1.0) -> DataFrame:
    """The model, a row per class: label, log_prior, base, indices, gains.

    A term that a class never saw has the log-likelihood `base`, one at `indices` its
    gain more. A row holds at most a number per vocabulary term; the driver sees two
    counts. `alpha` must be above 0. Rows without a label are a class of their own.
    """
    if alpha <= 0:
        raise ValueError("alpha must be above 0")
    # The place -1 stands among the term numbers for the document itself.
    document = F.array(F.struct(F.lit(-1).alias("index"), F.lit(1.0).alias("weight")))
    rows = vectors.select(F.col(label).cast("string").alias("label"), F.inline(F.concat(document, entries(F.col("term_vector")))))
    sums = reliable(rows.groupBy("label", "index").agg(F.sum("weight").alias("weight")))
    documents = sums.filter("index = -1").agg(F.sum("weight")).head()[0]
    if documents is None:
        raise ValueError("there are no rows to learn from")
    size = vocabulary.count()
    is_term = F.col("index") >= 0
    gained = F.struct(F.col("index"), F.log((F.col("weight") + alpha) / alpha).alias("gain"))
    classes = sums.groupBy("label").agg(
        F.log(F.sum(F.when(~is_term, F.col("weight"))) / documents).alias("log_prior"),
        F.log(alpha / (F.coalesce(F.sum(F.when(is_term, F.col("weight"))), F.lit(0.0)) + alpha * size)).alias("base"),
        F.collect_list(F.when(is_term & (F.col("weight") != 0), gained)).alias("gained"),
    )
    return reliable(classes.select("label", "log_prior", "base", F.col("gained.index").alias("indices"), F.col("gained.gain").alias("gains")))


def score_bayes_blocks(vectors: DataFrame, model: DataFrame, key: str = "doc_id", classes: int = CLASSES, documents: int = DOCUMENTS) -> DataFrame:
    """Rows (key, category, confidence): the likeliest class of each vector, ties to the smaller label.

    About `documents` vectors meet about `classes` classes per group; what a group finds,
    the best class and the sum of the chances, is a row per vector, and these are merged
    by vector. Rows that share a key are scored each on its own.
    """
    rows = vectors.select(F.col(key).alias("_key"), entries(F.col("term_vector")).alias("_entries"))
    rows = reliable(rows.withColumn("_row", F.monotonically_increasing_id()))
    blocks = max(1, -(-model.count() // classes))
    parts = max(1, -(-rows.count() // documents))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int")).select("_row", "_entries", "_part", every(blocks).alias("_block"))
    offered = model.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")).select("*", every(parts).alias("part"))
    met = (
        asked.groupBy("_part", "_block")
        .cogroup(offered.groupBy("part", "block"))
        .applyInArrow(_meet, "row long, label string, top double, total double")
    )
    # A row per block and vector.
    found = met.groupBy("row").agg(
        F.min(F.struct((-F.col("top")).alias("down"), "label")).alias("best"), F.collect_list(F.struct("top", "total")).alias("blocks")
    )
    chances = F.aggregate("blocks", F.lit(0.0), lambda total, block: total + block["total"] * F.exp(block["top"] + F.col("best.down")))
    found = found.select("row", F.col("best.label").alias("category"), (1 / chances).alias("confidence"))
    return rows.join(found, F.col("_row") == F.col("row")).select(F.col("_key").alias(key), "category", "confidence")


def _meet(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Each vector's best class of the block, its score, and the sum of all chances relative to it."""
    schema = pa.schema([("row", pa.int64()), ("label", pa.string()), ("top", pa.float64()), ("total", pa.float64())])
    if not asked.num_rows or not model.num_rows:
        return schema.empty_table()
    labels = model.column("label").to_pylist()
    order = sorted(range(len(labels)), key=lambda place: (labels[place] is not None, labels[place] or ""))
    model = model.take(order).combine_chunks()
    labels = model.column("label")
    prior, base = model.column("log_prior").to_numpy(), model.column("base").to_numpy()
    indices, gains = (_flat(model.column(name)) for name in ("indices", "gains"))
    terms, place = np.unique(indices, return_inverse=True)
    # A row per term of the block, and a last one for all other terms.
    matrix = np.zeros((len(terms) + 1, len(prior)))
    matrix[place, np.repeat(np.arange(len(prior)), _sizes(model.column("indices")))] = gains

    asked = asked.combine_chunks()
    index, weight = (_flat(asked.column("_entries"), name) for name in ("index", "weight"))
    at = np.searchsorted(terms, index)
    at[np.append(terms, -1)[at] != index] = len(terms)
    ends = np.cumsum(_sizes(asked.column("_entries")))
    best, tops, totals = [], [], []
    for first, last in _slices(ends, max(1, PRODUCTS // len(prior))):
        starts = np.concatenate([[ends[first - 1] if first else 0], ends[first : last - 1]])
        low, high = starts[0], ends[last - 1]
        filled = np.flatnonzero(ends[first:last] > starts)
        scores = np.tile(prior, (last - first, 1))
        if len(filled):
            inner = starts[filled] - low
            scores[filled] += np.add.reduceat(weight[low:high, None] * matrix[at[low:high]], inner, axis=0)
            scores[filled] += np.add.reduceat(weight[low:high], inner)[:, None] * base
        winner = scores.argmax(axis=1)
        top = scores[np.arange(last - first), winner]
        best.append(winner)
        tops.append(top)
        totals.append(np.exp(scores - top[:, None]).sum(axis=1))
    return pa.table([asked.column("_row"), labels.take(pa.array(np.concatenate(best))), np.concatenate(tops), np.concatenate(totals)], schema=schema)


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of vectors with at most `most` entries, or of one vector; no run has more vectors than that either."""
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = int(np.searchsorted(ends, before + most, side="right"))
        last = min(max(last, first + 1), first + most)
        yield first, last
        first = last


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return np.nan_to_num(pc.list_value_length(column).to_numpy().astype(float)).astype(np.int64)


def _flat(column: pa.ChunkedArray, field: str | None = None) -> np.ndarray:
    values = pc.list_flatten(column).combine_chunks()
    return (values if field is None else pc.struct_field(values, field)).to_numpy(zero_copy_only=False)
