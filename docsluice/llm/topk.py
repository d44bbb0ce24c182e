"""Exact top-k inner products over vectors in order of length.

Vectors are rotated into the basis of their singular vectors, where the first
coordinates hold most of a product, and cut into blocks of descending length. A
query meets the blocks in rounds that grow geometrically; between rounds its k best
scores give a threshold. A query leaves a block out if its length times that of the
block's longest vector cannot reach the threshold. Inside a block the partial product
over the first coordinates plus the product of the lengths of the rests bounds the
score (Cauchy-Schwarz); only vectors whose bound reaches the threshold get their
exact score, in integers.

Queries meet blocks as groups of rows, query block by vector block: neither side is
ever whole in one place, and a task holds one pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import kept

BLOCK = 4096
GROWTH = 4
TILE = 512
SLACK = 1e-9
FOUND = "ask long, query_id long, id long, score long"


def usable(vector: Column) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "vector", block: int = BLOCK
) -> DataFrame:
    """The k highest inner products of each query with all other rows: query_id, rank, <key>, score.

    `vector` holds arrays of integers. Rows whose key or vector is null or empty take
    no part. Only vectors of one dimension have products: each dimension is searched on
    its own. Rows that share a key are rows of their own, as candidates and as queries,
    but none of them is a candidate of another; a key that asks with several rows gets
    the k best products of all of them. Ties go to the smaller key. Fewer than k
    candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).filter("id IS NOT NULL AND size(v) > 0")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumns({"length": length, "row": F.monotonically_increasing_id()})
    rows = kept(rows, "topk-rows")
    dimensions = rows.groupBy(F.size("v").alias("d")).agg(F.count("*"), F.count_if("asks")).orderBy("d").collect()
    best = spark.createDataFrame([], FOUND)
    for d, count, asking in dimensions:
        if asking:
            best = best.unionByName(_search(rows.filter(F.size("v") == d), d, count, asking, k, block))
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _search(rows: DataFrame, d: int, count: int, asking: int, k: int, block: int) -> DataFrame:
    """The k best of each asking row among rows of one dimension."""
    spark = rows.sparkSession
    turn = _basis(rows, d)
    ordered = rows.repartitionByRange(-(-count // block), F.desc("length"), F.col("row"))
    blocks = kept(ordered.withColumn("block", F.spark_partition_id()), "topk-blocks")
    longest = blocks.groupBy("block").agg(F.max("length").alias("longest"))
    parts = -(-asking // block)
    queries = blocks.filter("asks").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    queries = queries.select("part", F.col("row").alias("ask"), F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("length").alias("q_length"))
    queries = kept(queries, "topk-queries")
    number = blocks.agg(F.max("block")).head()[0] + 1

    best = kept(spark.createDataFrame([], FOUND), "topk-best")
    first, size = 0, 1
    while first < number:
        last = min(number, first + size)
        bars = best.groupBy("ask").agg(
            F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("bar")
        )
        asked = queries.join(bars, "ask", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
        # The shortest candidate that may still matter to some query of a part.
        need = F.when(F.col("bar") <= 0, 0.0).otherwise(F.col("bar") / (F.col("q_length") * (1 + SLACK)))
        asked = kept(asked.withColumn("need", F.when(F.col("q_length") > 0, need).otherwise(0.0)), "topk-asked")
        pairs = (
            asked.groupBy("part")
            .agg(F.min("need").alias("need"))
            .withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
            .join(longest, "block")
            .filter("longest >= need")
            .select("part", "block")
        )
        pairs = kept(pairs, "topk-pairs")
        if pairs.isEmpty():
            break
        # The two sides need columns of their own.
        other = pairs.withColumnsRenamed({"part": "to", "block": "at"})
        met = (
            pairs.join(asked, "part")
            .groupBy("part", "block")
            .cogroup(other.join(blocks, F.col("at") == F.col("block")).groupBy("to", "at"))
            .applyInArrow(_meet(turn, k), FOUND)
        )
        in_order = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
        best = best.unionByName(met).withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)
        best = kept(best.drop("rank"), "topk-best")
        first, size = last, size * GROWTH
    return best


def _basis(rows: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors, from the d x d matrix of sums of products: one small matrix per task."""

    def products(batches):
        total = np.zeros((d, d))
        for batch in batches:
            v = _matrix(batch.column("v"), d).astype(float)
            total += v.T @ v
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(d * d)), "part": pa.array(total.ravel())})

    sums = rows.select("v").mapInArrow(products, "place long, part double").groupBy("place").agg(F.sum("part").alias("s"))
    total = np.zeros(d * d)
    for row in sums.collect():
        total[row["place"]] = row["s"]
    scale = np.abs(total).max() or 1.0
    values, turn = np.linalg.eigh(total.reshape(d, d) / scale)
    return turn[:, np.argsort(-values)]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _meet(turn: np.ndarray, k: int):
    """Function for a block of queries and a block of vectors: each query's k best of the block, if they reach its bar."""
    d = len(turn)
    head = max(1, d // 4)

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        found = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        if not asked.num_rows or not block.num_rows:
            return found.empty_table()
        block = block.sort_by([("length", "descending"), ("id", "ascending")])
        q, x = _matrix(asked.column("q"), d), _matrix(block.column("v"), d)
        asks, q_ids, ids = asked.column("ask").to_numpy(), asked.column("query_id").to_numpy(), block.column("id").to_numpy()
        bars, q_length = asked.column("bar").to_numpy().copy(), asked.column("q_length").to_numpy()
        x_length = block.column("length").to_numpy()
        small = d * float(np.abs(q).max()) * float(np.abs(x).max()) < 2**53
        exact = (lambda a, b: (a.astype(float) @ b.T.astype(float)).astype(np.int64)) if small else (lambda a, b: a @ b.T)
        q_turned, x_turned = q @ turn, x @ turn
        q_rest, x_rest = (np.sqrt((m[:, head:] ** 2).sum(1)) for m in (q_turned, x_turned))
        best = [np.zeros(0, np.int64) for _ in range(3)]
        for at in range(0, len(x), TILE):
            to = min(len(x), at + TILE)
            alive = np.flatnonzero(q_length * x_length[at] * (1 + SLACK) >= bars)
            if not len(alive):
                break
            bound = q_turned[alive, :head] @ x_turned[at:to, :head].T + np.outer(q_rest[alive], x_rest[at:to])
            bound += SLACK * np.outer(q_length[alive], x_length[at:to])
            open_ = (bound >= bars[alive, None]) & (q_ids[alive, None] != ids[None, at:to])
            if open_.mean() > 0.05:
                scores = exact(q[alive], x[at:to])
                open_ &= scores >= bars[alive, None]
                if to - at > k:
                    lowest = np.iinfo(np.int64).min
                    kth = np.partition(np.where(open_, scores, lowest), to - at - k, axis=1)[:, to - at - k]
                    open_ &= scores >= kth[:, None]
                rows, columns = np.nonzero(open_)
                reached = scores[rows, columns]
            else:
                rows, columns = np.nonzero(open_)
                reached = (q[alive[rows]] * x[at + columns]).sum(1)
            best = [np.concatenate(pair) for pair in zip(best, (alive[rows], reached, ids[at + columns]))]
            order = np.lexsort((best[2], -best[1], best[0]))
            best = [column[order] for column in best]
            starts = np.searchsorted(best[0], best[0])
            best = [column[np.arange(len(starts)) - starts < k] for column in best]
            counts = np.bincount(best[0], minlength=len(q))
            full = np.flatnonzero(counts >= k)
            last = np.cumsum(counts)[full] - 1
            bars[full] = np.maximum(bars[full], best[1][last])
        return pa.table([asks[best[0]], q_ids[best[0]], best[2], best[1]], schema=found)

    return meet
