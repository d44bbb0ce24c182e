"""The filter by keys: all keys pass, few others do, in one block or several."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsluice.operators.prefilter import BITMAP_BYTES, SCANS, likely_among


@pytest.mark.parametrize("count, most_bytes", [(1, 64 << 20), (1_000, 64 << 20), (100_000, 64 << 20), (100_000, 10 * BITMAP_BYTES), (1_000_000, 64 << 20)])
def test_false_share_does_not_depend_on_the_number(spark, count, most_bytes):
    rows = spark.range(2 * count + 20_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("__text"))
    keys = rows.select((F.col("doc_id") * 2).alias("doc_id")).filter(F.col("doc_id") < 2 * count)
    found = likely_among(rows, keys, most_bytes=most_bytes)
    chosen = F.col("doc_id").between(0, 2 * count - 1) & (F.col("doc_id") % 2 == 0)
    kept, others = found.agg(F.count_if(chosen), F.count_if(~chosen)).first()
    assert kept == count and found.columns == rows.columns
    assert others < 0.02 * (count + 20_000)


def test_keys_of_any_kind(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "doc_id string, n int")
    found = likely_among(rows, spark.createDataFrame([("a",), (None,)], "doc_id string"))
    assert sorted(row["n"] for row in found.collect() if row["doc_id"] == "a") == [1, 4]
    assert all(row["doc_id"] is not None for row in found.collect())
    assert likely_among(rows, rows.select("doc_id").filter("false")).count() == 0


def test_scans_do_not_grow_with_the_keys(spark):
    """Far more bitmaps than are met at a time: all keys pass, few others do, in one pass over the rows."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("__text"))
    keys = rows.select("doc_id").filter("doc_id % 2 = 0")
    found = likely_among(rows.unionByName(rows.filter("doc_id < 10").withColumn("doc_id", F.lit(None).cast("long"))), keys, most_bytes=BITMAP_BYTES)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 2 * SCANS
    kept, others = found.agg(F.count_if(F.col("doc_id") % 2 == 0), F.count_if(F.col("doc_id") % 2 == 1)).first()
    assert kept == 30_000 and others < 0.02 * 30_000 and found.columns == rows.columns
