"""Chunked order-dependent operators and splits against plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docsluice.operators.feedback import update_points
from docsluice.operators.ordering import newest, newest_per_key, running_totals
from docsluice.operators.splits import hash_split, ordered_split, stratified_split
from docsluice.streaming.streams import passes_update_point


def test_running_totals_over_chunks(spark):
    # One group holds most rows, and they all have the same time.
    rows = [(number, "hot" if number % 3 else f"g{number % 7}", number % 2 if number % 5 == 0 else 1, number % 4) for number in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, grp string, ts long, amount long")
    found = running_totals(frame, ["grp"], ["ts", "doc_id"], {"n": F.lit(1), "total": F.col("amount")}, 17)
    seen: dict[str, tuple[int, int]] = defaultdict(lambda: (0, 0))
    expected = {}
    for number, group, _, amount in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        expected[number] = seen[group]
        seen[group] = (seen[group][0] + 1, seen[group][1] + amount)
    assert {r.doc_id: (r.n, r.total) for r in found.collect()} == expected


def test_ordered_split_cuts_at_the_right_row(spark):
    frame = spark.range(103).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("ts"))
    found = ordered_split(frame, ["ts", "doc_id"], rows_per_chunk=10).collect()
    ordered = sorted(found, key=lambda r: (r.ts, r.doc_id))
    assert [r.split for r in ordered] == ["train"] * 82 + ["validation"] * 21


def test_stratified_split_is_exact(spark):
    rows = [(number, "big" if number % 4 else f"small{number % 5}") for number in range(1003)] + [(5000, "single")]
    found = stratified_split(spark.createDataFrame(rows, "doc_id long, label string")).collect()
    assert len(found) == len(rows)
    sizes = Counter(label for _, label in rows)
    wanted = defaultdict(set)
    for label in sizes:
        members = [number for number, name in rows if name == label]
        members.sort(key=lambda number: (hashlib.md5(f"42-{number}".encode()).hexdigest(), number))
        wanted[label] = set(members[: int(sizes[label] * 0.2 + 0.5)])
    assert {r.doc_id for r in found if r.split == "test"} == set().union(*wanted.values())


def test_hash_split_keeps_everything(spark):
    counts = Counter(r.split for r in hash_split(spark.range(5000).withColumnRenamed("id", "doc_id")).collect())
    assert sum(counts.values()) == 5000
    assert 850 < counts["test"] < 1150


def test_newest(spark):
    frame = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 4, "b"), (4, 9, "b")], "doc_id long, ts_s long, key string")
    assert [r.doc_id for r in newest(frame, 2).collect()] == [4, 2]
    kept = newest_per_key(frame, "key")
    assert {(r.key, r.doc_id) for r in kept.collect()} == {("a", 2), ("b", 4)}
    assert kept.columns == frame.columns
    again = newest_per_key(kept.unionByName(frame), "key")
    assert {(r.key, r.doc_id) for r in again.collect()} == {("a", 2), ("b", 4)}


def test_update_points_saturate(spark):
    frame = spark.range(5003).select(F.col("id").alias("doc_id"), F.lit(0).alias("ts_s"))
    points = [r.arrived for r in update_points(frame, ["ts_s", "doc_id"], 1000).orderBy("arrived").collect()]
    assert points == [*range(100, 5001, 50), 5001, 5002, 5003]
    assert passes_update_point(0, 100) and passes_update_point(149, 150) and passes_update_point(5000, 5001)
    assert not passes_update_point(0, 99) and not passes_update_point(100, 149) and not passes_update_point(150, 150)
