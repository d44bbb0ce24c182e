"""Upserts into hash buckets against a plain dictionary."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docsluice.session import read_text, write_once
from docsluice.sources.files import scan_files
from docsluice.sources.upserts import files_of, forget_before, read_upserted, upsert

SCHEMA = "k string, ts_s long, doc_id long, value string, _other string"


def test_upserts_equal_a_dictionary(spark, tmp_path):
    root, draw, known = str(tmp_path / "table"), random.Random(2), {}
    with pytest.raises(ValueError):
        read_upserted(spark, root)
    for turn in range(4):
        rows = [(f"k{draw.randint(0, 60)}", draw.randint(0, 9), turn * 100 + n, f"v{turn}", None) for n in range(20)]
        rows += [(None, 1, 1, "no key", None), ("k1", None, 1, "no time", None)]
        for row in rows:
            if row[0] is not None and row[1] is not None and (row[0] not in known or row[1:3] > known[row[0]][1:3]):
                known[row[0]] = row
        frame = spark.createDataFrame(rows, SCHEMA)
        if turn:
            # The table itself takes part: its rows change nothing.
            frame = frame.unionByName(read_upserted(spark, root))
        assert upsert(spark, root, frame, "k", buckets=8) == turn + 1
        assert sorted(map(tuple, read_upserted(spark, root).collect())) == sorted(known.values())
    first = sorted(map(tuple, read_upserted(spark, root, 1).collect()))
    assert len(first) == len({row[0] for row in first}) and all(row[3] == "v0" for row in first)
    before = files_of(spark, root, 4)
    upsert(spark, root, spark.createDataFrame([("k5", 99, 1, "new", None)], SCHEMA), "k")
    after = files_of(spark, root, 5)
    assert [before.get(n) == after[n] for n in sorted(after)].count(False) == 1
    assert upsert(spark, root, spark.createDataFrame([], SCHEMA), "k") == 6
    forget_before(spark, root, 6)
    known["k5"] = ("k5", 99, 1, "new", None)
    assert sorted(map(tuple, read_upserted(spark, root).collect())) == sorted(known.values())


def test_a_second_writer_is_refused(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1, 1, "x", None)], SCHEMA)
    upsert(spark, root, rows, "k")
    # The other writer publishes while this one is at work.
    slow = rows.withColumn("value", F.udf(lambda value: write_slowly(root, value))("value"))
    with pytest.raises(RuntimeError):
        upsert(spark, root, slow, "k")
    name = f"{root}/manifest/000000000007.json"
    assert write_once(spark, name, "one") and not write_once(spark, name, "two") and read_text(spark, name) == "one"


def write_slowly(root: str, value: str) -> str:
    from pathlib import Path

    Path(root, "manifest", "000000000002.json").write_text("{}")
    return value


def test_paths_given_twice_are_read_twice(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    one, both = str(tmp_path / "a.txt"), str(tmp_path)
    found = [row["path"].rpartition("/")[2] for row in scan_files(spark, [one, one, both, one, both]).collect()]
    assert sorted(found) == ["a.txt"] * 5 + ["b.txt"] * 2
