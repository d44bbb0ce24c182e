"""Files of one JSON value each, read in small ranges, against a parser that reads them whole."""

from __future__ import annotations

import json
import random
from contextlib import contextmanager

import pytest

from docsluice.sources.json_items import _signs, json_items
from docsluice.sources.tables import import_ground_truth, read_examples

SPLIT = "spark.sql.files.maxPartitionBytes"


@contextmanager
def ranges_of(spark, size):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, str(size))
    try:
        yield
    finally:
        spark.conf.set(SPLIT, before)


def values(count, seed=3):
    draw = random.Random(seed)
    signs = ['"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "é", "日", "\U0001f600", "x", "}]", '\\"', "\\\\"]
    made = []
    for number in range(count):
        text = "".join(draw.choices(signs, k=draw.randrange(60)))
        nested = [{"t": text, "l": [1, [2, {"u": text[::-1]}], {}]}, [], None, text, number, True]
        made.append({"n": number, "text": text, "more": draw.choice(nested), "long": "}" * draw.choice([0, 0, 5, 3000])})
    return made


@pytest.mark.parametrize("size, indent, most_bytes", [(300, None, 8 << 20), (300, 2, 0), (5000, 2, 8 << 20), (1 << 20, None, 8 << 20), (1 << 20, 2, 0)])
def test_items_of_arrays_and_objects(spark, tmp_path, size, indent, most_bytes):
    expected = values(120) + [[], {}, "a}b", 5, None, [[{}], "]"]]
    keyed = {f'k{n}"}}{{,\\': value for n, value in enumerate(expected)}
    (tmp_path / "array.json").write_text(json.dumps(expected, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "object.json").write_text("﻿" + json.dumps(keyed, indent=indent))
    for name, text in (("empty", ""), ("blank", " \n"), ("none", "[ ]"), ("nothing", "{\n}")):
        (tmp_path / f"{name}.json").write_text(text)
    with ranges_of(spark, size):
        rows = json_items(spark, f"{tmp_path}/*.json", most_bytes).collect()
    found = [json.loads(row["item"]) for row in rows if row["path"].endswith("array.json")]
    pairs = [json.loads("{" + row["item"] + "}") for row in rows if row["path"].endswith("object.json")]
    assert len(found) + len(pairs) == len(rows)
    order = json.dumps
    assert sorted(map(order, found)) == sorted(map(order, expected))
    assert len(pairs) == len(keyed) and {key: value for pair in pairs for key, value in pair.items()} == keyed


def test_a_file_is_cut_into_many_ranges(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(values(200)))
    with ranges_of(spark, 2000):
        lines = spark.read.option("lineSep", "}").text(str(tmp_path / "one.json"))
        assert lines.rdd.getNumPartitions() >= 4
        assert json_items(spark, str(tmp_path / "one.json")).count() == 200


def test_a_broken_file_gives_what_stands_before_the_break(spark, tmp_path):
    whole = json.dumps([{"n": n, "in": {"m": n}} for n in range(50)])
    (tmp_path / "broken.json").write_text(whole[: whole.index('{"n": 40') + 12])
    with ranges_of(spark, 200):
        found = [json.loads(row["item"])["n"] for row in json_items(spark, str(tmp_path / "broken.json")).collect()]
    assert sorted(found) == list(range(40))


def test_tables_from_split_files(spark, tmp_path):
    examples = [{"routing_decision": "ML", "ml_confidence": n / 100, "actual_category": 'a "}" b'} for n in range(100)]
    (tmp_path / "examples.json").write_text(json.dumps([*examples, 7, "x"]))
    truth = {f"k{n}": {"content": "}{" * n, "true_category": "memo" if n % 2 else None} for n in range(100)}
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    with ranges_of(spark, 500):
        read = read_examples(spark, str(tmp_path / "examples.json"), whole_file=True).collect()
        rows = import_ground_truth(spark, str(tmp_path / "truth.json")).collect()
    assert sorted(row.ml_confidence for row in read) == [n / 100 for n in range(100)]
    assert {row.actual_category for row in read} == {'a "}" b'}
    assert {row.content_hash: row.content for row in rows} == {f"k{n}": "}{" * n for n in range(1, 100, 2)}


def test_signs_outside_strings():
    text = rb'{"a\\": "b\",", "c": [1]}'
    places, codes, inside = _signs(text, False)
    assert bytes(codes) == b"{,[]}" and not inside
    assert [text[place] for place in places] == list(codes)
    # Entered inside a string, everything up to the first quote belongs to it.
    assert bytes(_signs(rb'},", {', True)[1]) == b",{"
    assert _signs(b'"', False)[2] and not _signs(b'"', True)[2]
