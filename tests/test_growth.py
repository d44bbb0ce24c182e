"""Work that must not grow faster than the rows: passes over texts, waiting for slow calls, what is kept and shuffled."""

from __future__ import annotations

import glob
import inspect
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks import tables_and_streams, terms_and_models
from checks.registry import ORACLES, QUERIES
from docsluice.config import TermConfig
from docsluice.llm import packing
from docsluice.llm.common import kept
from docsluice.llm.mixing import mix_sources
from docsluice.llm.packing import pack
from docsluice.operators import boosting, confidence, features, kernel_svm, model_call, terms
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


def test_a_slow_call_does_not_hold_up_the_others():
    def ask(text):
        time.sleep(0.3 if int(text) % 100 == 0 else 0)
        return text, None, 1, 0.0

    batches = [pd.DataFrame({"prompt": [str(n) for n in range(at, at + 500)]}) for at in range(0, 3000, 500)]
    began = time.monotonic()
    found = [answer[0] for _, answers in model_call._answered(iter(batches), "prompt", ask, 16) for answer in answers]
    assert found == [str(n) for n in range(3000)] and time.monotonic() - began < 2.5


def test_little_text_is_held(monkeypatch):
    """Rows that are out hold no more text than HELD, and come back in their order."""
    monkeypatch.setattr(model_call, "HELD", 50)
    batches = [pd.DataFrame({"prompt": [f"{n:010d}" for n in range(at, at + 20)]}) for at in (0, 20)]
    found = [answer[0] for _, answers in model_call._answered(iter(batches), "prompt", lambda text: (text, None, 1, 0.0), 4) for answer in answers]
    assert found == [f"{n:010d}" for n in range(40)]


def test_terms_are_counted_without_a_shuffle_of_terms(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (None, ["a", None, None])]
    single = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    assert "Exchange" not in terms.term_frequency(single)._jdf.queryExecution().executedPlan().toString()
    expected = [(1, "a", 1), (1, "b", 2), (None, "a", 1), (None, None, 2)]
    assert sorted(map(tuple, terms.term_frequency(single).collect()), key=str) == sorted(expected, key=str)
    twice = spark.createDataFrame([*rows, (1, ["b", "c"]), (None, ["a"])], "doc_id long, terms array<string>")
    expected = [(1, "a", 1), (1, "b", 3), (1, "c", 1), (None, "a", 2), (None, None, 2)]
    assert sorted(map(tuple, terms.term_frequency(twice).collect()), key=str) == sorted(expected, key=str)


def test_no_string_is_sorted_or_shuffled_by_document_for_the_vocabulary(spark):
    """Terms are summed as Arrow columns before the one shuffle by term; repeated and null terms and rows count as they did."""
    rows = [(1, ["b", "a", "b", "a b"]), (1, ["b", None]), (2, []), (3, None), (None, ["a", None, None]), (None, ["\u00e9", "a b", "a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>").coalesce(1)
    found = terms.document_frequency(docs, TermConfig(min_df=1, max_df=1.0))
    assert sorted(map(tuple, found.collect())) == [("a", 2, 2, 6), ("a b", 3, 2, 6), ("b", 3, 2, 6), ("\u00e9", 1, 1, 6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "MapInArrow" in plan


def test_sums_of_terms_stay_small(monkeypatch):
    """What a task holds is bounded, and what it hands on adds up to all terms."""
    monkeypatch.setattr(terms, "HELD_BYTES", 2000)
    monkeypatch.setattr(terms, "TERMS", 50)
    lists = [[f"w{(row * 7 + place) % 90}" for place in range(10)] for row in range(200)]
    batch = pa.RecordBatch.from_pydict({"terms": pa.array([*lists, None, []], pa.list_(pa.string()))})
    found = pa.Table.from_batches(terms._sum_terms(iter([batch]))).to_pylist()
    times = Counter(term for row in lists for term in row)
    assert len(found) > len(times) and {len(row) for row in lists} == {10}
    for term, n in times.items():
        assert sum(row["tf"] for row in found if row["term"] == term) == sum(row["df"] for row in found if row["term"] == term) == n


def test_terms_of_odd_texts(spark):
    """Runs of two letters, digits or underscores at least, the stop words left out before pairs are made."""
    texts = [None, "", "a", "The cat, a CAT\u00c9 __ 42!", "x\ty", "\u4e2d\u6587 \u00dcber\u00fc_1 \U0001d400\U0001d401", " ab  ab\nab "]
    docs = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "doc_id long, content string")
    found = terms.with_terms(docs, "content", TermConfig(stop_words=("the",))).orderBy("doc_id").collect()
    tokens = [[], [], [], ["cat", "cat\u00e9", "__", "42"], [], ["\u4e2d\u6587", "\u00fcber\u00fc_1", "\U0001d400\U0001d401"], ["ab", "ab", "ab"]]
    assert [row.terms for row in found] == [[*words, *map(" ".join, zip(words, words[1:]))] for words in tokens]


def test_small_tables_need_no_python_workers(spark, monkeypatch):
    """Sources and plans that the driver knows go to Spark as Arrow data: lists would start workers of a second kind in every executor."""
    rows = [(n, f"some words of the text {n}", f"src{n % 3}" if n % 5 else None) for n in range(40)]
    docs = kept(spark.createDataFrame(rows, "doc_id long, text string, source string"), "small-docs")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_, **__: pytest.fail("a list went through Python workers"))
    chosen, table = mix_sources(docs, F.array("source"))
    assert chosen.count() == 40 and sorted(str(row.source) for row in table.collect()) == ["None", "src0", "src1", "src2"]
    assert pack(docs).select("doc_id").distinct().count() == 40


def test_pieces_are_made_a_little_at_a_time(monkeypatch):
    """Ids are cut and handed on in batches of bounded size, however much comes at once."""
    ids = [bytes(2 * (400 + row % 7)) for row in range(600)]
    sizes = [len(row) // 2 for row in ids]
    ends = np.cumsum(sizes)
    columns = {"id": list(range(600)), "source": ["a"] * 600, "queue": pa.array([0] * 600, pa.int32()), "at": ends - sizes, "n": sizes, "ids": ids}
    batch = pa.RecordBatch.from_pydict(columns)
    monkeypatch.setattr(packing, "AT_ONCE", 20_000)
    pieces = list(packing._cut(packing.Schedule([int(ends[-1])], [1.0], 2048, 2048), None)(iter([batch])))
    assert max(sum(map(len, part.column("ids").to_pylist())) for part in pieces) <= 2 * 20_000
    whole = pa.Table.from_batches(pieces)
    monkeypatch.setattr(packing, "AT_ONCE", 1 << 22)
    assert whole.equals(pa.Table.from_batches(packing._cut(packing.Schedule([int(ends[-1])], [1.0], 2048, 2048), None)(iter([batch]))))


def test_examples_are_read_once(spark):
    """Training a forecast makes the features of a text once, however often the split goes through the rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(number):
        seen.add(1)
        return f"word {number} and some more words of a text"

    docs = spark.range(0, 80, 1, 2).select(F.col("id").alias("doc_id"), read("id").alias("content"), F.lit(None).cast("string").alias("sender_email"), F.lit("txt").alias("file_extension"))
    rows = features.with_features(docs).select("doc_id", "features", (F.col("features.word_count") / 10 + F.col("doc_id") / 1000).alias("ml_confidence"))
    assert confidence.train_confidence(rows, ["doc_id"], iterations=1, depth=1).examples == 80
    # A plan may hold the text twice for its columns, but is run once.
    assert seen.value <= 2 * 80


def test_the_forecast_is_trained_in_full(spark, monkeypatch):
    """train_confidence takes as many trees, and as deep ones, as the operator does by itself; here it is only noted."""
    asked, train = [], terms_and_models.train_confidence

    def noted(*given, **named):
        call = inspect.signature(train).bind(*given, **named)
        call.apply_defaults()
        asked.append(call.arguments)
        return train(*given, iterations=1, depth=1)

    monkeypatch.setattr(terms_and_models, "train_confidence", noted)
    assert QUERIES["train_confidence"](spark, FOLDER).first().examples == 200
    assert [(call["iterations"], call["depth"]) for call in asked] == [(100, 6)]


def _placed(spark, classes):
    rows = spark.range(200).select(F.array(F.col("id") % 7 / 7, F.col("id") % 11 / 11).alias("_v"), (F.col("id") % classes).cast("double").alias("label_encoded"))
    return rows.select(array_to_vector("_v").alias("features"), "label_encoded")


def test_waves_are_not_kept(spark, monkeypatch):
    kept, persist = [], type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda frame, *level: kept.append(frame.columns) or persist(frame, *level))
    rows = _placed(spark, 3)
    scored = kernel_svm.KernelSVM(iterations=3, waves=16).fit(rows).transform(rows)
    assert scored.filter("prediction IN (0, 1, 2)").count() == 200
    # Spark's model marks what it scores as kept too, but lets go of it before anything is computed.
    assert kept[0] == ["features", "label_encoded", "held"]


def test_chances_are_made_once_a_round(spark, monkeypatch):
    calls, softmax = [], boosting.softmax
    monkeypatch.setattr(boosting, "softmax", lambda scores: calls.append(scores) or softmax(scores))
    boosting.SoftmaxBoosting(rounds=2, depth=1).fit(_placed(spark, 3))
    assert len(calls) == 3


def test_features_of_the_feedback_are_made_once(spark, monkeypatch):
    plans, append = [], tables_and_streams.tables.append_feedback
    monkeypatch.setattr(tables_and_streams.tables, "append_feedback", lambda log, path: plans.append(log._jdf.queryExecution().optimizedPlan().toString()) or append(log, path))
    tables_and_streams.feedback_file(spark, FOLDER)
    assert len(plans) == 3 and not any("regexp_count" in plan for plan in plans)


def test_files_grow_in_number(spark, monkeypatch):
    """Small limits cut the input into more files, and the results stay those of the twins."""
    monkeypatch.setattr(tables_and_streams, "FILE_BYTES", 1 << 15)
    monkeypatch.setattr(tables_and_streams, "FILE_ROWS", 100)
    paths, read = [], tables_and_streams.json_items
    monkeypatch.setattr(tables_and_streams, "json_items", lambda spark, path: paths.append(path) or read(spark, path))
    for name in ("split_json_files", "stream_route_mixed"):
        assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])[:2] == []
    assert len(paths) == 2 and all(len(glob.glob(f"{path.removeprefix('file:')}/*.txt")) > 2 for path in paths)
