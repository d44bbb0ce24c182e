"""Terms of large tables: few and small Python workers, the same sums and weights."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest

import __spark_entry__  # noqa: F401  registers the checks
from checks.registry import QUERIES
from docsluice.config import TermConfig
from docsluice.operators import terms

FOLDER = "/root/testdata/sf0.001"
CONFIG = TermConfig(min_df=1, max_df=1.0, stop_words=("the",))
TEXTS = [None, "", "a", "The cat, a CATÉ __ 42!", "cat cat cat", "cat cat the cat", "cat cat cat", "x\ty", "中文 Überü_1 𝐀𝐁", " ab  ab\nab ", "ab cat, ab"]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    # Keys that come twice or are null, and a text that comes twice under one key.
    keys = [None, 1, 1, 2, None, 3, 4, 4, 5, 6, 6]
    return spark.createDataFrame([*zip(keys, TEXTS), (4, "cat cat cat")], "doc_id long, content string").repartition(3)


def test_terms_are_summed_where_they_are_made(spark):
    """One Python worker per task counts the terms of texts; no list of them is moved, nor summed again before the shuffle."""
    rows = terms.with_terms(_docs(spark), "content", CONFIG)
    found, moved = terms.document_frequency(rows, CONFIG, "content"), terms.document_frequency(rows, CONFIG)
    plan = _plan(found)
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert plan.index("partial_sum") < plan.index("Exchange")  # a plan is printed from its end
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, moved.collect())) and found.count() > 12
    expected = {"cat": (14, 6), "cat cat": (8, 4), "ab": (5, 2), "ab ab": (2, 1), "cat ab": (1, 1), "42": (1, 1)}
    assert {row.term: (row.tf, row.df) for row in found.collect() if row.term in expected} == expected


def test_sums_of_texts_stay_small(monkeypatch):
    """What a task holds and hands on at a time is bounded, and adds up to all terms."""
    monkeypatch.setattr(terms, "HELD_BYTES", 2000)
    monkeypatch.setattr(terms, "COUNTED_BYTES", 300)
    monkeypatch.setattr(terms, "HANDED_ROWS", 50)
    texts = [" ".join(f"w{(row * 7 + place * place) % 90}" for place in range(10)) for row in range(200)] + ["", "x"]
    batches = [pa.RecordBatch.from_pydict({"text": texts[at : at + 40]}) for at in range(0, len(texts), 40)]
    found = list(terms._sum_texts(pa.array(["w3"]))(iter(batches)))
    assert max(batch.num_rows for batch in found) <= 50
    tf, df, sums = Counter(), Counter(), Counter()
    for text in texts:
        words = [word for word in text.split() if word not in ("w3", "x")]
        here = words + [" ".join(pair) for pair in zip(words, words[1:])]
        tf.update(here)
        df.update(set(here))
    rows = pa.Table.from_batches(found).to_pylist()
    for row in rows:
        sums.update({("tf", row["term"]): row["tf"], ("df", row["term"]): row["df"]})
    assert len(rows) > len(tf)
    assert sums == Counter({**{("tf", term): n for term, n in tf.items()}, **{("df", term): n for term, n in df.items()}})


@pytest.mark.parametrize("text", [None, "content"])
def test_batches_of_texts_are_small(spark, text):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, "64m")
    try:
        spark.conf.set(setting, "64m")
        terms.document_frequency(terms.with_terms(_docs(spark), "content", CONFIG), CONFIG, text)
        assert spark.conf.get(setting) == f"{4 << 20}b"
        spark.conf.set(setting, "1m")
        terms.with_terms(_docs(spark), "content", CONFIG)
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.set(setting, before)


def test_only_known_terms_reach_the_jvm(spark):
    """Made and chosen in one call; the weights stay as they are, null lists and terms too."""
    rows = terms.with_terms(_docs(spark), "content", CONFIG)
    vocabulary = terms.fit_vocabulary(rows, TermConfig(max_features=5, min_df=2, stop_words=("the",)), "content")
    known = terms.known_terms(rows, vocabulary)
    assert "known_of(terms_of(" in _plan(known)
    assert {term for row in known.collect() for term in row.terms} == {"cat", "cat cat", "ab"}
    pipeline = terms.term_pipeline(vocabulary)
    before, after = (sorted((str(row.doc_id), str(row.content), str(row.term_vector)) for row in pipeline.transform(frame).collect()) for frame in (rows, known))
    assert before == after
    odd = spark.createDataFrame([(None,), ([],), (["cat", None, "dog", "cat"],)], "terms array<string>")
    assert sorted(map(str, (row.terms for row in terms.known_terms(odd, vocabulary).collect()))) == ["None", "['cat', 'cat']", "[]"]


@pytest.mark.parametrize("name", ["document_frequency", "tfidf_vocabulary", "tfidf_idf", "tfidf", "naive_bayes", "naive_bayes_blocks"])
def test_queries_move_no_lists_of_all_terms(spark, monkeypatch, name):
    """Every query that needs the vocabulary sums the terms of the texts, and vectors are made from the terms of the vocabulary."""
    plans, frequency, pipeline = [], terms.document_frequency, terms.term_pipeline
    monkeypatch.setattr(terms, "document_frequency", lambda *given: plans.append(_plan(found := frequency(*given))) or found)

    def watched(*given):
        stages = pipeline(*given)
        transform = stages.transform
        stages.transform = lambda rows: plans.append(_plan(rows.select("terms"))) or transform(rows)
        return stages

    monkeypatch.setattr(terms, "term_pipeline", watched)
    assert QUERIES[name](spark, FOLDER).count() > 0
    assert "ArrowEvalPython" not in plans[0] and "MapInArrow" in plans[0]
    assert len(plans) == (2 if name in ("tfidf", "naive_bayes", "naive_bayes_blocks") else 1)
    assert all("known_of(terms_of(" in plan for plan in plans[1:])
