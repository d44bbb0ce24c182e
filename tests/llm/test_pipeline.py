"""The pipeline stage by stage against plain loops."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docsluice.llm.common import kept
from tests.llm import awkward

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = lower(text).split()
    return {" ".join(words[n : n + 5]) for n in range(max(1, len(words) - 4))}


def similar(a, b):
    return len(a & b) / len(a | b) >= 0.8


def rows_of(docs):
    return [tuple(row) for row in docs.select(COLUMNS).collect()]


def check_stages(spark, docs):
    before, total = docs, rows_of(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = kept(stage(spark, before, FOLDER), f"test-{name}")
        assert after.columns == docs.columns
        rows, old = rows_of(after), rows_of(before)
        if name != "mix_sources":
            # A stage keeps rows as they are, none more often than it came.
            assert not Counter(rows) - Counter(old)
        if name == "language":
            # What has no letters goes; ordinary prose stays.
            assert all(any(c.isalpha() for c in row[1] or "") for row in rows)
            gone = Counter(old) - Counter(rows)
            assert not [row for row in gone if row[1] and len([w for w in row[1].split() if w.isalpha()]) > 5]
        if name == "exact_dedup":
            texts = Counter(lower(row[1]) for row in rows)
            assert set(texts) == {lower(row[1]) for row in old} and max(texts.values()) == 1
            for row in rows:
                ids = [other[0] for other in old if lower(other[1]) == lower(row[1]) and other[0] is not None]
                assert row[0] == max(ids, default=None)
        if name == "near_dedup":
            sets = [shingles(row[1]) for row in rows]
            missed = [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])]
            assert len(missed) <= 0.05 * len(rows)
            # Every dropped text has a like one, kept or dropped.
            olds = [shingles(row[1]) for row in old]
            for row in Counter(old) - Counter(rows):
                assert sum(similar(shingles(row[1]), other) for other in olds) > 1
        if name == "mix_sources":
            assert set(rows) <= set(old) and max(Counter(rows).values(), default=0) <= 3 * max(Counter(old).values(), default=0)
            words = lambda some: sum(len(lower(row[1]).split()) for row in some)
            assert abs(words(rows) - words(old)) <= 0.25 * words(old) + 20_000
        before = after
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(tokenizer.encode(row[1] or "", add_special_tokens=False).ids) + 1 for row in rows_of(before))
    pieces = STAGES["pack"](spark, before, FOLDER).collect()
    assert sum(piece["length"] for piece in pieces) == tokens
    return total


def test_stages_on_the_smallest_documents(spark):
    assert check_stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_stages_on_awkward_rows(spark):
    check_stages(spark, awkward.frame(spark))


def test_each_stage_on_no_rows(spark):
    nothing = awkward.frame(spark, []).select(COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0, name


def test_each_stage_on_rows_alike_in_every_column(spark):
    """Of rows that nothing tells apart one is left by the dedups, whatever their number."""
    same = (1, "these words stand here twice and are the same in both rows", "en", "s", 5)
    docs = spark.createDataFrame([same, same, (2, "another text of some more words than one", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert STAGES["language"](spark, docs, FOLDER).count() == 3
    for name in ("exact_dedup", "near_dedup"):
        assert sorted(row["doc_id"] for row in STAGES[name](spark, docs, FOLDER).collect()) == [1, 2], name


def test_run_equals_the_stages(spark):
    once = corpus_pipeline.run(spark, FOLDER)
    again = corpus_pipeline.run(spark, FOLDER)
    assert once.count() > 0 and sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
