"""Near duplicates with nothing left out, against a comparison of all pairs."""

from __future__ import annotations

import os

import numpy as np
import pytest

import corpus_pipeline
from docsluice.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[n : n + 5]) for n in range(max(1, len(words) - 4))}


def smallest_of_components(texts):
    sets, first = [shingles(text) for text in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if first[a] != first[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(first[a], first[b]), min(first[a], first[b])
                first = [new if x == old else x for x in first]
    return first


def short_texts():
    """Nine words and eight of them: a share of exactly 0.8."""
    draw = np.random.default_rng(11)
    for _ in range(60):
        words = [f"w{n}" for n in draw.integers(0, 5000, 9)]
        yield from (" ".join(words), " ".join(words[:-1]))


def changed_texts():
    """Long texts with a common beginning, one to eight words of which are changed: shares on both sides of 0.8."""
    draw = np.random.default_rng(12)
    opening = [f"o{n}" for n in range(60)]
    for size in (30, 100, 250) * 4:
        words = opening + [f"w{n}" for n in draw.integers(0, 5000, size)]
        for copy in range(6):
            text = list(words)
            for at in draw.integers(0, len(words), draw.integers(1, 9)):
                text[at] = f"new{copy}x{at}"
            yield " ".join(text)


@pytest.mark.parametrize("texts", [short_texts, changed_texts])
def test_no_similar_pair_is_left_out(spark, texts):
    rows = [*texts(), "", "one", "one two"]
    docs = spark.createDataFrame([(n, text, "en", "s", len(text)) for n, text in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    found = simhash.near_duplicates(docs, scheme=simhash.SIMILAR, complete=True).collect()
    assert [row["component_id"] for row in sorted(found, key=lambda row: row["doc_id"])] == smallest_of_components(rows)
    left = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted(row["doc_id"] for row in left) == sorted(set(smallest_of_components(rows)))


def test_heads_of_similar_sets_share_what_is_asked_for():
    draw, scheme = np.random.default_rng(13), simhash.SIMILAR
    for size in [*range(1, 40), *draw.integers(40, 2000, 200).tolist()]:
        both = draw.integers(0, 2**62, size)
        one = np.unique(np.concatenate([both, draw.integers(0, 2**62, draw.integers(0, size // 4 + 1))]))
        other = np.unique(np.concatenate([both, draw.integers(0, 2**62, size + size // 4 - len(one))])) if draw.random() < 0.7 else np.unique(both)
        assert len(np.intersect1d(one, other)) >= scheme.similarity * len(np.union1d(one, other)) - 1e-6
        met = np.intersect1d(*(x[: simhash._head(len(x), scheme)] for x in (one, other)))
        assert len(met) >= max(simhash._told(simhash._least(scheme.similarity * len(x)), scheme) for x in (one, other))


def with_passage():
    """Long texts that share one passage, a ninth of each, and nothing else."""
    draw = np.random.default_rng(14)
    passage = [f"p{n}" for n in range(70)]
    for text in range(20):
        yield " ".join([f"x{text}w{n}" for n in draw.integers(0, 10**6, 530)] + passage)


def test_only_shingles_that_are_needed_are_stored(spark, monkeypatch):
    stored, at_rarest = [], []

    def noting(df, name):
        table = kept(df, name)
        stored.append((name, table.columns, table.inputFiles(), table.count()))
        if name == "simhash-rarest":
            at_rarest.extend((n, columns, rows) for n, columns, files, rows in stored if all(os.path.exists(x.removeprefix("file:")) for x in files))
        return table

    kept = simhash.kept
    monkeypatch.setattr(simhash, "kept", noting)
    rows = [*changed_texts(), *with_passage()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    twice = docs.unionByName(docs)
    found = simhash.near_duplicates(twice, scheme=simhash.SIMILAR, complete=True).collect()
    assert [row["component_id"] for row in sorted(found, key=lambda row: row["doc_id"])] == [x for x in smallest_of_components(rows) for _ in range(2)]
    # What the heads were for and the sets of the first links are gone by then, and each set is there once.
    assert not [name for name, columns, _ in at_rarest if "head" in columns]
    assert [n for name, _, n in at_rarest if name == "simhash-shingles"] == [72 + 20]

    stored.clear(), at_rarest.clear()
    found = simhash.near_duplicates(docs, scheme=simhash.SIMILAR, complete=True).collect()
    assert [row["component_id"] for row in sorted(found, key=lambda row: row["doc_id"])] == smallest_of_components(rows)
    # A passage does not make texts similar; without copies no head of them is met often enough.
    assert [n for name, _, n in at_rarest if name == "simhash-shingles"] == [72]
