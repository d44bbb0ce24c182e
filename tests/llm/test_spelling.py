"""Spelling variants against plain loops: gram bounds, all near words whatever the dictionary, awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from docsluice.llm.spelling import Cutter, Grams, gram_dictionary, near_words, spelling_groups, word_counts
from tests.llm import awkward


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def some_words(seed: int, n: int = 400) -> list[str]:
    draw = random.Random(seed)
    parts = ["th", "er", "on", "é", "aa", "a", "ing", "st"]
    words = {"".join(draw.choice(parts) for _ in range(draw.randint(2, 5))) for _ in range(n)}
    return sorted(word for word in words if len(word) >= 5) + ["aaaaa", "aaaaaa", "aaaaaaa", "ÿéÿéÿ", "ÿéÿéé"]


DICTIONARIES = [Grams(long=0, rare=1), Grams(long=3, rare=2, most=6), Grams(long=10**9), Grams(long=5, rare=3, crowd=2), Grams(least=3, most=5, long=4, rare=1)]


@pytest.mark.parametrize("grams", DICTIONARIES)
def test_finds_all_near_words(spark, grams):
    words = sorted(set(some_words(2)))
    draw = random.Random(9)
    counts = {word: draw.randint(3, 40) for word in words}
    table = spark.createDataFrame([(w, n, "k") for w, n in counts.items()], "word string, n long, key string").repartition(3)
    expected = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    found = near_words(table, grams).collect()
    assert len(found) == len(expected) and {(r["word"], r["other"]) for r in found} == expected
    assert all(r["n"] == counts[r["word"]] and r["other_n"] == counts[r["other"]] for r in found)
    groups = {r["word"]: r for r in spelling_groups(table, grams=grams).collect()}
    assert groups.keys() == counts.keys()
    forms = {}
    for word in words:
        own = [b if a == word else a for a, b in expected if word in (a, b)]
        best = min(own, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best and counts[best] >= 2 * counts[word] else None
        assert (groups[word]["n_near"], groups[word]["form"], groups[word]["form_n"]) == (len(own), forms[word], counts.get(forms[word]))
    for word in words:
        root = word
        while forms[root]:
            root = forms[root]
        assert groups[word]["root"] == root


@pytest.mark.parametrize("grams", DICTIONARIES)
def test_edits_leave_the_untouched_grams(spark, grams):
    words = some_words(4)
    cutter = Cutter(gram_dictionary(spark.createDataFrame([(w,) for w in set(words)], "word string"), grams), grams)
    draw = random.Random(1)
    for word in words:
        marked = f"^{word}$"
        left, right = cutter.untouched(marked)
        for _ in range(10):
            l = draw.randint(1, len(marked) - 1)
            r = min(len(marked) - 1, l + draw.randint(0, 1))
            other = marked[:l] + draw.choice(["", "t", "é", "a"]) + marked[r:]
            outside = [(p, g) for p, g in cutter.grams(marked) if p + len(g) <= left[l]]
            assert [(p, g) for p, g in cutter.grams(other) if p + len(g) <= left[l]] == outside
            shift = len(other) - len(marked)
            behind = [(p, g) for p, g in cutter.grams(marked) if p >= right[r]]
            assert [(p - shift, g) for p, g in cutter.grams(other) if p - shift >= right[r]] == behind


def test_counts_of_awkward_rows(spark):
    expected: Counter[str] = Counter()
    for key, text, *_ in awkward.rows():
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 5 == 0 else run] += 1
    del expected[""]
    assert {r["word"]: r["n"] for r in word_counts(awkward.frame(spark), damaged=5).collect()} == expected
    assert spelling_groups(word_counts(awkward.frame(spark, []))).count() == 0
    alone = spelling_groups(spark.createDataFrame([("lonely", 5), (None, 4), ("short", None), ("rare", 9)], "word string, n long")).collect()
    assert [tuple(row) for row in alone] == [("lonely", None, "lonely", 5, 0, None)]
