"""Decontamination against plain loops over windows, on awkward rows, short items and items of many blocks."""

from __future__ import annotations

import random
import re

import pytest

from docsluice.llm.decontaminate import Automaton, Limits, decontaminate
from tests.llm import awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, word string, _text string"


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text: str | None, items: list[tuple], window: int) -> tuple:
    own = words(text)
    hit, names = set(), set()
    for name, item in items:
        whole = words(item)
        n = min(window, len(whole))
        strings = {tuple(whole[i : i + n]) for i in range(len(whole) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in strings:
                hit.update(range(i, i + n))
                names.add(name)
    return len(own), len(hit), sorted(str(name) for name in names if name is not None)


def some_items(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    items = [(n, " ".join(draw.choice("abcd") for _ in range(draw.randint(0, 14)))) for n in range(25)]
    return [*items, (3, "a b c"), (None, "d d d d d"), (77, None), (78, ""), (79, "The CAT, sat!"), (79, "the cat sat"), (80, "日本語 É é x9")]


@pytest.mark.parametrize("window, block", [(4, 1 << 17), (4, 100), (10, 1 << 17), (1, 200)])
def test_equals_windows(spark, window, block):
    draw = random.Random(window)
    texts = [(n, " ".join(draw.choice("abcde") for _ in range(draw.randint(0, 60)))) for n in range(60)]
    texts += [(60, None), (None, "a b c d"), (61, "x The cat-sat. on"), (61, "x The cat-sat. on"), (62, "日本語 É é X9|日本語 é É x9"), (63, ""), (64, "a b c " * 5000)]
    items = some_items(window)
    docs = spark.createDataFrame([(k, t, "w", 5) for k, t in texts], "doc_id long, text string, words string, n_words int").repartition(3)
    found = decontaminate(docs, spark.createDataFrame([(*row, "x", "y") for row in items], ITEMS), limits=Limits(window, 0.5, block))
    got = sorted(((r["doc_id"], r["text"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=str)
    assert got == sorted(((k, t, *plain(t, items, window)) for k, t in texts), key=str)
    for row in found.collect():
        assert sum(s["last"] - s["first"] + 1 for s in row["spans"]) == row["n_hit"]
        assert row["verdict"] == ("keep" if not row["n_hit"] else "drop" if row["n_hit"] > 0.5 * row["n_words"] else "cut")
        data = (row["text"] or "").encode()
        rest, at = b"", 0
        for span in row["spans"]:
            assert words(data[span["from"] : span["to"]].decode()) == words(row["text"])[span["first"] : span["last"] + 1]
            rest, at = rest + data[at : span["from"]], span["to"]
        expected = {"keep": row["text"], "drop": None, "cut": (rest + data[at:]).decode()}
        assert row["kept_text"] == expected[row["verdict"]]


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward.frame(spark)
    items = spark.createDataFrame([(1, "THE cat sat on the mat", "", ""), (2, awkward.PASSAGE, "", "")], ITEMS)
    found = decontaminate(docs, items, texts=False)
    expected = sorted((str(r[0]), *plain(r[1], [(1, "the cat sat on the mat"), (2, awkward.PASSAGE)], 10)) for r in awkward.rows())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in found.collect()) == expected
    assert decontaminate(awkward.frame(spark, []), items).count() == 0
    clean = decontaminate(docs, items.filter("false")).collect()
    assert len(clean) == len(awkward.rows()) and {(r["n_hit"], r["verdict"]) for r in clean} == {(0, "keep")}


def test_longest_match_of_the_automaton():
    draw = random.Random(5)
    sequences = [(n, [draw.choice([b"a", b"b", b"c"]) for _ in range(30)]) for n in range(6)]
    automaton = Automaton.of(sequences, 3)
    strings = {tuple(w[i:j]) for _, w in sequences for i in range(30) for j in range(i, 31)}
    for _ in range(50):
        text = [draw.choice([b"a", b"b", b"c"]) for _ in range(40)]
        known = [automaton.words[w] for w in text]
        longest = max(j - i for i in range(40) for j in range(i, 41) if tuple(text[i:j]) in strings)
        assert automaton.walk(known, 0, set(), []) == longest
