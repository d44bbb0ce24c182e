"""The trie of prefixes against plain loops: small blocks, crowded nodes, copies over many ranges, awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from docsluice.llm import prefix_trie
from docsluice.llm.prefix_trie import Blocks, ordered_turns, with_borrowed_heads
from docsluice.llm.prefix_trie import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, key long, place int, id string, depth int"


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple]]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, digest(role or "", text or ""), role or "", text or ""))
    turns = {conv: [t[3:] for t in sorted(said, key=lambda t: (t[0], t[1] or 0, t[2]))] for conv, said in own.items()}
    out = {}
    for conv, said in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20 if conv >= 0 else -(abs(conv) % 20))
        out[conv] = turns.get(base, [])[:h] + said[h:]
    return out


def plain(convs: dict[int, list[tuple]]) -> list[tuple]:
    members = defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, own in members.items():
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(own) - 1) * words
    rows = []
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        rows.append((min(own), len(path), parent, len(own), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def found(nodes) -> list[tuple]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(row) for row in nodes.select(*names).collect()), key=str)


def some(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for conv in range(90):
        length = draw.choice([1, 2, 3, 4, 9])
        rows += [(conv * draw.choice([1, 1, 30]), turn, draw.choice("ua"), draw.choice(["x", "x y", "z"])) for turn in range(length)]
    long = [("u", f"turn {n % 3} of a long one") for n in range(25)]
    for conv in (5_000, 6_000, 7_000, 8_001, 8_002):
        rows += [(conv, turn, role, text) for turn, (role, text) in enumerate(long[: 25 if conv < 8_000 else 17])]
    awkward = [(None, 1, "u", "x"), (300, None, None, None), (300, None, "u", "x"), (300, 1, None, "x"), (301, 1, "u", "x"), (301, 1, "u", "x")]
    return [*rows, *awkward, (-7, 0, "a", ""), (302, 0, "u", "日本 \t é"), (303, 4, "", "w " * 30_000)]


@pytest.mark.parametrize("blocks, crowd", [(Blocks(8, 32), 1_000), (Blocks(2, 3), 3)])
def test_equals_plain_loops(spark, monkeypatch, blocks, crowd):
    monkeypatch.setattr(prefix_trie, "CROWD", crowd)
    rows = some(3)
    table = spark.createDataFrame([(*row, 1, 2, "i", 3) for row in rows], SCHEMA).repartition(3)
    turns, convs = with_borrowed_heads(ordered_turns(table))
    assert found(trie(turns, convs, blocks)) == plain(rebuilt(rows))


def test_empty_table_and_conversations_without_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    turns, convs = with_borrowed_heads(ordered_turns(empty))
    assert trie(turns, convs).count() == 0
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    table = spark.createDataFrame([(lost, n, "u", f"t{n}", 1, 2, "i", 3) for n in range(2)], SCHEMA)
    turns, convs = with_borrowed_heads(ordered_turns(table))
    only = hashlib.sha256(str(lost).encode()).hexdigest()
    assert found(trie(turns, convs)) == [(lost, 0, None, 1, 0, 1, 0, only)]
