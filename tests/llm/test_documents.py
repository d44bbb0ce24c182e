"""Operators over documents against plain loops, on awkward rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsluice.llm import lm, simhash
from docsluice.llm.exact_dedup import exact_dedup
from docsluice.llm.mixing import Mix, min_cost_flow, mix_sources, targets
from docsluice.llm.packing import STORED, PackConfig, Schedule, _run, pack
from docsluice.llm.suffix_dedup import remove_repeats
from docsluice.llm.tokens import WordEncoder
from tests.llm import awkward

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def both(spark):
    return [awkward.frame(spark), small(spark)]


def texts(docs) -> list[tuple]:
    return [(row["doc_id"], (row["text"] or "").encode()) for row in docs.select("doc_id", "text").collect()]


def lower(text: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, keep):
    for docs in both(spark):
        groups = defaultdict(list)
        for key, text in texts(docs):
            groups[hashlib.sha256(lower(text)).hexdigest()].append(key)
        found = exact_dedup(docs, keep=keep, runs=20).collect()
        assert len(found) == sum(map(len, groups.values()))
        for row in found:
            keys = [key for key in groups[row["text_sha256"]] if key is not None]
            best = (max if keep == "largest" else min)(keys) if keys else None
            assert (row["keep_id"], row["group_size"]) == (best, len(groups[row["text_sha256"]]))
            assert not row["kept"] or row["doc_id"] == best
        assert sum(row["kept"] for row in found) == len(groups)
    assert exact_dedup(awkward.frame(spark, [])).count() == 0


def plain_fingerprint(text: bytes, width: int = 3) -> int:
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [b" ".join(words[n : n + width]) for n in range(max(1, len(words) - width + 1))]
    counts = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def plain_components(prints: list[int], reach: int) -> list[int]:
    """Place of the first of each component."""
    first = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= reach and first[a] != first[b]:
                old, new = max(first[a], first[b]), min(first[a], first[b])
                first = [new if x == old else x for x in first]
    return first


def test_simhash(spark):
    for docs in both(spark):
        rows = texts(docs)
        prints = [plain_fingerprint(text) for _, text in rows]
        first = plain_components(prints, 3)
        smallest = {}
        for (key, _), root in zip(rows, first):
            if key is not None:
                smallest[root] = min(key, smallest.get(root, key))
        want = sorted((str(k), f"{p:016x}", str(smallest.get(r))) for (k, _), p, r in zip(rows, prints, first))
        found = simhash.near_duplicates(docs).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == want
    assert simhash.near_duplicates(awkward.frame(spark, [])).count() == 0


@pytest.mark.parametrize("crowded", [2048, 3])
def test_links_of_close_fingerprints(spark, crowded):
    """Dense clusters, with and without crowded entries, connect exactly what a comparison of all pairs connects."""
    draw = np.random.default_rng(5)
    prints = set()
    for _ in range(12):
        center = int(draw.integers(0, 2**63))
        for _ in range(40):
            flips = draw.integers(0, 64, draw.integers(0, 6))
            value = center
            for bit in flips.tolist():
                value ^= 1 << bit
            prints.add(value)
    prints = sorted(prints)
    frame = spark.createDataFrame([(value.to_bytes(8, "big"),) for value in prints], "fp binary")
    pairs = simhash.links(frame, replace(simhash.CLOSE, crowded=crowded)).collect()
    place = {value: n for n, value in enumerate(prints)}
    first = list(range(len(prints)))
    for pair in pairs:
        a, b = (first[place[int.from_bytes(side, "big")]] for side in pair)
        first = [min(a, b) if x == max(a, b) else x for x in first]
    assert first == plain_components(prints, 3)


def test_similar_texts(spark):
    """Near copies meet under the long fingerprints, other texts do not."""
    draw = np.random.default_rng(3)
    rows = []
    for group in range(20):
        words = [f"w{n}" for n in draw.integers(0, 5000, 400)]
        for copy in range(3):
            changed = list(words)
            for at in draw.integers(0, 400, 4):
                changed[at] = f"new{group}{copy}{at}"
            rows.append((group * 3 + copy, " ".join(changed), None, None, 0, 0, "", "", "", 0, 0))
    found = simhash.near_duplicates(awkward.frame(spark, rows), scheme=simhash.SIMILAR).collect()
    assert {row["doc_id"]: row["component_id"] for row in found} == {n: n // 3 * 3 for n in range(60)}


# 16 segments of 8 bits, so that a few dozen texts fill large entries.
FEW_BITS = replace(simhash.SIMILAR, words=2, reach=30, segment=8, finer=8)


def family(seed: int, copies: int) -> list[bytes]:
    """Texts around one text, with two to seven words changed, so that about half of the pairs share four fifths."""
    draw = np.random.default_rng(seed)
    words = [f"w{n}" for n in draw.integers(0, 5000, 300)]
    found = []
    for copy in range(copies):
        changed = list(words)
        for at in draw.integers(0, 300, draw.integers(2, 8)):
            changed[at] = f"new{copy}x{at}"
        found.append(" ".join(changed).encode())
    return found


def similar_components(rows: list[bytes], scheme: simhash.Scheme) -> list[int]:
    """Place of the first of each component: texts that agree in a segment, lie within reach and share enough shingles."""
    prints = [np.frombuffer(simhash.fingerprint(text, scheme), np.uint8) for text in rows]
    sets = [set(simhash._shingle_hashes(text, scheme.width).tolist()) for text in rows]
    first, width = list(range(len(rows))), scheme.segment // 8
    for a in range(len(rows)):
        for b in range(a):
            agree = (prints[a] == prints[b]).reshape(-1, width).all(axis=1).any()
            if agree and np.bitwise_count(prints[a] ^ prints[b]).sum() <= scheme.reach and first[a] != first[b]:
                if len(sets[a] & sets[b]) >= scheme.similarity * len(sets[a] | sets[b]):
                    old, new = max(first[a], first[b]), min(first[a], first[b])
                    first = [new if x == old else x for x in first]
    return first


@pytest.mark.parametrize("matrix", [1024, 8])
def test_similar_texts_whose_trees_fail(spark, monkeypatch, matrix):
    """A link of a tree that fails takes no other link away, neither in trees from distances nor in growing fronts."""
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    rows = [text for seed in range(4) for text in family(seed, 60)]
    docs = spark.createDataFrame(list(enumerate(map(bytes.decode, rows))), "doc_id long, text string")
    found = {row["doc_id"]: row["component_id"] for row in simhash.near_duplicates(docs, scheme=FEW_BITS).collect()}
    assert [found[n] for n in range(len(rows))] == similar_components(rows, FEW_BITS)


@pytest.mark.parametrize("crowded", [4, 15])
def test_similar_texts_in_crowded_entries(spark, crowded):
    """What one segment brings together needs no second one, however many others it brings."""
    rows = [text for seed in range(4, 7) for text in family(seed, 40)]
    docs = spark.createDataFrame(list(enumerate(map(bytes.decode, rows))), "doc_id long, text string")
    scheme = replace(FEW_BITS, segment=16, finer=16, reach=40, crowded=crowded)
    found = {row["doc_id"]: row["component_id"] for row in simhash.near_duplicates(docs, scheme=scheme).collect()}
    assert [found[n] for n in range(len(rows))] == similar_components(rows, scheme)


def test_word_encoder_equals_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tokenizer = WordEncoder(path), Tokenizer.from_file(path)
    some = [text or "" for _, text, *_ in awkward.rows()]
    some += ["it's don't <|endoftext|> a\x1cb a\xa0b İstanbul ǅ SE!! x.y,z 12ab é́ \x00", "a" * 3000, "Straße,ÀÉ;"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode([text.encode() for text in some])]
    assert got == [tokenizer.encode(text, add_special_tokens=False).ids for text in some]


@pytest.mark.parametrize("config", [PackConfig(), PackConfig(window=8192, length=512, queues=2, weights={"s1": 3.0, "s2": 1.0, "src1": 9.0})])
def test_pack(spark, config):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in both(spark):
        whole = Counter()
        for key, text in texts(docs):
            ids = tokenizer.encode(text.decode(), add_special_tokens=False).ids + [1]
            whole[key, np.array(ids, "<u4").tobytes()] += 1
        pieces = pack(docs, config=config).collect()
        # Pieces of rows with one key cannot be told apart by the key alone: every start and end must be used as often.
        starts, ends, total = Counter(), Counter(), Counter()
        for piece in pieces:
            assert piece["length"] == len(piece["ids"]) // 4 > 0
            fits = [ids for (key, ids) in whole if key == piece["doc_id"] and len(ids) == piece["doc_tokens"] * 4]
            assert any(ids[piece["start"] * 4 :].startswith(piece["ids"]) for ids in fits)
            group = piece["doc_id"], piece["doc_tokens"]
            starts[(*group, piece["start"])] += 1
            ends[(*group, piece["start"] + piece["length"])] += 1
            total[group] += piece["length"]
        for (key, ids), n in whole.items():
            size = len(ids) // 4
            same = sum(m for (other, x), m in whole.items() if other == key and len(x) == len(ids))
            assert total[key, size] == size * same and starts[key, size, 0] == same == ends[key, size, size]
        by_sequence = defaultdict(list)
        for piece in pieces:
            by_sequence[piece["sequence_id"]].append((piece["offset"], piece["length"]))
        sizes = []
        for number in range(len(by_sequence)):
            at = 0
            for offset, length in sorted(by_sequence[number]):
                assert offset == at
                at += length
            sizes.append(at)
        tokens = sum(sizes)
        assert sizes[: tokens // config.length] == [config.length] * (tokens // config.length)
        assert all(size & (size - 1) == 0 for size in sizes)
    assert pack(awkward.frame(spark, []), config=config).count() == 0


def test_pack_keeps_the_mixture(spark):
    pieces = pack(small(spark)).collect()
    tokens, by_sequence = Counter(), defaultdict(Counter)
    for piece in pieces:
        tokens[piece["source"]] += piece["length"]
        by_sequence[piece["sequence_id"]][piece["source"]] += piece["length"]
    total = sum(tokens.values())
    for held in by_sequence.values():
        if sum(held.values()) == 2048:
            assert all(abs(held[source] - 2048 * n / total) <= len(tokens) + 2 for source, n in tokens.items())


def test_schedule_of_a_rare_source():
    """A source of a few tokens in a large corpus looks at its own windows, not at all; places are the same either way."""
    most = 0

    class Watched(Schedule):
        def granted(self, windows):
            nonlocal most
            most = max(most, len(windows))
            return super().granted(windows)

    for totals, weights, window in (
        ([700_000, 3, 1_000, 299_000], None, 16),
        ([5_000, 40_000, 7, 900], [3.0, 1.0, 0.5, 9.0], 64),
        ([1, 1, 1], None, 2048),
    ):
        schedule = Watched(totals, weights or [n / sum(totals) for n in totals], window, 16)
        every = Schedule.granted(schedule, np.arange(schedule.windows + 1))
        order = [[] for _ in totals]
        at = 0
        for grants in np.diff(every, axis=0).tolist():
            for queue, n in enumerate(grants):
                order[queue] += range(at, at + n)
                at += n
        for queue, total in enumerate(totals):
            for first, last in {(0, total), (total // 3, total), (total // 2, total // 2 + 1)}:
                n = np.array([1, last - first - 1][: last - first])
                starts = first + np.cumsum(n) - n
                ids = pa.array([np.zeros(x, STORED).tobytes() for x in n.tolist()], pa.binary())
                rows = pa.RecordBatch.from_pydict({"id": pa.array(starts), "source": pa.array(["s"] * len(n)), "ids": ids})
                most = 0
                found = _run(schedule, rows, queue, starts, n).to_pydict()
                got = []
                for row, start, held, sequence, offset in zip(*(found[name] for name in ("id", "start", "ids", "sequence_id", "offset"))):
                    size = len(held) // 4
                    late = sequence - schedule.full
                    place = (schedule.tail[late] if late >= 0 else sequence * 16) + offset
                    got += [(row + start + x, place + x) for x in range(size)]
                assert got == list(zip(range(first, last), order[queue][first:last]))
                assert most <= 2 * (last - first)


@pytest.mark.parametrize("weights", [None, {"h0": 1.0, "h1": 3.0}])
def test_pack_mixes_sources_that_share_a_queue(spark, weights):
    """Every part of the result has all sources in proportion, however few queues there are."""
    rows = [(n, "word " * 149, None, f"h{n % 40}", 0, 0, "", "", "", 0, 0) for n in range(400)]
    pieces = pack(awkward.frame(spark, rows), config=PackConfig(queues=4, weights=weights)).collect()
    total = sum(piece["length"] for piece in pieces)
    held = defaultdict(Counter)
    for piece in pieces:
        held[piece["sequence_id"]][piece["source"]] += piece["length"]
    shares = {f"h{n}": 3 / 42 if weights and n == 1 else 1 / (42 if weights else 40) for n in range(40)}
    for number in range(total // 2048 // 3):
        assert all(abs(held[number][source] - 2048 * share) <= 8 for source, share in shares.items())


def plain_repeats(rows: list[tuple], length: int = 200) -> list[tuple]:
    count = Counter(text[n : n + length] for _, text in rows for n in range(len(text) - length + 1))
    found = []
    for key, text in rows:
        gone = [False] * len(text)
        for n in range(len(text) - length + 1):
            if count[text[n : n + length]] > 1:
                gone[n : n + length] = [True] * length
        spans = sum(now and not before for now, before in zip(gone, [False, *gone]))
        kept = bytes(byte for byte, out in zip(text, gone) if not out)
        found.append((str(key), len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found)


@pytest.mark.parametrize("crowded", [32_768, 1])
def test_remove_repeats(spark, crowded):
    for docs in (awkward.frame(spark).filter("text IS NULL OR length(text) < 10000"), small(spark)):
        rows = texts(docs)
        found = remove_repeats(docs, crowded=crowded).collect()
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
        assert got == plain_repeats(rows)
        assert all(r["n_removed"] == sum(s["to"] - s["from"] for s in r["spans"]) for r in found)
    assert remove_repeats(awkward.frame(spark, []), crowded=crowded).count() == 0


def test_remove_repeats_in_a_very_long_text(spark):
    found = {r["doc_id"]: r for r in remove_repeats(awkward.frame(spark)).filter("doc_id IN (6, 7)").collect()}
    # The words come round every 977, so every byte lies in a string that starts elsewhere.
    assert found[6]["n_removed"] == found[6]["n_bytes"] == found[7]["n_removed"]


@pytest.mark.parametrize("remembered", [200_000, 40])
def test_lm_scores(spark, remembered):
    config = lm.LmConfig(remembered=remembered, classes=32, rounds=1)
    for docs in both(spark):
        rows = [(key, [*WORD.findall(lower(text)), b"\n"]) for key, text in texts(docs)]
        out = [key is not None and zlib.crc32(str(key).encode()) % 7 == 2 for key, _ in rows]
        count = Counter(word for (_, words), held in zip(rows, out) if not held for word in words)
        tokens, distinct = sum(count.values()), len(count)
        want = sorted(
            (str(key), held, len(words), sum(count[w] > 0 for w in words), tokens,
             round(sum(math.log10((count[w] + 1) / (tokens + distinct + 1)) for w in words), 3))
            for (key, words), held in zip(rows, out)
        )
        found = lm.score_texts(docs, config=config).collect()
        got = sorted(
            (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3))
            for r in found
        )
        assert got == want
        assert all(r["score"] < 0 for r in found)
    assert lm.score_texts(awkward.frame(spark, []), config=config).count() == 0


def test_lm_normalises_and_beats_counts_on_held_out_texts(spark):
    docs, config = small(spark), lm.LmConfig(classes=64)
    rows = docs.select(F.col("doc_id").alias("id"), lm.held_out(F.col("doc_id")).alias("out"), F.col("text").cast("binary").alias("text"))
    corpus = lm.count_words(rows.filter("NOT out"), config)
    model = lm.train(rows.filter("NOT out"), corpus, config)
    near, far = model.vectors @ model.turns[0], model.vectors @ model.turns[1]
    for before, earlier in ((0, 1), (64, 64), (5, 63)):
        logits = (near[before] + far[earlier]) @ model.targets.T + model.bias - model.normaliser[earlier, before]
        assert abs(np.exp(logits).sum() - 1) < 1e-3
    scored = lm.score_texts(docs, config=config).filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert scored[0] > scored[1]


def test_targets():
    assert targets([10, 10, 10], Mix(weights=(1.0,))) == [10.0, 10.0, 10.0]
    # The first may take 3 at most; what is left goes to the others by weight.
    assert targets([1, 50, 49], Mix(weights=(98.0, 1.0, 1.0))) == [3.0, 48.5, 48.5]
    assert targets([], Mix()) == [] and targets([0, 0], Mix()) == [0.0, 0.0]
    sizes = [5, 0, 700, 20, 3, 90]
    found = targets(sizes, Mix())
    assert math.isclose(sum(found), sum(sizes)) and all(x <= 3 * size for x, size in zip(found, sizes))


def test_flow_moves_words_between_overlapping_sources():
    # Source 1 can only be filled from the shared pattern, so source 0 must take its own words first.
    assert min_cost_flow([((0, 1), 10), ((0,), 10)], [10, 10], 3) == [10, 10]
    # Nothing is repeated while first passes suffice; then all patterns of a source are.
    assert min_cost_flow([((0,), 10), ((0,), 10)], [25], 3) == [15, 10]
    assert min_cost_flow([((0,), 4)], [100], 3) == [12]


def test_mix_sources(spark):
    for docs in both(spark):
        chosen, sources = mix_sources(docs, F.array("source"))
        again, _ = mix_sources(docs, F.array("source"))
        rows = chosen.collect()
        assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
        assert len(rows) == docs.count()
        taken, largest = Counter(), Counter()
        for row in rows:
            own = row["pattern"][0]["name"] if not row["pattern"][0]["none"] else None
            assert row["taken"] % max(row["size"], 1) == 0 and row["taken"] <= 3 * row["size"]
            taken[own] += row["taken"]
            largest[own] = max(largest[own], row["size"])
        for row in sources.collect():
            assert abs(taken[row["source"]] - row["target"]) <= largest[row["source"]] / 2 + 1
    assert mix_sources(awkward.frame(spark, []), F.array("source"))[0].count() == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(n, "w " * 10, None, s, 0, 0, "", "", "", 0, 0) for n, s in enumerate(["a", "a,b", "b", "a,b", "c", "a"] * 20)]
    chosen, sources = mix_sources(awkward.frame(spark, rows), F.split("source", ","), mix=Mix(weights=(1.0, 1.0, 2.0)))
    quotas = {row["source"]: row["target"] for row in sources.collect()}
    assert quotas == {"a": 300.0, "b": 300.0, "c": 600.0}
    assert chosen.agg(F.sum("taken")).head()[0] == 1200
    assert chosen.filter("size(pattern) = 1 AND pattern[0].name = 'c'").agg(F.min("taken"), F.max("taken")).head() == (30, 30)
