"""Benchmark decontamination by generalised suffix automata of the test items.

Words are maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased.
The items are dealt into blocks of bounded size, long ones in pieces that overlap by one
word less than a window. A task builds the automaton of a block: its states are the
classes of word strings that end at the same places of the items, so one walk over a
text gives at every word the longest string up to it that stands in an item. A match of
`window` words or more hits the last `window` of them; an item of fewer words is a
window by itself and is met on the way up the suffix links.

Texts are streamed once per block, each by the task that reads it. Only runs of words
whose neighbours follow each other somewhere in the items can carry a match; a sorted
array of these pairs selects the runs that are long enough, the automaton walks those.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import as_bytes, kept, slices

# Word characters to themselves, A-Z to lower case, all others to blanks.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
END = b"|"
SPANS = "array<struct<first:int,last:int,from:int,to:int>>"
FOUND = f"longest int, spans {SPANS}, items array<string>"
FOUND_ARROW = [
    pa.field("longest", pa.int32()),
    pa.field("spans", pa.list_(pa.struct([(name, pa.int32()) for name in ("first", "last", "from", "to")]))),
    pa.field("items", pa.list_(pa.string())),
]


@dataclass(frozen=True)
class Limits:
    """`window` words in a row that also stand in an item are cut; texts of which more
    than the share `cover` is hit are dropped; `block` words of items make an automaton."""

    window: int = 10
    cover: float = 0.5
    block: int = 1 << 17


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", limits: Limits = Limits(), texts: bool = True
) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, longest, n_items, items, spans, verdict and, if `texts`, text and kept_text.

    `spans` are the maximal runs of hit words as places of words (first, last) and of
    bytes (from, to); `items` are the ids, as sorted strings, of the items with a window
    in the text; `longest` is the longest match in words, 0 if it is shorter than every
    window. The verdict is keep, cut or drop; `kept_text` is the text without its spans,
    null if dropped. Null and empty texts have no words and are kept. Repeated rows and
    keys are judged one by one, by their texts alone; items that share an id count once,
    those without an id hit words but are not listed, those without words match nothing.
    No items: nothing is hit. An empty table of docs gives no rows.
    """
    carried = [F.col(text).alias("_text")] if texts else []
    source = docs.select(F.col(key).alias("_key"), *carried, as_bytes(text).alias("_bytes"))
    blocks = automata(items.select(F.col(item).cast("string").alias("item"), as_bytes(text).alias("text")), limits)
    numbers = [row["block"] for row in blocks.select("block").collect()]
    if len(numbers) <= 1:
        found = source.mapInArrow(_scan(_shared(blocks, numbers), limits.window), f"{_schema(source)}, n_words int, {FOUND}")
    else:
        # A text is looked at once per block; what is found meets by its digest, copies once.
        told = source.withColumn("_sha", F.unhex(F.sha2("_bytes", 256)))
        hits = None
        for number in numbers:
            one = _shared(blocks.filter(F.col("block") == number), [number])
            part = told.select("_sha", "_bytes").mapInArrow(_scan(one, limits.window, hits_only=True), f"_sha binary, n_words int, {FOUND}")
            part = kept(part.dropDuplicates(["_sha"]).drop("n_words"), "leaks-block")
            hits = part if hits is None else hits.unionByName(part)
        merged = hits.groupBy("_sha").agg(
            F.max("longest").alias("longest"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        merged = kept(merged.mapInArrow(_merge, f"_sha binary, {FOUND}"), "leaks-found")
        counted = told.mapInArrow(_scan(None, limits.window), f"{_schema(told)}, n_words int, {FOUND}").drop("longest", "spans", "items")
        found = counted.join(merged, "_sha", "left")
    hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda total, span: total + span["last"] - span["first"] + 1), F.lit(0))
    nothing = F.array().cast("array<string>")
    judged = found.select(
        F.col("_key").alias(key),
        *([F.col("_text").alias(text)] if texts else []),
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.coalesce("longest", F.lit(0)).alias("longest"),
        F.coalesce("items", nothing).alias("items"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
    )
    verdict = F.when(F.col("n_hit") == 0, "keep").when(F.col("n_hit") > limits.cover * F.col("n_words"), "drop").otherwise("cut")
    judged = judged.withColumn("n_items", F.size("items").cast("long")).withColumn("verdict", verdict)
    return judged.withColumn("kept_text", _without(text)) if texts else judged


def _without(text: str) -> Column:
    """The text without its spans: the pieces between them, in order."""
    data = F.col(text).cast("binary")
    ends = F.concat(F.transform("spans", lambda span: span["from"]), F.array(F.length(data)))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda span: span["to"]))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(data, x["a"] + 1, x["b"] - x["a"]).cast("string"))
    cut = F.when(F.col("verdict") == "cut", F.array_join(pieces, ""))
    return F.when(F.col("verdict") == "keep", F.col(text)).otherwise(cut)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.drop("_bytes").dtypes)


def _shared(blocks: DataFrame, numbers: list) -> Broadcast | None:
    """The automaton of one block, of bounded size, for all tasks."""
    if not numbers:
        return None
    return blocks.sparkSession.sparkContext.broadcast(blocks.select("automaton").head()[0])


def automata(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A table (block, automaton) over items (item, text as bytes); no automaton holds more than `block` words and one piece."""
    # A word takes two bytes or more; items of a partition are cut into blocks by their words.
    size = items.agg(F.sum(F.length("text"))).head()[0] or 0
    parts = max(1, -(-size // (8 * limits.block)))
    built = items.repartition(parts).mapInArrow(_blocks(limits), "automaton binary")
    return kept(built.withColumn("block", F.monotonically_increasing_id()), "leaks-automata")


def _blocks(limits: Limits):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = text.translate(LOWER).split()
                step = max(1, limits.block // 2)
                for first in range(0, max(1, len(words) - limits.window + 1), step):
                    # The windows that begin in a step lie in its piece.
                    piece = words[first : first + step + limits.window - 1]
                    waiting.append((name, piece))
                    size += len(piece)
                    if size >= limits.block // 2:
                        yield pa.RecordBatch.from_pydict({"automaton": [Automaton.of(waiting, limits.window).packed()]})
                        waiting, size = [], 0
        if size:
            yield pa.RecordBatch.from_pydict({"automaton": [Automaton.of(waiting, limits.window).packed()]})

    return build


class Automaton:
    """Suffix automaton of several word sequences, as arrays by state; state 0 is the empty string."""

    def __init__(self, parts: dict) -> None:
        self.__dict__.update(parts)

    def packed(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def of(cls, sequences: list[tuple[str | None, list[bytes]]], window: int) -> Automaton:
        self = cls({"window": window})
        self.words: dict[bytes, int] = {END: -1}
        numbered = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in sequences if words]
        self.factor = len(self.words)
        self.least = min([window, *(len(words) for _, words in numbered)])
        pairs = {a * self.factor + b for _, words in numbered for a, b in zip(words, words[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        lengths, links, steps = [0], [-1], [{}]
        ends = [cls._insert(words, lengths, links, steps) for _, words in numbered]
        self.lengths, self.links = array("i", lengths), array("i", links)
        self.steps = {state * self.factor + c: to for state, own in enumerate(steps) for c, to in own.items()}
        # `whole`: the state of the last `window` words of a match; `short`: the next state up the links in which an item of fewer words ends.
        whole, short = array("i", [0]) * len(lengths), array("i", [0]) * len(lengths)
        self.endings: dict[int, list[tuple[int, str | None]]] = {}
        for (name, words), state in zip(numbered, ends):
            if len(words) < window:
                self.endings.setdefault(state, []).append((len(words), name))
        for state in sorted(range(1, len(lengths)), key=lengths.__getitem__):
            link = links[state]
            whole[state] = state if lengths[link] < window else whole[link]
            short[state] = state if state in self.endings else short[link]
        self.whole, self.short = whole, short
        owners: dict[int, set[str | None]] = {}
        for name, words in numbered:
            if len(words) >= window:
                state, length = 0, 0
                for c in words:
                    state, length = self.steps[state * self.factor + c], length + 1
                    if length >= window:
                        owners.setdefault(whole[state], set()).add(name)
        self.owners = owners
        return self

    @staticmethod
    def _insert(words: list[int], lengths: list[int], links: list[int], steps: list[dict[int, int]]) -> int:
        """Adds a sequence, word by word; the state of the whole sequence."""

        def split(state: int, c: int, child: int) -> int:
            """The state of the strings of `state` followed by c, parted from longer ones that share their links."""
            if lengths[child] == lengths[state] + 1:
                return child
            parted = len(lengths)
            lengths.append(lengths[state] + 1)
            links.append(links[child])
            steps.append(dict(steps[child]))
            links[child] = parted
            while state >= 0 and steps[state].get(c) == child:
                steps[state][c] = parted
                state = links[state]
            return parted

        last = 0
        for c in words:
            if c in steps[last]:
                last = split(last, c, steps[last][c])
                continue
            new = len(lengths)
            lengths.append(lengths[last] + 1)
            links.append(0)
            steps.append({})
            state = last
            while state >= 0 and c not in steps[state]:
                steps[state][c] = new
                state = links[state]
            if state >= 0:
                links[new] = split(state, c, steps[state][c])
            last = new
        return last

    def walk(self, words: list[int], first: int, names: set, hits: list[tuple[int, int]]) -> int:
        """Streams known words, the first at place `first`: adds hit words (first, last) and items; the longest match."""
        steps, factor, window, longest = self.steps, self.factor, self.window, 0
        state = length = 0
        for place, c in enumerate(words, first):
            while (to := steps.get(state * factor + c)) is None:
                state = self.links[state]
                length = self.lengths[state]
            state, length = to, length + 1
            reach = 0
            if length >= window:
                reach = window
                names |= self.owners[self.whole[state]]
            up = self.short[state]
            while up:
                for n, name in self.endings[up]:
                    if n <= length:
                        reach = max(reach, n)
                        names.add(name)
                up = self.short[self.links[up]]
            if reach:
                longest = max(longest, length)
                if hits and place - reach + 1 <= hits[-1][1] + 1:
                    begin = min(hits[-1][0], place - reach + 1)
                    hits[-1] = (begin, place)
                else:
                    hits.append((place - reach + 1, place))
        return longest


def _scan(shared: Broadcast | None, window: int, hits_only: bool = False):
    """Adds n_words, longest, spans and items to rows with a text; without an automaton only n_words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of([], window) if shared is None else Automaton(pickle.loads(shared.value))
        known = automaton.words.get
        for whole in batches:
            for batch in slices(whole, "_bytes", 1 << 20):
                texts = batch.column("_bytes").to_pylist()
                words = b" | ".join([text.translate(LOWER) for text in texts]).split()
                ids = np.fromiter(map(known, words, repeat(0)), np.int64, len(words))
                borders = np.flatnonzero(ids == -1)
                starts, ends = np.append(0, borders + 1), np.append(borders, len(ids))
                found: list[tuple[int, list, set]] = [(0, [], set()) for _ in texts]
                for row, first, last in _runs(automaton, ids, starts):
                    longest, hits, names = found[row]
                    own = automaton.walk(ids[first:last].tolist(), first - int(starts[row]), names, hits)
                    found[row] = (max(longest, own), hits, names)
                spans = [_placed(text, hits) if hits else None for text, (_, hits, _) in zip(texts, found)]
                names = [sorted(x for x in own if x is not None) if own else None for _, _, own in found]
                columns = [
                    pa.array((ends - starts)[: len(texts)], pa.int32()),
                    pa.array([longest for longest, _, _ in found], pa.int32()),
                    pa.array(spans, FOUND_ARROW[1].type),
                    pa.array(names, FOUND_ARROW[2].type),
                ]
                rest = [name for name in batch.schema.names if name != "_bytes"]
                out = pa.RecordBatch.from_arrays(
                    [*(batch.column(name) for name in rest), *columns],
                    schema=pa.schema([*(batch.schema.field(name) for name in rest), pa.field("n_words", pa.int32()), *FOUND_ARROW]),
                )
                yield out.filter(pa.array([x is not None for x in spans])) if hits_only else out

    return scan


def _runs(automaton: Automaton, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs (row, first, behind the last) of known words, each after one it follows in an item, not shorter than the least window."""
    live = ids > 0
    if not live.any():
        return
    both = np.flatnonzero(live[:-1] & live[1:])
    codes = ids[both] * automaton.factor + ids[both + 1]
    at = np.minimum(np.searchsorted(automaton.pairs, codes), max(0, len(automaton.pairs) - 1))
    linked = np.zeros(len(ids) + 1, bool)  # whether a word follows the one before it in an item
    if len(automaton.pairs):
        linked[both[automaton.pairs[at] == codes] + 1] = True
    first = np.flatnonzero(live & ~linked[:-1])
    last = np.flatnonzero(live & ~linked[1:]) + 1
    long = last - first >= automaton.least
    rows = np.searchsorted(starts, first[long], "right") - 1
    yield from zip(rows.tolist(), first[long].tolist(), last[long].tolist())


def _placed(text: bytes, hits: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of words with the bytes from the first to the end of the last."""
    found = [match.span() for match in WORD.finditer(text.translate(LOWER))]
    return [{"first": a, "last": b, "from": found[a][0], "to": found[b][1]} for a, b in _joined(hits)]


def _joined(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks as maximal runs."""
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            begins, ends = {s["first"]: s["from"] for s in spans}, {s["last"]: s["to"] for s in spans}
            runs = _joined([(s["first"], s["last"]) for s in spans])
            merged.append([{"first": a, "last": b, "from": begins[a], "to": ends[b]} for a, b in runs])
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, batch.schema.field(at), pa.array(merged, FOUND_ARROW[1].type))


def items_digest() -> Column:
    return F.sha2(F.array_join("items", ","), 256)
