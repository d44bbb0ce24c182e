"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. Each window gives every queue its quantum, its
target share of the window; what a queue may not yet spend of it, a fraction of a
token, is its deficit and is carried into the next window. A queue that runs dry
leaves its share to the others. The state of the schedule after any window is a sum of
what was granted, so a task that begins anywhere in a queue computes the deficits it
is to carry on with instead of waiting for the task before it: windows and partitions
follow each other seamlessly, and no token is moved before its place is known.

Windows are laid one after the other and cut into sequences. All but the last are full;
what remains is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import as_bytes, give_back, kept, slices
from docsluice.llm.tokens import word_encoder
from docsluice.session import bounded, small_table

TOKENS = "id long, source string, part int, ahead long, n long, ids binary"
# Between the two passes ids are kept in 16 bits; larger vocabularies are refused.
STORED = np.dtype("<u2")
PIECES = "id long, source string, start long, ids binary, doc_tokens long, sequence_id long, offset long"

# Grants that are looked at together.
CELLS = 1 << 20
# Bytes of texts or stored ids that are looked at together. The JVM and a worker hold what comes of them, a multiple, at once.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class PackConfig:
    """`window` tokens get the target mixture; `weights` by source, by default as the sources come.

    Of more than `queues` sources the `queues` - 1 largest have a queue each and all
    others share one, inside which the same schedule orders them (`Shared`).
    """

    tokenizer: str = field(default_factory=lambda: public_tokenizers.path("word_bpe_49k.json"))
    end_id: int = 1
    length: int = 2048
    window: int = 2048
    queues: int = 256
    weights: dict[str, float] | None = None


class Schedule:
    """Tokens granted to every queue after each window.

    In virtual time every queue that is not dry is served at the rate of its weight.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int, length: int):
        self.totals, self.weights = np.array(totals, np.int64), np.array(weights, float)
        self.window, self.length, self.all = window, length, int(sum(totals))
        self.windows = -(-self.all // window)
        dry = self.totals / self.weights
        order = np.argsort(dry, kind="stable")
        self.times = np.concatenate([[0.0], dry[order]])
        left = np.maximum(self.weights.sum() - np.concatenate([[0.0], np.cumsum(self.weights[order])[:-1]]), 0)
        self.served = np.concatenate([[0.0], np.cumsum(np.diff(self.times) * left)])
        self.full = self.all // length
        rest, sizes = self.all % length, []
        while rest:
            sizes.append(1 << rest.bit_length() - 1)
            rest -= sizes[-1]
        self.tail = self.full * length + np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)

    def granted(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) in the first so many windows (rows)."""
        time = np.interp(windows * float(self.window), self.served, self.times)
        due = np.minimum(np.floor(time[:, None] * self.weights).astype(np.int64), self.totals)
        due[windows >= self.windows] = self.totals
        due[windows <= 0] = 0
        return due

    def own(self, queue: int, windows: np.ndarray) -> np.ndarray:
        """Tokens of one queue in the first so many windows."""
        time = np.interp(windows * float(self.window), self.served, self.times)
        due = np.minimum(np.floor(time * self.weights[queue]).astype(np.int64), self.totals[queue])
        due[windows >= self.windows] = self.totals[queue]
        due[windows <= 0] = 0
        return due

    def window_of(self, queue: int, places: np.ndarray) -> np.ndarray:
        """The window that grants the token at each place of a queue."""
        at = np.interp((places + 1) / self.weights[queue], self.times, self.served) / self.window
        low = np.clip(np.floor(at).astype(np.int64) - 1, 0, self.windows - 1)
        high = np.minimum(low + 3, self.windows)
        # Rounding may shift a grant; what each window has granted decides.
        step = 1
        while (late := self.own(queue, low) > places).any():
            low, step = np.where(late, np.maximum(low - step, 0), low), 2 * step
        step = 1
        while (early := self.own(queue, high) <= places).any():
            high, step = np.where(early, np.minimum(high + step, self.windows), high), 2 * step
        while (high - low > 1).any():
            middle = (low + high) // 2
            after = self.own(queue, middle) <= places
            low, high = np.where(after, middle, low), np.where(after, high, np.maximum(middle, low + 1))
        return low

    def begins(self, queue: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The places in [first, last) of a queue at which a window begins to grant, the first one included, and these windows.

        A run of many tokens per window walks the windows, one of few the tokens, so
        that the work is bounded by the run however many windows it spans.
        """
        low, high = self.window_of(queue, np.array([first, last - 1]))
        if high - low < last - first:
            windows = np.arange(low, high + 1)
            own = self.own(queue, windows)
            some = np.append(own[1:], last) > np.maximum(own, first)
            return np.maximum(own[some], first), windows[some]
        windows = self.window_of(queue, np.arange(first, last))
        new = np.flatnonzero(np.diff(windows, prepend=-1))
        return first + new, windows[new]

    def starts(self, queue: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of a queue in each window (ascending) is laid, and what the queue had been granted before."""
        places, own = np.empty(len(windows), np.int64), np.empty(len(windows), np.int64)
        step = max(1, CELLS // len(self.totals))
        for at in range(0, len(windows), step):
            here = windows[at : at + step]
            bounds = np.unique(np.concatenate([here, here + 1]))
            granted, low = self.granted(bounds), np.searchsorted(bounds, here)
            # Before it come the earlier windows whole, and of its own window the queues before.
            places[at : at + step] = granted[low, queue:].sum(axis=1) + granted[low + 1, :queue].sum(axis=1)
            own[at : at + step] = granted[low, queue]
        return places, own

    def place(self, queue: int, places: np.ndarray) -> np.ndarray:
        """Where the token at each place of a queue is laid."""
        windows, back = np.unique(self.window_of(queue, places), return_inverse=True)
        laid, own = self.starts(queue, windows)
        return laid[back] + places - own[back]

    def bound(self, places: np.ndarray) -> np.ndarray:
        """End of the sequence each place lies in."""
        tail = np.searchsorted(self.tail, places, "right").clip(0, len(self.tail) - 1)
        return np.where(places < self.tail[0], (places // self.length + 1) * self.length, self.tail[tail])

    def sequence(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tail = np.searchsorted(self.tail, places, "right") - 1
        late = places >= self.tail[0]
        return (
            np.where(late, self.full + tail, places // self.length),
            np.where(late, places - self.tail[tail.clip(0)], places % self.length),
        )


class Shared:
    """The order of tokens in a queue that sources share: schedules in schedules, none of more than `queues` queues.

    Their windows are single tokens, so any stretch of the queue has the proportions of the sources.
    """

    def __init__(self, totals: list[int], weights: list[float], queues: int):
        self.firsts = np.linspace(0, len(totals), min(max(queues, 2), len(totals)) + 1).astype(np.int64)
        parts = list(zip(self.firsts.tolist(), self.firsts[1:].tolist()))
        self.parts = [Shared(totals[a:b], weights[a:b], queues) if b - a > 1 else None for a, b in parts]
        self.schedule = Schedule([sum(totals[a:b]) for a, b in parts], [sum(weights[a:b]) for a, b in parts], 1, 1)

    def place(self, number: int, places: np.ndarray) -> np.ndarray:
        """Place in the queue of each token of the source of that number."""
        part = int(np.searchsorted(self.firsts, number, "right")) - 1
        if self.parts[part] is not None:
            places = self.parts[part].place(number - int(self.firsts[part]), places)
        return self.schedule.place(part, places)


def tokenized(docs: DataFrame, key: str, text: str, source: str, config: PackConfig) -> DataFrame:
    """Ids of every row with the end id: id, source, part (task), ahead (tokens of the source before it in the part), n, ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = word_encoder(config.tokenizer), TaskContext.get().partitionId(), {}
        if max(len(encoder.ends) - 1, config.end_id) > np.iinfo(STORED).max:
            raise ValueError("the vocabulary has more than 65,536 ids")
        end = np.array([config.end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", AT_ONCE):
                found = [ids + end for ids in encoder.encode(batch.column("text").to_pylist())]
                sources, sizes = batch.column("source").to_pylist(), [len(ids) // 4 for ids in found]
                stored = np.frombuffer(b"".join(found), "<u4").astype(STORED)
                del found
                ahead = []
                for name, size in zip(sources, sizes):
                    ahead.append(seen.get(name, 0))
                    seen[name] = ahead[-1] + size
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id"),
                        "source": batch.column("source"),
                        "part": pa.array(np.full(len(sizes), part, np.int32)),
                        "ahead": pa.array(ahead, pa.int64()),
                        "n": pa.array(sizes, pa.int64()),
                        "ids": _binaries(stored, np.array(sizes)),
                    }
                )
        encoder.known.clear()
        give_back()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), as_bytes(text).alias("text"))
    return rows.mapInArrow(scan, TOKENS)


def _binaries(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The ids cut into rows of so many."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", config: PackConfig = PackConfig()
) -> DataFrame:
    """One row per piece: key, source, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    A row's ids are those of its text (null: none) and the end id; each lies in exactly
    one piece. `start` counts from the beginning of the row, `offset` from that of the
    sequence; offsets have no gaps. A null source is a source like any other; repeated
    rows are packed as often as they occur. Documents keep the order they are stored in.
    An empty table gives no rows. Weights are above 0; sources that `weights` does not
    name weigh like the smallest it names.
    """
    spark = docs.sparkSession
    tokens = kept(tokenized(docs, key, text, source, config), "pack-tokens")
    counts = kept(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "pack-counts")
    sizes = counts.groupBy("source").agg(F.sum("n").alias("size"))
    ranked = sizes.orderBy(F.desc("size"), "source").collect()
    if not ranked:
        return spark.createDataFrame([], PIECES).withColumnRenamed("id", key).withColumn("length", F.lit(0).cast("long"))
    totals = [row["size"] for row in ranked]
    weights = [float(size) / sum(totals) for size in totals] if not config.weights else [
        float(config.weights.get(row["source"], min(config.weights.values()))) for row in ranked
    ]
    shared, own = None, len(ranked) if len(ranked) <= config.queues else config.queues - 1
    if own < len(ranked):
        shared = Shared(totals[own:], weights[own:], config.queues)
        totals, weights = totals[:own] + [sum(totals[own:])], weights[:own] + [sum(weights[own:])]
    schedule = Schedule(totals, weights, config.window, config.length)

    names = pa.schema([("name", pa.string()), ("queue", pa.int32())])
    known = bounded(small_table(spark, ((row["source"], number) for number, row in enumerate(ranked)), names))
    queued = counts.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = queued.select(
        F.col("source").alias("of"), F.col("part").alias("in"), "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    )
    first = kept(first, "pack-first")
    joined = tokens.join(first, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    placed = joined.select("id", "source", "queue", (F.col("first") + F.col("ahead")).alias("at"), "n", "ids")
    pieces = placed.mapInArrow(_cut(schedule, shared), PIECES)
    length = (F.length("ids") / 4).cast("long")
    return pieces.select(F.col("id").alias(key), "source", "start", length.alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


def _cut(schedule: Schedule, shared: Shared | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids", AT_ONCE):
                table = pa.Table.from_batches([batch]).sort_by([("queue", "ascending"), ("at", "ascending")])
                batch = table.combine_chunks().to_batches()[0]
                queue, at, n = (batch.column(name).to_numpy() for name in ("queue", "at", "n"))
                # Runs of rows that follow each other in one queue.
                new = (queue[1:] != queue[:-1]) | (at[1:] != at[:-1] + n[:-1])
                starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(queue)]])
                for first, last in zip(starts, starts[1:]):
                    yield _run(schedule, batch.slice(first, last - first), int(queue[first]), at[first:last], n[first:last], shared)

    return cut


def _run(
    schedule: Schedule, rows: pa.RecordBatch, queue: int, at: np.ndarray, n: np.ndarray, shared: Shared | None = None
) -> pa.RecordBatch:
    """Pieces of rows that lie one after the other in a source; the sources after those with a queue of their own share the last one."""
    first, last = int(at[0]), int(at[-1] + n[-1])
    alone = len(schedule.totals) - (shared is not None)
    if queue < alone:
        begins, windows = schedule.begins(queue, first, last)
        places, own = schedule.starts(queue, windows)
        granted, begins = begins, np.union1d(at, begins)
        window = np.searchsorted(granted, begins, "right") - 1
        place = places[window] + begins - own[window]
    else:
        places = schedule.place(alone, shared.place(queue - alone, np.arange(first, last)))
        begins = np.union1d(at, first + np.flatnonzero(np.diff(places, prepend=-2) != 1))
        place = places[begins - first]
    size = np.diff(np.concatenate([begins, [last]]))
    parts = []
    while len(begins):
        end = np.minimum(size, schedule.bound(place) - place)
        parts.append((begins, place, end))
        more = size > end
        begins, place, size = begins[more] + end[more], place[more] + end[more], size[more] - end[more]
    begins, place, size = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(begins, kind="stable")
    begins, place, size = begins[order], place[order], size[order]
    row = np.searchsorted(at, begins, "right") - 1
    sequence, offset = schedule.sequence(place)
    ids = _binaries(np.frombuffer(b"".join(rows.column("ids").to_pylist()), STORED).astype("<u4"), size)
    taken = pa.array(row)
    return pa.RecordBatch.from_pydict(
        {
            "id": rows.column("id").take(taken),
            "source": rows.column("source").take(taken),
            "start": pa.array(begins - at[row]),
            "ids": ids,
            "doc_tokens": pa.array(n[row]),
            "sequence_id": pa.array(sequence),
            "offset": pa.array(offset),
        }
    )
