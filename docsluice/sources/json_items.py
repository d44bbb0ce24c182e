"""Items of files that hold one JSON array or object each, cut by many tasks per file.

A file is read as fragments that end at closing braces, in byte ranges that Spark cuts as
it cuts lines. What a range does to the state of a reader, whether it stands inside a
string and how deep, depends on the state it is entered with in two cases only: inside a
string or not. So every range is summarised on its own for both, the summaries, one small
row per range, are chained, and every range is cut on its own at the commas of depth one.
Items that cross ranges are put together from their pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsluice.session import fresh_path, reliable, stored_bytes

SLAB = 4 << 20
MEASURES = "path string, block long, flips int, deeper long, deeper_inside long"
PIECES = "path string, block long, part int, text string, ended boolean"

# Where a piece of an item stands in its range.
WHOLE, HEAD, TAIL = 0, 1, 2

_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")] = 1
_STEP[list(b"]}")] = -1
_SIGN = _STEP != 0
_SIGN[ord(",")] = True


def json_items(spark: SparkSession, path: str, most_bytes: int = 8 << 20) -> DataFrame:
    """Rows (path, item) of the files that `path` names, one JSON array or object each.

    An item is the JSON text of one element of the array, or `"key": value` of one entry
    of the object, without regard to what it holds. Tasks read ranges of at most
    `spark.sql.files.maxPartitionBytes`. Empty files, arrays and objects have no items. Of a
    file that breaks off, the items before the break come out; an object or array that the
    break cuts is left out. The states of the ranges are broadcast, and ranges cut where
    they lie, if the states have proved to take at most `most_bytes`; beyond that, with
    millions of ranges, the text is shuffled by range.
    """
    fragments = spark.read.option("lineSep", "}").text(path)
    fragments = fragments.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("data"),
    )
    # Kept with their ranges: a later scan might be cut otherwise.
    fragments = reliable(fragments)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1
    depth = F.coalesce(F.sum(F.when(F.col("inside"), F.col("deeper_inside")).otherwise(F.col("deeper"))).over(before), F.lit(0))
    measures = fragments.select("path", "block", "data").mapInArrow(_measure, MEASURES)
    states = measures.withColumn("inside", inside).withColumn("depth", depth).select("path", "block", "inside", "depth")
    entry = fresh_path(spark, "states")
    states.write.parquet(entry)
    states = spark.read.schema(states.schema).parquet(entry)
    if stored_bytes(spark, entry) <= most_bytes:
        cut = fragments.join(F.broadcast(states), ["path", "block"]).mapInArrow(_cut_in_order, PIECES)
    else:
        cut = fragments.join(states, ["path", "block"]).groupBy("path", "block").applyInArrow(_cut, PIECES)
    stored = fresh_path(spark, "pieces")
    cut.write.parquet(stored)
    pieces = spark.read.schema(PIECES).parquet(stored)
    whole = pieces.filter(F.col("part") == WHOLE).select("path", F.col("text").alias("item"))
    # At most two pieces of a range belong to items that cross its ends.
    in_order = Window.partitionBy("path").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.filter(F.col("part") != WHOLE).withColumn("number", F.count_if(F.col("part") == TAIL).over(in_order))
    parts = F.array_sort(F.collect_list(F.struct("block", "part", "text")))
    crossing = numbered.groupBy("path", "number").agg(
        F.array_join(F.transform(parts, lambda piece: piece["text"]), "").alias("item"), F.bool_or("ended").alias("ended")
    )
    return whole.unionByName(crossing.filter("ended").select("path", "item")).filter(F.col("item").rlike(r"\S"))


def _slabs(data: Iterable[bytes]) -> Iterator[bytes]:
    """The fragments with their closing braces, several at once."""
    held, size = [], 0
    for fragment in data:
        held.append(fragment)
        size += len(fragment) + 1
        if size >= SLAB:
            yield b"}".join(held) + b"}"
            held, size = [], 0
    if held:
        yield b"}".join(held) + b"}"


def _signs(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and bytes of the brackets and commas outside strings, and whether the text ends inside one."""
    codes = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(codes == ord('"'))
    slashes = codes == ord("\\")
    if len(quotes) and slashes.any():
        # A quote after an odd run of backslashes belongs to its string.
        other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(codes))))
        run = np.where(quotes > 0, quotes - 1 - other[quotes - 1], 0)
        quotes = quotes[run % 2 == 0]
    places = np.flatnonzero(_SIGN[codes])
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    return places, codes[places], bool((len(quotes) + inside) % 2)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to the state; the fragments come in order, range after range."""
    found: list[tuple] = []
    key, state, depth = None, [False, True], [0, 0]
    for here, run in _runs(batches):
        if here != key:
            if key is not None:
                found.append((*key, int(state[0]), *depth))
            key, state, depth = here, [False, True], [0, 0]
        for slab in _slabs(run.column("data").to_pylist()):
            for case in (0, 1):
                _, codes, state[case] = _signs(slab, state[case])
                depth[case] += int(_STEP[codes].sum(dtype=np.int64))
    if key is not None:
        found.append((*key, int(state[0]), *depth))
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = [column.split()[0] for column in MEASURES.split(", ")]
    columns = zip(*found) if found else [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds)], names=names)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batches, cut where a range ends."""
    for batch in batches:
        keys = list(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()))
        starts = [n for n in range(len(keys)) if n == 0 or keys[n] != keys[n - 1]]
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            yield keys[start], batch.slice(start, end - start)


def _cut_in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of fragments that come in order, range after range; one range is held at a time."""
    key, held = None, []
    for here, run in _runs(batches):
        if here != key and held:
            yield from _cut(pa.Table.from_batches(held)).to_batches()
            held = []
        key = here
        held.append(run)
    if held:
        yield from _cut(pa.Table.from_batches(held)).to_batches()


def _cut(fragments: pa.Table) -> pa.Table:
    """The pieces of one range: items that lie in it whole, the end of one begun before it, the start of its last one."""
    fragments = fragments.sort_by("place")
    path, block = fragments.column("path")[0].as_py(), fragments.column("block")[0].as_py()
    inside, depth = fragments.column("inside")[0].as_py(), fragments.column("depth")[0].as_py()
    pieces: list[tuple[int, str, bool]] = []
    held: list[bytes] = []
    # An item is open wherever the depth is not zero.
    part, is_open = HEAD, depth > 0
    for slab in _slabs(value.as_py() for value in fragments.column("data")):
        places, codes, inside = _signs(slab, inside)
        steps = _STEP[codes].astype(np.int64)
        depths = depth + np.cumsum(steps)
        marks = ((steps == 0) & (depths == 1)) | ((steps == 1) & (depths == 1)) | ((steps == -1) & (depths == 0))
        start = 0
        for place, step in zip(places[marks].tolist(), steps[marks].tolist()):
            if is_open:
                held.append(slab[start:place])
                pieces.append((part, b"".join(held).decode("utf-8", "replace"), True))
            held, start = [], place + 1
            part, is_open = WHOLE, step >= 0
        if is_open:
            held.append(slab[start:])
        depth = int(depths[-1]) if len(depths) else depth
    if is_open:
        # What no sign ended goes on in the next range.
        pieces.append((HEAD if part == HEAD else TAIL, b"".join(held).decode("utf-8", "replace"), False))
    parts, texts, ended = zip(*pieces) if pieces else ([], [], [])
    return pa.table(
        {
            "path": pa.array([path] * len(parts), pa.string()),
            "block": pa.array([block] * len(parts), pa.int64()),
            "part": pa.array(parts, pa.int32()),
            "text": pa.array(texts, pa.string()),
            "ended": pa.array(ended, pa.bool_()),
        }
    )
