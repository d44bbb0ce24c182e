"""Removal of long repeated byte strings, by column-wise construction over many texts.

Every byte covered by a string of `length` bytes that also starts anywhere else goes.
Two strings can only be equal if they have the same anchor (see `anchors`), so texts
fall into contexts: an anchor with the windows it stands for. Contexts whose anchor
occurs once hold no repeat; those whose anchor always has the same context repeat as a
whole. Only for the rest bytes have to be compared.

The contexts of a task are a collection of texts, aligned at their anchors. It is
built column by column from the right: each round inserts one symbol of every text in
front, which is a stable bucketing of the order of the last round by that symbol (the
column of the transform), and updates the common prefixes of neighbours: one more than
the least between them before. A window repeats if it shares `length` symbols with a
neighbour. Columns are read once, in sequence. Equal windows stand in the same column,
so the orders of different columns need not be merged into one.

Anchors with very many different contexts do not fit a task; their windows are counted
by hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm.anchors import windows
from docsluice.llm.common import as_bytes, joined, kept, slices

LENGTH = 200
COLLECTION = 1 << 15
# An anchor is crowded if its contexts alone are more than a collection holds.
CROWDED = COLLECTION
SPAN = "first int, last int"


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, crowded: int = CROWDED
) -> DataFrame:
    """One row per input row: key, n_bytes, spans (array of from, to), n_removed, n_spans, kept_sha256.

    `spans` are the maximal runs of removed bytes. Texts are UTF-8 bytes, null counts as
    empty; matches lie inside texts and are judged on the input. Of repeated rows and
    equal texts of `length` bytes or more nothing is kept, in any of them; shorter texts
    stay whole. Overlapping repeats in one text count. Null and repeated keys are no
    matter, texts are told apart by their digests. An empty table gives no rows.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), as_bytes(text).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    rows = kept(source.select("id", digest.alias("sha"), F.length("text").cast("long").alias("n_bytes")), "repeats-rows")
    long = source.filter(F.length("text") >= length).withColumn("sha", digest)
    copies = kept(
        rows.filter(F.col("n_bytes") >= length).groupBy("sha", "n_bytes").agg(F.count("*").alias("copies"), F.min("id").alias("one")),
        "repeats-texts",
    )
    # An anchor whose contexts differ has two different hashes of contexts.
    anchored = kept(long.select("sha", "text").mapInArrow(_anchored(length), "sha binary, key long, context long, " + SPAN + ", at int"), "repeats-anchors")
    keys = anchored.groupBy("key").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    repeated = kept(keys.filter("n > 1").select("key", (F.col("a") != F.col("b")).alias("mixed")), "repeats-keys")
    found = kept(anchored.join(repeated, "key").select("sha", "key", "first", "last", "at", "mixed").distinct(), "repeats-found")

    mixed = found.filter("mixed").groupBy("sha").agg(F.collect_list(F.struct("key", "first", "last", "at")).alias("runs"))
    mixed = kept(mixed.join(copies.select("sha", "copies", "one"), "sha"), "repeats-mixed")
    # One row of each text gives its contexts; they weigh as much as it has copies.
    asked = long.join(mixed, "sha").filter(F.col("id").eqNullSafe(F.col("one"))).select("sha", "text", "copies", "runs")
    contexts = kept(asked.mapInArrow(_contexts(length), "sha binary, begin int, key long, ahead int, copies long, bytes binary"), "repeats-contexts")
    different = kept(
        contexts.groupBy("key", "ahead", "bytes").agg(F.sum("copies").alias("copies")), "repeats-different"
    )
    crowd = kept(different.groupBy("key").count().filter(F.col("count") > crowded).select("key"), "repeats-crowded")
    fitting = different.join(crowd, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    runs = fitting.select("key", "ahead", "bytes", "copies").mapInArrow(_collections(length), "key long, bytes binary, " + SPAN)
    if not crowd.isEmpty():
        runs = runs.unionByName(_by_hash(different.join(crowd, "key", "left_semi"), length))
    runs = kept(runs.withColumn("mark", F.xxhash64("bytes")).select("key", "mark", "bytes", "first", "last"), "repeats-runs")
    own = contexts.filter("copies = 1").withColumn("mark", F.xxhash64("bytes"))
    partly = own.join(runs, ["key", "mark", "bytes"]).select("sha", (F.col("begin") + F.col("first")).alias("first"), (F.col("begin") + F.col("last")).alias("last"))
    whole = found.filter("NOT mixed").select("sha", "first", "last")
    single = copies.filter("copies = 1").select("sha", "one")
    spans = partly.unionByName(whole).groupBy("sha").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    spans = kept(spans.join(single, "sha"), "repeats-spans")
    cut = long.join(spans, "sha").filter(F.col("id").eqNullSafe(F.col("one"))).select("sha", "text", "starts")
    result = "sha binary, spans array<struct<from:int,to:int>>, n_removed long, kept_sha256 string"
    parts = cut.mapInArrow(_cut(length), result).unionByName(
        copies.filter("copies > 1").select(
            "sha",
            F.array(F.struct(F.lit(0).alias("from"), F.col("n_bytes").cast("int").alias("to"))).alias("spans"),
            F.col("n_bytes").alias("n_removed"),
            F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"),
        )
    )
    parts = kept(parts, "repeats-parts")
    nothing = F.array().cast("array<struct<from:int,to:int>>")
    return rows.join(parts, "sha", "left").select(
        F.col("id").alias(key),
        "n_bytes",
        F.coalesce("spans", nothing).alias("spans"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def _anchored(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, starts = joined(batch.column("text"))
                view, digest = memoryview(data), xxhash.xxh3_64_intdigest
                for key, at, first, last in windows(data, starts, length):
                    row = np.searchsorted(starts, first, "right") - 1
                    ends = (last + length).tolist()
                    context = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), ends)], np.uint64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "sha": batch.column("sha").take(pa.array(row)),
                            "key": pa.array(key),
                            "context": pa.array(context.view(np.int64)),
                            "first": pa.array((first - starts[row]).astype(np.int32)),
                            "last": pa.array((last - starts[row]).astype(np.int32)),
                            "at": pa.array((at - starts[row]).astype(np.int32)),
                        }
                    )

    return scan


def _contexts(length: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in ("sha", "begin", "key", "ahead", "copies", "bytes")}
            for row in batch.to_pylist():
                for run in row["runs"]:
                    columns["sha"].append(row["sha"])
                    columns["begin"].append(run["first"])
                    columns["key"].append(run["key"])
                    columns["ahead"].append(run["at"] - run["first"])
                    columns["copies"].append(row["copies"])
                    columns["bytes"].append(row["text"][run["first"] : run["last"] + length])
            types = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), types)], list(columns))

    return take


def _collections(length: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors come one after the other; a collection ends with an anchor."""
        waiting: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count < COLLECTION:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            key = table.column("key").to_numpy()
            new = np.flatnonzero(key[1:] != key[:-1]) + 1
            cut = int(new[-1]) if len(new) else 0
            at = 0
            while at < cut:
                to = int(new[max(np.searchsorted(new, at + COLLECTION, "right") - 1, np.searchsorted(new, at, "right"))])
                yield from _repeated(table.slice(at, to - at), length)
                at = to
            waiting, count = table.slice(cut).to_batches(), table.num_rows - cut
        if count:
            yield from _repeated(pa.Table.from_batches(waiting).combine_chunks(), length)

    return build


def _repeated(contexts: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    texts = contexts.column("bytes").to_pylist()
    starts = repeated_starts(texts, contexts.column("ahead").to_numpy(), contexts.column("copies").to_numpy(), length)
    row, first, last = _runs(starts)
    if len(row):
        taken = contexts.select(["key", "bytes"]).take(pa.array(row)).combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_pydict(
            {
                "key": taken.column("key"),
                "bytes": taken.column("bytes"),
                "first": pa.array(first.astype(np.int32)),
                "last": pa.array(last.astype(np.int32)),
            }
        )


def repeated_starts(texts: list[bytes], ahead: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """Texts by start: whether the window that begins there occurs in another text at the same distance from the anchor.

    `ahead` bytes stand before the anchor. A text with several copies repeats as a whole.
    """
    sizes = np.array([len(text) for text in texts])
    most = int(ahead.max())
    wide = int((most - ahead + sizes).max())
    columns = np.zeros((wide, len(texts)), np.uint16)  # a column per row; 0 stands for no symbol
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns[inside + (most - ahead)[text], text] = flat
    begins = most - ahead
    found = np.zeros((len(texts), int((sizes - length).max()) + 1), bool)
    found[copies > 1] = np.arange(found.shape[1]) <= (sizes - length)[copies > 1, None]

    order, prefix = np.arange(len(texts)), np.zeros(len(texts) + 1, np.int64)
    for column in range(wide - 1, -1, -1):
        symbols = columns[column][order]
        bucketed = np.argsort(symbols, kind="stable")
        symbols = symbols[bucketed]
        same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] > 0)) + 1
        between = np.column_stack([bucketed[same - 1] + 1, bucketed[same] + 1]).ravel()
        least = np.minimum.reduceat(prefix, between)[::2] if len(between) else np.zeros(0, np.int64)
        prefix = np.zeros(len(texts) + 1, np.int64)
        prefix[same] = least + 1
        order = order[bucketed]
        near = (prefix[:-1] >= length) | (prefix[1:] >= length)
        hit = order[near]
        found[hit, column - begins[hit]] = True
    return found


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of the runs of true values in each row."""
    padded = np.zeros((starts.shape[0], starts.shape[1] + 2), np.int8)
    padded[:, 1:-1] = starts
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - 1


def _by_hash(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of contexts, by counting every window's hash at its distance from the anchor."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "bytes", 1 << 16):
                key, ahead, copies = (batch.column(name).to_numpy() for name in ("key", "ahead", "copies"))
                texts = batch.column("bytes").to_pylist()
                sizes = np.array([len(text) - length + 1 for text in texts])
                row = np.repeat(np.arange(len(texts)), sizes)
                hashes = b"".join(
                    xxhash.xxh3_128_digest(text[at : at + length]) for text, size in zip(texts, sizes.tolist()) for at in range(size)
                )
                start = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                halves = np.frombuffer(hashes, "<i8").reshape(-1, 2)
                mark = np.array([xxhash.xxh3_64_intdigest(text) for text in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(key[row]),
                        "mark": pa.array(mark[row]),
                        "start": pa.array(start.astype(np.int32)),
                        "off": pa.array((start - ahead[row]).astype(np.int32)),
                        "a": pa.array(np.ascontiguousarray(halves[:, 0])),
                        "b": pa.array(np.ascontiguousarray(halves[:, 1])),
                        "copies": pa.array(copies[row]),
                    }
                )

    schema = "key long, mark long, start int, off int, a long, b long, copies long"
    each = kept(contexts.select("key", "ahead", "bytes", "copies").mapInArrow(emit, schema), "repeats-windows")
    window = ["key", "off", "a", "b"]
    often = kept(each.groupBy(*window).agg(F.sum("copies").alias("n")).filter("n > 1").select(*window), "repeats-often")
    hits = each.join(often, window).groupBy("key", "mark").agg(F.sort_array(F.collect_set("start")).alias("starts"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, mark, first, last = [], [], [], []
            for row in batch.to_pylist():
                starts = np.array(row["starts"])
                breaks = np.flatnonzero(np.diff(starts) > 1)
                for a, b in zip(starts[np.r_[0, breaks + 1]].tolist(), starts[np.r_[breaks, len(starts) - 1]].tolist()):
                    key.append(row["key"])
                    mark.append(row["mark"])
                    first.append(a)
                    last.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(mark, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                ["key", "mark", "first", "last"],
            )

    found = kept(hits.mapInArrow(runs, "key long, mark long, " + SPAN), "repeats-crowded-runs")
    marked = contexts.select("key", "bytes").mapInArrow(_marks, "key long, mark long, bytes binary")
    return marked.join(found, ["key", "mark"]).select("key", "bytes", "first", "last")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mark = [xxhash.xxh3_64_intdigest(text) for text in batch.column("bytes").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {"key": batch.column("key"), "mark": pa.array(np.array(mark, np.uint64).view(np.int64)), "bytes": batch.column("bytes")}
        )


def _cut(length: int):
    """Maximal removed runs of each text and the digest of what stays."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, spans, removed, digests = [], [], [], []
            for row in batch.to_pylist():
                merged: list[dict] = []
                for first, last in sorted((run["first"], run["last"]) for run in row["starts"]):
                    if merged and first <= merged[-1]["to"]:
                        merged[-1]["to"] = max(merged[-1]["to"], last + length)
                    else:
                        merged.append({"from": first, "to": last + length})
                stays, at = hashlib.sha256(), 0
                for span in merged:
                    stays.update(row["text"][at : span["from"]])
                    at = span["to"]
                stays.update(row["text"][at:])
                shas.append(row["sha"])
                spans.append(merged)
                removed.append(sum(span["to"] - span["from"] for span in merged))
                digests.append(stays.hexdigest())
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shas, pa.binary()), pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["sha", "spans", "n_removed", "kept_sha256"],
            )

    return cut
