"""Exact deduplication: sorted digest runs merged in binomial rounds.

Every partition of the input becomes a run: its rows sorted by digest, one record
per digest. The runs are numbered; in round r each run exchanges records with the
runs whose number differs from its own in digit r only, the digit of the digest
choosing the receiver, and the receiver merges the runs it gets. A digest has at
most one record in a run, so a group of copies shrinks in every round before it is
sent on, however many rows it has, and no task gets more than its share of
different digests. After the last round the number of a run is the digest modulo
the number of runs: all copies have met.

At every level records are merged only if digest and length in bytes agree, and the
record of the row to keep survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import as_bytes, binary_rows, give_back, kept

RECORD = "id long, digest binary, n_bytes long, run int, place long, group_size long, at int"
LEAF = "id long, tag long, digest binary, n_bytes long, run int, place long"
RADIX = 4


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: str = "largest",
    runs: int | None = None,
    tag: Column | None = None,
) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the `largest` (or `smallest`) key stays; a
    null key loses against any other; of rows that share the key as well exactly one
    stays. Other columns are not read. An empty table gives no rows.
    `runs` is the least number of runs; by default the number of shuffle partitions.
    `tag`, a number the caller tells rows by, is handed through as `tag` if given.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    spark = docs.sparkSession
    rounds, count = 1, RADIX
    while count < (runs or int(spark.conf.get("spark.sql.shuffle.partitions"))):
        rounds, count = rounds + 1, count * RADIX
    leaves = kept(
        docs.select(
            F.col(key).cast("long").alias("id"),
            (F.lit(None) if tag is None else tag).cast("long").alias("tag"),
            as_bytes(text).alias("text"),
        ).mapInArrow(_digests, LEAF),
        "dedup-leaves",
    )
    records = leaves.drop("tag").withColumn("group_size", F.lit(1).cast("long")).withColumn("at", F.col("run") % count)
    id_order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    for number in range(rounds):
        step = RADIX**number
        place = F.conv(F.right(F.hex("digest"), F.lit(8)), 16, 10).cast("long") % count
        own, wanted = (F.floor(x / step) % RADIX for x in (F.col("at"), place))
        receiver = (F.col("at") + (wanted - own) * step).cast("int")
        sent = _merged(records, id_order).withColumn("at", receiver)
        records = sent.repartitionById(count, F.col("at"))
    groups = kept(
        _merged(records, id_order).select(
            "digest",
            "n_bytes",
            F.col("id").alias("keep_id"),
            F.col("run").alias("keep_run"),
            F.col("place").alias("keep_place"),
            "group_size",
        ),
        "dedup-groups",
    )
    stays = (F.col("run") == F.col("keep_run")) & (F.col("place") == F.col("keep_place"))
    return leaves.join(groups, ["digest", "n_bytes"]).select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([] if tag is None else ["tag"]),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        digests = [hashlib.sha256(text.lower()).digest() for text in texts]
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch.column("id"),
                "tag": batch.column("tag"),
                "digest": pa.array(digests, pa.binary()),
                "n_bytes": pa.array([len(text) for text in texts], pa.int64()),
                "run": pa.array(np.full(len(texts), run, np.int32)),
                "place": pa.array(np.arange(place, place + len(texts))),
            }
        )
        place += len(texts)
        del texts
        give_back()


def _merged(records: DataFrame, id_order) -> DataFrame:
    """Each partition as one sorted run with one record per digest."""
    return records.sortWithinPartitions("digest", "n_bytes", id_order, "run", "place").mapInArrow(_merge, RECORD)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first record of equal neighbours with the sum of their counts; the last group waits for the next batch."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        digests = binary_rows(whole.column("digest"), 32)
        sizes = whole.column("n_bytes").to_numpy(zero_copy_only=False)
        new = (digests[1:] != digests[:-1]).any(axis=1) | (sizes[1:] != sizes[:-1])
        starts = np.flatnonzero(np.concatenate([[True], new]))
        counts = np.add.reduceat(whole.column("group_size").to_numpy(zero_copy_only=False), starts)
        place = whole.schema.get_field_index("group_size")
        merged = whole.take(pa.array(starts)).set_column(place, whole.schema.field(place), pa.array(counts))
        waiting = merged.slice(merged.num_rows - 1)
        yield merged.slice(0, merged.num_rows - 1)
    if waiting is not None:
        yield waiting
