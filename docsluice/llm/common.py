"""What the operators for training data share: tables kept between steps, texts as bytes, state of a worker."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.session import fresh_path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, read by column, safe when executors are lost."""
    path = fresh_path(df.sparkSession, name)
    for paths in _NOTED:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Lists that note the tables kept from now on.
_NOTED: list[list[str]] = []


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Adds the tables that are kept inside to the list."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.pop()


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes kept tables that no frame needs any more and empties the list."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def as_bytes(text: str | Column) -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b""))


def once_per_worker(name: str, make: Callable[[], Any]) -> Any:
    """A value made once in a Python worker and shared by all tasks that run in it."""
    store = sys.__dict__.setdefault("_docsluice_worker", {})
    if name not in store:
        store[name] = make()
    return store[name]


def give_back() -> None:
    """Returns memory that is no longer used to the system: a worker outlives its tasks, and other workers need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def binary_rows(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long binaries, none null, as a matrix of bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[first : first + len(column) * width].reshape(-1, width)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose binary column holds about `most` bytes, at least one row each."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > first and total + size > most:
            yield batch.slice(first, row - first)
            first, total = row, 0
        total += size
    if batch.num_rows > first:
        yield batch.slice(first)
    give_back()


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column one after the other, and where each row starts (one entry more than rows)."""
    values = column.to_pylist()
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(x) for x in values], out=starts[1:])
    return np.frombuffer(b"".join(values), np.uint8), starts
