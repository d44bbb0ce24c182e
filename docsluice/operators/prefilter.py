"""A filter by keys that needs no shuffle of the filtered rows.

A blocked Bloom filter as rows: a key chooses one bitmap and sets four bits in it. There
are so many bitmaps that a key has 16 bits, whatever the number of keys, so about one
key in four hundred is let through by accident.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.session import reliable

# Spark's bitmaps have 4,096 bytes.
BITMAP_BITS, BITMAP_BYTES = 1 << 15, 1 << 12
BITS_PER_KEY, PROBES = 16, 4
# Bitmaps of so many bytes in all are broadcast at a time: the keys of 33 million rows.
BROADCAST_BYTES = 64 << 20
# Rows are scanned at most so many times, whatever the number of keys.
SCANS = 8


def likely_among(rows: DataFrame, keys: DataFrame, key: str = "doc_id", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose key is among the keys, and less than one in a hundred of the others.

    For rows with large columns, in front of the join that decides: what it leaves out
    is not moved. `keys` is read twice. Bitmaps of more than `most_bytes` are met in
    blocks of that size, each by a scan of its own over the rows, which keeps those that
    fall into it; no row falls into two blocks. Where that took more than SCANS scans, rows
    are moved to their bitmaps instead, once. Null keys are never among the keys.
    """
    count = keys.count()
    buckets = max(1, -(-count * BITS_PER_KEY // BITMAP_BITS))
    set_bits = keys.select(_bucket(key, buckets).alias("__filter_bucket"), F.explode(F.array(*_places(key))).alias("place"))
    bitmaps = reliable(set_bits.groupBy("__filter_bucket").agg(F.bitmap_construct_agg("place").alias("__filter_bits")))
    step = max(1, most_bytes // BITMAP_BYTES)
    marked = rows.filter(F.col(key).isNotNull()).withColumn("__filter_bucket", _bucket(key, buckets))
    hit = reduce(Column.__and__, [_bit("__filter_bits", place) for place in _places(key)])
    if buckets > step * SCANS:
        return marked.join(bitmaps.hint("merge"), "__filter_bucket").filter(hit).select(*rows.columns)
    found = []
    for first in range(0, buckets, step):
        # Not more than `step` bitmaps, hence a bounded broadcast.
        inside = F.col("__filter_bucket").between(first, first + step - 1)
        one, part = (bitmaps, marked) if step >= buckets else (bitmaps.filter(inside), marked.filter(inside))
        met = part.join(F.broadcast(one), "__filter_bucket")
        found.append(met.filter(hit).select(*rows.columns))
    return reduce(DataFrame.unionByName, found)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _places(key: str) -> list[Column]:
    """Four places in a bitmap, from 15 bits each of a hash that the choice of the bitmap does not use."""
    other = F.xxhash64(key, F.lit("place"))
    return [F.shiftrightunsigned(other, 15 * probe).bitwiseAND(F.lit(BITMAP_BITS - 1)) for probe in range(PROBES)]


def _bit(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (place % 8).cast("int")) == 1
