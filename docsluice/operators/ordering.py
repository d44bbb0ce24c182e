"""Order-dependent work cut into chunks of bounded size.

A window over one key runs in one task, whatever the key holds. Here the rows
are range-partitioned by their full order and cut into chunks of at most
`rows_per_chunk` rows; totals per chunk, a small table, link the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.session import reliable

ROWS_PER_CHUNK = 200_000
ROWS_IN_PARTITION = (1 << 33) - 1


def in_chunks(df: DataFrame, order: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Adds `chunk` (increasing along the order) and `chunk_row` (0, 1, ... inside the chunk).

    `order` must be total. The result is kept in the shared folder, because two
    computations of a range partitioning may cut at different rows.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition in its upper and the position inside it in its lower 33 bits.
    placed = ordered.withColumn("_place", F.monotonically_increasing_id())
    row = F.col("_place").bitwiseAND(F.lit(ROWS_IN_PARTITION)) % F.lit(rows_per_chunk)
    return reliable(placed.withColumn("chunk_row", row).withColumn("chunk", F.col("_place") - row).drop("_place"))


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    amounts: dict[str, Column],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Adds for each amount its total over the earlier rows of the same group."""
    named = df.withColumns({f"_amount_{name}": amount.cast("long") for name, amount in amounts.items()})
    chunks = in_chunks(named, [*group, *order], rows_per_chunk)
    earlier_chunks = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunks.groupBy(*group, "chunk")
        .agg(*[F.sum(f"_amount_{name}").alias(f"_amount_{name}") for name in amounts])
        .select(
            *group,
            "chunk",
            *[_total(f"_amount_{name}", earlier_chunks).alias(f"_before_{name}") for name in amounts],
        )
    )
    earlier_rows = Window.partitionBy(*group, "chunk").orderBy("chunk_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunks.join(offsets, [*group, "chunk"])
        .withColumns(
            {name: F.col(f"_before_{name}") + _total(f"_amount_{name}", earlier_rows) for name in amounts}
        )
        .select(*df.columns, *amounts)
    )


def _total(column: str, window: Window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0).cast("long"))


def newest(df: DataFrame, n: int, ts: str = "ts_s", key: str = "doc_id") -> DataFrame:
    """The last n rows by arrival; each task keeps only n rows."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def newest_per_key(df: DataFrame, key: str, ts: str = "ts_s", tie: str = "doc_id") -> DataFrame:
    """The newest row of each key; of rows alike in key, time and tie one.

    Only key, time and tie are reduced, before the shuffle, so that a key with many
    copies stays cheap and no row is sorted by what else it holds.
    """
    last = df.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(ts, tie)).alias("_last"))
    own = F.struct(F.col(ts), F.col(tie))
    found = df.join(last, F.col(key).eqNullSafe(F.col("_key")) & own.eqNullSafe(F.col("_last")))
    return found.select(*df.columns).dropDuplicates([key])
