"""Samples and train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsluice.operators.ordering import running_totals
from docsluice.session import bounded


def _shuffled_key(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def sample_n(df: DataFrame, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """n rows without replacement, the same in every run."""
    return df.orderBy(_shuffled_key(key, seed), key).limit(n)


def head_n(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "doc_id", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds `split`: exactly round(test_share * rows) rows of each label are `test`.

    Per label the cut is found from counts over hash prefixes and, inside the one
    prefix that straddles it, from its few rows; rows are then compared with the
    cut where they are. No label is ever gathered in one place.
    """
    # A null label is a label; the struct compares like any value in joins.
    own = F.struct(F.col(label).isNull().alias("none"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("name"))
    rows = df.withColumn("_label", own).withColumn("_hash", _shuffled_key(key, seed))
    rows, label = rows.withColumn("_prefix", F.left("_hash", F.lit(4))), "_label"
    counts = rows.groupBy(label, "_prefix").agg(F.count("*").alias("_n"))
    by_prefix = Window.partitionBy(label).orderBy("_prefix")
    wanted = F.round(F.sum("_n").over(Window.partitionBy(label)) * F.lit(test_share)).cast("long")
    straddling = (
        counts.select(
            label, "_prefix", "_n", F.sum("_n").over(by_prefix).alias("_upto"), wanted.alias("_wanted")
        )
        .filter((F.col("_wanted") > F.col("_upto") - F.col("_n")) & (F.col("_wanted") <= F.col("_upto")))
        .select(label, "_prefix", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    in_prefix = Window.partitionBy(label, "_prefix").orderBy("_hash", key)
    cuts = (
        rows.select(label, "_prefix", "_hash", key)
        .join(straddling, [label, "_prefix"])
        .withColumn("_rank", F.row_number().over(in_prefix))
        .filter(F.col("_rank") == F.col("_left"))
        .select(label, F.struct("_hash", key).alias("_cut"))
    )
    split = F.when(F.struct("_hash", key) <= F.col("_cut"), "test").otherwise("train")
    return rows.join(bounded(cuts), label, "left").withColumn("split", split).select(*df.columns, "split")


def hash_split(df: DataFrame, key: str = "doc_id", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split` from the key alone: no shuffle, shares only approximately met."""
    place = F.conv(F.left(_shuffled_key(key, seed), F.lit(8)), 16, 10).cast("long")
    return df.withColumn("split", F.when(place < int(test_share * 2**32), "test").otherwise("train"))


def ordered_split(
    df: DataFrame, order: list[str], train_share: float = 0.8, rows_per_chunk: int = 200_000
) -> DataFrame:
    """Adds `split`: the first floor(train_share * rows) rows of the order are `train`."""
    cut = int(df.count() * train_share)
    ranked = running_totals(df, [], order, {"_earlier": F.lit(1)}, rows_per_chunk)
    split = F.when(F.col("_earlier") < cut, "train").otherwise("validation")
    return ranked.withColumn("split", split).select(*df.columns, "split")
