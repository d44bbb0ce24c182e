"""The corpus pipeline: documents go through the operators for training data, stage by stage.

Every stage works on all rows the one before it kept and is written as Parquet before
the next one reads it. Stages take (spark, docs, folder) and return the columns of
documents; the last returns its own result. Rows are told by a hash of all their
columns, so null or repeated keys do no harm: a stage decides how often each row goes
on, and rows that are alike in every column share what is decided for them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.llm import langid
from docsluice.llm.common import forget, kept, noted
from docsluice.llm.exact_dedup import exact_dedup
from docsluice.llm.mixing import mix_sources
from docsluice.llm.packing import pack
from docsluice.llm.simhash import SIMILAR, near_duplicates
from docsluice.session import bounded


def row_tag(docs: DataFrame) -> Column:
    """A number for the row from all its columns, nulls included."""
    return F.xxhash64(*[part for name in docs.columns for part in (F.col(name), F.col(name).isNull())])


def follow(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs, each as often as `decided` (tag, times; a row per row of docs) says.

    Rows that go on once stay where they are; only the tags of rows that are dropped or
    repeated are looked up, without moving any text as long as they prove small.
    """
    sums = decided.groupBy(F.col("tag").alias("_tag")).agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    sums = kept(sums.filter("n <> times").withColumn("times", F.col("times").cast("int")), "pipeline-decided")
    tagged = docs.withColumn("_tag", row_tag(docs))
    result = tagged.join(bounded(sums.select("_tag")), "_tag", "left_anti")
    again = sums.filter("times > 0")
    single, several = again.filter("n = 1"), again.filter("n > 1")
    parts = [] if single.isEmpty() else [tagged.join(bounded(single), "_tag")]
    if not several.isEmpty():
        parts.append(tagged.join(bounded(several), "_tag").dropDuplicates(["_tag"]))
    for part in parts:
        repeated = part.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times")))
        result = result.unionByName(repeated.select(*result.columns))
    return result.select(*docs.columns)


# Tables that the stage before has left in the shared folder.
LEFT: list[str] = []


# Texts go to the Python workers in Arrow batches of about so many bytes. The JVM and the worker hold a batch each, and
# the JVM does not give back what its largest batches took, so this bounds what all stages together take from an executor.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches of the session, unless it is smaller already."""
    sizes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if sizes.byteStringAsBytes(spark.conf.get(BATCH, "64m")) > BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def stage(function):
    """A stage that clears away what the one before it kept: its result has been written, as it is read here."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        forget(spark, LEFT)
        with noted(LEFT):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: declared language and source stand in for markup and host."""
    model = langid.train(docs)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(
        row_tag(docs).alias("id"),
        F.col("text"),
        F.lower(F.trim("lang")).alias("declared"),
        F.struct(source.alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix")).alias("place"),
    )
    found = langid.identify(rows, model)
    return follow(docs, found.select(F.col("id").alias("tag"), F.col("accepted").cast("int").alias("times")))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    found = exact_dedup(docs, tag=row_tag(docs))
    return follow(docs, found.select("tag", F.col("kept").cast("int").alias("times")))


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their five-word shingles, the one with the smallest doc_id."""
    found = near_duplicates(docs, scheme=SIMILAR, tag=row_tag(docs), complete=True)
    # Of rows that are alike one stays: the first copy counts, the others do not.
    first = F.col("tag") == F.col("first_tag")
    counted = kept(found.select("tag", first.alias("first")), "pipeline-near")
    share = counted.groupBy("tag", "first").agg(F.count("*").alias("n"))
    times = share.select("tag", F.when(F.col("first"), 1).otherwise(0).alias("times"), "n")
    rows = times.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return follow(docs, rows.select("tag", F.when(F.col("place") == 1, F.col("times")).otherwise(0).alias("times")))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions 5, 2, 1 in turn; a document goes on as often as the mix takes it, at most three times."""
    chosen, _ = mix_sources(docs, F.array("source"), tag=row_tag(docs))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return follow(docs, chosen.select("tag", times.alias("times")))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, every one in the proportions of the sources that are left."""
    pieces = pack(docs).withColumn("ids_crc32", F.crc32("ids"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix_sources", mix),
    ("pack", packed),
]

# Language models, fingerprints and tokenizers have no SQL form; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = kept(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
