"""Reading and writing of result, feedback, example, ground-truth and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsluice.operators.feedback import upsert_ground_truth
from docsluice.operators.ordering import newest
from docsluice.schema import EXAMPLE_TYPE, FEEDBACK_TYPE, GROUND_TRUTH_TYPE, LABELLED_NAMES_TYPE
from docsluice.sources.json_items import json_items
from docsluice.sources.upserts import BUCKETS, read_upserted, upsert

BAD_LINE = "_bad_line"


def read_labelled_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED_NAMES_TYPE).option("header", True).csv(path)


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    results.write.mode(mode).json(path)


def append_feedback(log: DataFrame, path: str) -> None:
    """Adds rows of the feedback schema to the log, one JSON object per line."""
    log.write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The performance feedback in the log; lines that cannot be read are skipped.

    `limit` takes the lines that were appended first, whatever they hold: appends in
    the order of their files' times, then of file and line. None or 0 means all.
    """
    lines = spark.read.text(path).select("value", "_metadata")
    if limit:
        place = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", "_line"]
        lines = lines.withColumn("_line", F.monotonically_increasing_id()).orderBy(*place).limit(limit)
    schema = T.StructType([*FEEDBACK_TYPE.fields, T.StructField(BAD_LINE, T.StringType())])
    parsed = lines.select(
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}).alias("row")
    ).select("row.*")
    usable = (
        F.col(BAD_LINE).isNull()
        & (F.col("type") == "performance_feedback")
        & F.col("routing_decision").isin("ML", "LLM")
        & F.col("features").isNotNull()
    )
    return _with_defaults(parsed.filter(usable).select(*EXAMPLE_TYPE.fieldNames()))


def read_feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """All readable lines of the log, of every type."""
    schema = T.StructType([*FEEDBACK_TYPE.fields, T.StructField(BAD_LINE, T.StringType())])
    lines = spark.read.text(path).select(
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}).alias("row")
    )
    return lines.select("row.*").filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").json(path)


def read_examples(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Training examples, one JSON object per line, or (`whole_file`) files that hold one JSON array each.

    Such files are read by many tasks each; elements that are no objects are left out.
    """
    if not whole_file:
        return _with_defaults(spark.read.schema(EXAMPLE_TYPE).json(path))
    items = json_items(spark, path).filter(F.col("item").rlike(r"^\s*\{"))
    return _with_defaults(items.select(F.from_json("item", EXAMPLE_TYPE).alias("row")).select("row.*"))


def _with_defaults(examples: DataFrame) -> DataFrame:
    return examples.fillna({"ml_confidence": 0.5, "cost_ml": 0.001, "cost_llm": 0.01})


def write_ground_truth(path: str, *versions: DataFrame) -> None:
    """Replaces the table at `path` by the newest row of each content; `versions` must not read from it."""
    upsert_ground_truth(*versions).write.mode("overwrite").parquet(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_ground_truth(spark: SparkSession, path: str, rows: DataFrame, buckets: int = BUCKETS) -> int:
    """Merges ground truth into a table of hash buckets, rewriting only those it falls into; `rows` may read from the table."""
    return upsert(spark, path, rows, "content_hash", buckets=buckets)


def read_merged_ground_truth(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return read_upserted(spark, path, version)


def import_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Rows (content_hash, ...) from files that hold one JSON object keyed by content hash, read by many tasks each."""
    shape = T.MapType(T.StringType(), GROUND_TRUTH_TYPE)
    entry = F.concat(F.lit("{"), "item", F.lit("}"))
    rows = json_items(spark, path).select(F.explode(F.from_json(entry, shape)).alias("content_hash", "row"))
    filled = rows.select("content_hash", "row.*").fillna({"confidence_score": 1.0, "source": "unknown"})
    return filled.filter(F.col("true_category").isNotNull())


def write_history(history: DataFrame, path: str, keep: int | None = None) -> None:
    """Replaces the stored history by the newest `keep` rows, or by all."""
    rows = history if keep is None else newest(history, keep)
    rows.write.mode("overwrite").parquet(path)


def read_history(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    history = spark.read.parquet(path)
    return history if keep is None else newest(history, keep)
