"""A table that takes upserts: the newest row per key, in hash buckets, of which only touched ones are rewritten.

A version of the table is a manifest that names the folder of every bucket. An upsert
reads the buckets its keys fall into, writes them anew into folders of its own and then
writes the next manifest in one step. Files of other buckets stay as they are, and what
a reader or the upsert itself has opened is not touched.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsluice.operators.ordering import newest_per_key
from docsluice.session import fresh_path, hadoop_place, read_text, write_once

BUCKETS = 64


def upsert(spark: SparkSession, root: str, rows: DataFrame, key: str, ts: str = "ts_s", tie: str = "doc_id", buckets: int = BUCKETS) -> int:
    """Merges rows into the table at `root`: of each key the newest row by time and tie stays; gives the new version.

    `rows` may read from the table itself. The columns and, after the first upsert, the
    number of buckets are those of the table. Rows without a key, time or tie are left
    out. A second writer that has published the same version meanwhile is an error, and
    nothing of this upsert is seen.
    """
    before = _newest_manifest(spark, root)
    version, folders = (0, {}) if before is None else (before["version"], before["folders"])
    buckets = buckets if before is None else before["buckets"]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    usable = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(tie).isNotNull())
    # Written first: the rows are computed once, and from the version that stands now.
    arrived = fresh_path(spark, "upsert")
    newest_per_key(usable, key, ts, tie).withColumn("_bucket", bucket).write.parquet(arrived)
    fresh = spark.read.schema(usable.withColumn("_bucket", bucket).schema).parquet(arrived)
    touched = sorted(row["_bucket"] for row in fresh.select("_bucket").distinct().collect())
    merged = fresh
    old = [folders[str(number)] for number in touched if str(number) in folders]
    if old:
        stored = spark.read.schema(usable.schema).parquet(*[f"{root}/{folder}" for folder in old])
        merged = fresh.unionByName(stored.withColumn("_bucket", bucket))
    data = f"data/{version + 1:012d}"
    whole = newest_per_key(merged, key, ts, tie).repartition("_bucket")
    whole.write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/{data}")
    named = folders | {str(number): f"{data}/_bucket={number}" for number in touched}
    schema = usable.schema.json() if before is None else before["schema"]
    manifest = {"version": version + 1, "buckets": buckets, "schema": schema, "folders": named}
    if not write_once(spark, _manifest(root, version + 1), json.dumps(manifest)):
        raise RuntimeError(f"version {version + 1} of {root} was published by another writer")
    place, system = hadoop_place(spark, arrived)
    system.delete(place, True)
    return version + 1


def read_upserted(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the given one."""
    manifest = _newest_manifest(spark, root) if version is None else json.loads(read_text(spark, _manifest(root, version)))
    if manifest is None:
        raise ValueError(f"nothing has been upserted at {root}")
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    folders = [f"{root}/{folder}" for folder in dict.fromkeys(manifest["folders"].values())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def newest_version(spark: SparkSession, root: str) -> int:
    """The number of the newest version; 0 if nothing has been upserted yet."""
    return max(_versions(spark, root), default=0)


def files_of(spark: SparkSession, root: str, version: int) -> dict[int, str]:
    """Where each bucket of a version lies."""
    return {int(number): folder for number, folder in json.loads(read_text(spark, _manifest(root, version)))["folders"].items()}


def forget_before(spark: SparkSession, root: str, version: int) -> None:
    """Deletes the folders and manifests that only versions before the given one name."""
    wanted, names = set(), _versions(spark, root)
    for number in names:
        if number >= version:
            wanted |= set(files_of(spark, root, number).values())
    for number in names:
        if number < version:
            for folder in set(files_of(spark, root, number).values()) - wanted:
                place, system = hadoop_place(spark, f"{root}/{folder}")
                system.delete(place, True)
            place, system = hadoop_place(spark, _manifest(root, number))
            system.delete(place, False)


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifest/{version:012d}.json"


def _versions(spark: SparkSession, root: str) -> list[int]:
    place, system = hadoop_place(spark, f"{root}/manifest")
    names = [entry.getPath().getName() for entry in system.listStatus(place)] if system.exists(place) else []
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith("."))


def _newest_manifest(spark: SparkSession, root: str) -> dict | None:
    known = _versions(spark, root)
    return json.loads(read_text(spark, _manifest(root, known[-1]))) if known else None
