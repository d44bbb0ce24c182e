"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docsluice")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="docsluice-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """A summary for a join, computed once; broadcast only if its stored size has proved to be small."""
    path = fresh_path(df.sparkSession, "summary")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(kept) if stored_bytes(df.sparkSession, path) <= most_bytes else kept


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Sets the size of the session's Arrow batches, unless it is smaller already."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if sizes.byteStringAsBytes(spark.conf.get(setting, "64m")) > most_bytes:
        spark.conf.set(setting, f"{most_bytes}b")


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: pa.Schema) -> DataFrame:
    """Rows of the driver as a frame. As Arrow data they need no Python workers, which executors would keep besides those of queries."""
    rows = list(rows)
    columns = [pa.array([row[place] for row in rows], kind.type) for place, kind in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at a path; any other trouble with it is an error."""
    place, system = hadoop_place(spark, path)
    return system.exists(place)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of what is stored under a path."""
    place, system = hadoop_place(spark, path)
    return system.getContentSummary(place).getLength()


def found_at(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """What a path or wildcard names: (path, whether it is a folder)."""
    place, system = hadoop_place(spark, path)
    return [(entry.getPath().toString(), entry.isDirectory()) for entry in system.globStatus(place) or []]


def hadoop_place(spark: SparkSession, path: str):
    """A path and the file system it lies in, as the cluster knows them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file in one step, under another name first; false if the path is taken, which then stays as it is."""
    place, system = hadoop_place(spark, path)
    if system.exists(place):
        return False
    draft, _ = hadoop_place(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = system.create(draft)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if system.rename(draft, place):
        return True
    system.delete(draft, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    place, system = hadoop_place(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
