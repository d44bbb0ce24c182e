"""The router and its statistics on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from docsluice.config import RoutingConfig
from docsluice.functions.results import cost_mills
from docsluice.operators.confidence import predict_confidence, train_confidence
from docsluice.operators.feedback import FIRST_UPDATE, RETRAIN_FROM, UPDATE_STEP, threshold_path
from docsluice.operators.routing import DECISION_SCHEMA, decide_batches, hour_of, route_under_budget
from docsluice.sources.registry import load_predictor, publish, published
from docsluice.sources.upserts import newest_version, read_upserted, upsert

# What a stored update point says besides its place and the threshold; null where a batch passed none.
EVIDENCE = ("rows", "judged", "correct", "ml_mistakes", "llm_mistakes")

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_usage(routes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Counts and cost per hour of a stream with event time `ts`; an hour comes out once it is over."""
    return (
        routes.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 hour"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("decision") == "LLM").alias("llm_count"),
            F.sum(cost_mills(F.col("decision"))).alias("cost_mills"),
        )
        .select(F.unix_timestamp(F.col("window.start")).alias("hour_s"), "total", "llm_count", "cost_mills")
    )


class HourBudget(StatefulProcessor):
    """Keeps the counters of one hour between micro-batches."""

    def __init__(self, config: RoutingConfig, keep_ms: int | None) -> None:
        self.config = config
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        counters = StructType([StructField("total", LongType()), StructField("llm", LongType())])
        self.counters = handle.getValueState("counters", counters, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self.decide(pd.concat(list(rows)))

    def decide(self, arrived: pd.DataFrame) -> pd.DataFrame:
        """Decisions for rows of the hour, after all earlier ones."""
        arrived = arrived.sort_values(["ts_s", "doc_id"])
        total, llm = self.counters.get() if self.counters.exists() else (0, 0)
        decided = next(decide_batches([arrived.assign(chunk=0, start_total=total, start_llm=llm)], self.config))
        costly = int((decided["decision"] == "LLM").sum())
        self.counters.update((int(total) + len(decided), int(llm) + costly))
        return decided

    def close(self) -> None:
        pass


class WaitingHourBudget(HourBudget):
    """Holds rows back until the watermark has passed them, and decides them in order of time and id."""

    COLUMNS = ("doc_id", "ts_s", "predicted", "load", "forced", "hour_s")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        kinds = (LongType(), LongType(), DoubleType(), DoubleType(), StringType(), LongType())
        self.waiting = handle.getListState("waiting", StructType([StructField(*column) for column in zip(self.COLUMNS, kinds)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([batch[list(self.COLUMNS)] for batch in rows])
        yield from self.release(arrived, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.release(None, timerValues.getCurrentWatermarkInMs())

    def release(self, arrived: pd.DataFrame | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=list(self.COLUMNS))
        if arrived is not None:
            held = pd.concat([held, arrived]) if len(held) else arrived
        # Rows at the watermark itself may still have company on its way.
        due = held["ts_s"].astype("int64") * 1000 < watermark_ms
        rest = held[~due]
        self.waiting.clear()
        if len(rest):
            plain = rest.astype(object).where(rest.notna(), None)
            self.waiting.put([(int(i), int(t), float(p), float(l), f, int(h)) for i, t, p, l, f, h in plain.itertuples(index=False)])
            self.handle.registerTimer(int(rest["ts_s"].min()) * 1000 + 1)
        if due.any():
            yield self.decide(held[due])


def stream_routes_in_order(rows: DataFrame, config: RoutingConfig, delay: str = "10 minutes", keep_hours: int | None = None) -> DataFrame:
    """Decisions for a stream of rows (doc_id, ts_s, predicted, load, forced) that come in any order within the delay.

    Rows wait in the state of their hour until the watermark, the newest time seen less
    the delay, has passed them, and are then decided in the order of time and id: the
    decisions are those of the batch router over all rows, however batches mix them. The
    rows of the newest `delay` stay held back until later rows come. Rows that come
    later than the delay are dropped by the watermark (`numRowsDroppedByWatermark`);
    where none may be lost, use `stream_routes` or `routing_sink`. Needs the RocksDB
    state store; start inside `state_store(spark, idle_batches=True)`.
    """
    timed = _slim(rows).withColumn("ts", F.timestamp_seconds("ts_s")).withWatermark("ts", delay)
    return timed.groupBy("hour_s").transformWithStateInPandas(
        statefulProcessor=WaitingHourBudget(config, None if keep_hours is None else keep_hours * 3_600_000),
        outputStructType=DECISION_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_routes(rows: DataFrame, config: RoutingConfig, keep_hours: int | None = None) -> DataFrame:
    """Decisions for a stream of rows (doc_id, ts_s, predicted, load, forced).

    Needs the RocksDB state store. The counters of an hour, two numbers, are kept for
    good, or for `keep_hours` of processing time if it is certain that no row comes
    later than that. What one hour brings in a micro-batch is handled by one task, so
    a source without a rate limit belongs to `routing_sink`.
    """
    return _slim(rows).groupBy("hour_s").transformWithStateInPandas(
        statefulProcessor=HourBudget(config, None if keep_hours is None else keep_hours * 3_600_000),
        outputStructType=DECISION_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "ts_s",
        "predicted",
        F.coalesce(F.col("load"), F.lit(0.0)).alias("load"),
        F.col("forced").cast("string").alias("forced"),
        hour_of(F.col("ts_s")).alias("hour_s"),
    )


@contextmanager
def state_store(spark: SparkSession, idle_batches: bool = False) -> Iterator[None]:
    """Stateful queries started inside keep their state in RocksDB and run only when there is data, or also (`idle_batches`) when only the watermark has moved."""
    settings = {STATE_STORE: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is available now to a parquet table and stops."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch has a folder of its own, so that a repeated one replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _keep(batch: DataFrame, batch_id: int, path: str, wanted: int) -> tuple[SparkSession, list[tuple[int, int]], int, int]:
    """Stores a micro-batch; gives the batches that hold the newest `wanted` rows, rows before it and rows now.

    The sizes stored with a batch name all earlier batches that are still needed and
    the number of all rows, so that only the sizes of the batch before are read.
    """
    session = batch.sparkSession
    batch_sink(f"{path}/rows")(batch, batch_id)
    n = session.read.parquet(f"{path}/rows/batch={batch_id}").count()
    known, before = [], 0
    if batch_id > 0:
        stored = session.read.parquet(f"{path}/sizes/batch={batch_id - 1}").orderBy(F.col("of").desc()).collect()
        known, before = [(row["of"], row["n"]) for row in stored if row["n"]], max(row["total"] for row in stored)
    needed, missing = [], wanted
    for of, size in [(batch_id, n), *known]:
        if missing > 0 and size:
            needed.append((of, size))
            missing -= size
    # The batch itself is always named, for the total; empty batches are not.
    listed = [(of, size, before + n) for of, size in needed] or [(batch_id, 0, before + n)]
    sizes = session.createDataFrame(listed, "of long, n long, total long").coalesce(1)
    batch_sink(f"{path}/sizes")(sizes, batch_id)
    return session, needed, before, before + n


def _recent(spark: SparkSession, path: str, needed: list[tuple[int, int]], n: int, ts: str) -> DataFrame:
    """The newest n rows with their `batch`; only the folders that hold them are listed and read."""
    folders = [f"{path}/rows/batch={of}" for of, _ in needed]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*folders)
    return rows.orderBy(F.col("batch").desc(), F.col(ts).desc(), F.col("doc_id").desc()).limit(n)


def learning_sink(
    feedback_path: str,
    state_path: str,
    config: RoutingConfig,
    start: float,
    registry: str | None = None,
    iterations: int = 100,
    depth: int = 6,
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: stores feedback, and the threshold after every update point a batch passes.

    Rows of a batch count in the order of time, so batches in that order give the same
    thresholds however they are cut. Each batch stores its points, the last of which
    (or the threshold it found) the next one starts from; the result is a function of
    the stored batches up to it, so a repeated batch gives the same rows again. With
    `registry` batch n publishes version n + 1 there if it moved the threshold or trained
    the confidence predictor anew, which it does on the newest rows whenever a point
    calls for it, once per batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The rows before the batch that its points look back to, and the batch itself.
        session, needed, before, now = _keep(batch, batch_id, feedback_path, config.feedback_buffer)
        current = start
        if batch_id > 0:
            state = session.read.parquet(f"{state_path}/batch={batch_id - 1}")
            current = state.orderBy(F.col("arrived").desc()).limit(1).collect()[0].threshold
        nothing = session.createDataFrame([(before, current)], "arrived long, threshold double").select(
            *[F.lit(None).cast("long").alias(name) for name in EVIDENCE], "arrived", "threshold"
        )
        if not passes_update_point(before, now, config.feedback_buffer):
            batch_sink(state_path)(nothing, batch_id)
            return
        here = session.read.parquet(f"{feedback_path}/rows/batch={batch_id}").withColumn("batch", F.lit(batch_id))
        rows, earlier = here, before
        older = [(of, size) for of, size in _look_back(session, feedback_path, batch_id) if of < batch_id]
        if older:
            kept = _recent(session, feedback_path, older, config.feedback_buffer, "timestamp")
            rows, earlier = here.unionByName(kept), before - min(config.feedback_buffer, sum(size for _, size in older))
        path = threshold_path(rows, current, config, ["batch", "timestamp", "doc_id"], earlier, moved_from=before)
        points = path.drop("batch", "timestamp", "doc_id")
        batch_sink(state_path)(nothing.unionByName(points).coalesce(1), batch_id)
        if registry is None:
            return
        model = None
        if now >= RETRAIN_FROM:
            recent = _recent(session, feedback_path, needed, config.feedback_buffer, "timestamp")
            model = train_confidence(recent, ["timestamp", "doc_id"], iterations, depth)
        state = session.read.parquet(f"{state_path}/batch={batch_id}")
        moved = state.orderBy(F.col("arrived").desc()).limit(1).collect()[0].threshold
        if model is not None or moved != current:
            publish(session, registry, batch_id + 1, moved, model)

    return write


def _look_back(spark: SparkSession, path: str, batch_id: int) -> list[tuple[int, int]]:
    """The earlier batches that held the newest rows before this one."""
    if batch_id == 0:
        return []
    return [(row["of"], row["n"]) for row in spark.read.parquet(f"{path}/sizes/batch={batch_id - 1}").collect() if row["n"]]


def stats_sink(
    history_path: str, stats_path: str, statistics: Callable[[DataFrame], DataFrame], recent: int, ts: str = "ts_s"
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: stores history, and the statistics of its newest rows with the number of all."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session, needed, _, now = _keep(batch, batch_id, history_path, recent)
        if not needed:
            return
        tail = _recent(session, history_path, needed, recent, ts).drop("batch")
        batch_sink(stats_path)(statistics(tail).withColumn("total", F.lit(now)), batch_id)

    return write


def usage_sink(root: str, delay_s: int = 600, buckets: int = 8) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over rows (ts_s, decision, ...): usage per hour that late rows correct.

    An hour is closed once the newest time of the batches before is `delay_s` past its
    end. Rows of closed hours are kept in `root`/late, by batch, and counted all the same:
    batch n publishes version n + 1 of the hourly table at `root`/usage, in which the hours
    it touched are replaced, so that earlier versions still say what was known then.
    `late` is the number of an hour's rows that came after it had closed, `corrections`
    the number of batches that brought them. The newest version equals `hourly_usage` over
    all rows, however late and in whatever order; a batch is counted once, also when it
    is repeated. Rows without a time are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if newest_version(session, f"{root}/usage") > batch_id:
            return
        newest = None
        if batch_id > 0:
            newest = session.read.parquet(f"{root}/marks/batch={batch_id - 1}").head()["newest"]
        timed = batch.filter("ts_s IS NOT NULL").withColumn("hour_s", hour_of(F.col("ts_s")))
        is_late = F.lit(False) if newest is None else F.col("hour_s") + 3600 <= F.lit(newest - delay_s)
        hours = timed.groupBy("hour_s").agg(
            F.count("*").alias("total"),
            F.count_if(F.col("decision") == "LLM").alias("llm_count"),
            F.sum(cost_mills(F.col("decision"))).cast("long").alias("cost_mills"),
            F.max("ts_s").alias("newest"),
        )
        batch_sink(f"{root}/hours")(hours.withColumn("is_late", is_late), batch_id)
        hours = session.read.schema("hour_s long, total long, llm_count long, cost_mills long, newest long, is_late boolean").parquet(
            f"{root}/hours/batch={batch_id}"
        )
        found = hours.agg(F.max("newest").alias("newest"), F.coalesce(F.bool_or("is_late"), F.lit(False)).alias("any_late")).head()
        if found["any_late"]:
            batch_sink(f"{root}/late")(timed.filter(is_late), batch_id)
        known = [time for time in (newest, found["newest"]) if time is not None]
        mark = session.createDataFrame([(max(known, default=None),)], "newest long").coalesce(1)
        batch_sink(f"{root}/marks")(mark, batch_id)
        changed = hours.select(
            "hour_s", "total", "llm_count", "cost_mills",
            F.when(F.col("is_late"), F.col("total")).otherwise(0).cast("long").alias("late"),
            F.col("is_late").cast("long").alias("corrections"),
        )
        if batch_id > 0:
            before = read_upserted(session, f"{root}/usage", batch_id).drop("revision")
            touched = before.join(hours.select("hour_s"), "hour_s", "left_semi")
            sums = [F.sum(name).alias(name) for name in changed.columns[1:]]
            changed = changed.unionByName(touched).groupBy("hour_s").agg(*sums)
        upsert(session, f"{root}/usage", changed.withColumn("revision", F.lit(batch_id).cast("long")), "hour_s", "revision", "hour_s", buckets)

    return write


def read_usage(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The hourly table of `usage_sink`, as its newest version or the given one says."""
    usage = read_upserted(spark, f"{root}/usage", version)
    return usage.withColumn("llm_ratio", F.try_divide("llm_count", "total"))


def passes_update_point(earlier: int, now: int, buffer: int = RoutingConfig.feedback_buffer) -> bool:
    """Does the feedback counter meet an update point on its way from `earlier` to `now`?

    Once the buffer is full every row does, if the size of the buffer is a multiple of the step.
    """
    if now <= earlier or now < FIRST_UPDATE:
        return False
    full = buffer >= FIRST_UPDATE and buffer % UPDATE_STEP == 0
    if now > buffer:
        return full or min(earlier, buffer) // UPDATE_STEP < buffer // UPDATE_STEP
    return now // UPDATE_STEP > max(earlier, FIRST_UPDATE - 1) // UPDATE_STEP


def routing_sink(
    path: str, state_path: str, config: RoutingConfig, learned: Callable[[SparkSession], RoutingConfig] | None = None
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch router on each micro-batch, with the counters of earlier ones.

    An hour of any size is spread over tasks, as in the batch router. Every batch
    stores the decisions and the counters of all hours so far, a row per hour, so that
    the next one reads a small table of one folder and no replay, however old its
    rows, starts an hour's budget anew. `learned` gives the configuration of the next
    batch, with the threshold learned so far.
    """
    store, store_state = batch_sink(path), batch_sink(state_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        counters = None
        if batch_id > 0:
            counters = session.read.parquet(f"{state_path}/batch={batch_id - 1}")
        store(route_under_budget(batch, config if learned is None else learned(session), counters), batch_id)
        decided = session.read.parquet(f"{path}/batch={batch_id}")
        after = decided.groupBy("hour_s").agg(
            (F.max("earlier") + 1).alias("total"),
            (F.min("earlier_llm") + F.count_if(F.col("decision") == "LLM")).alias("llm"),
        )
        if counters is not None:
            # Counters only grow, so the larger ones are the later ones.
            after = after.unionByName(counters).groupBy("hour_s").agg(
                F.max("total").alias("total"), F.max("llm").alias("llm")
            )
        store_state(after.coalesce(1), batch_id)

    return write


def learning_router_sink(
    root: str,
    config: RoutingConfig,
    judge: Callable[[DataFrame, DataFrame], DataFrame],
    iterations: int = 100,
    depth: int = 6,
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: routes each micro-batch by what the batches before it taught, and learns from it.

    Rows are (doc_id, ts_s, load, forced, features). Batch n forecasts with the predictor
    and routes with the threshold of the newest published version not above n, that is,
    of the batches before it, also when it is repeated after they went on. `judge` makes
    feedback (as `learning_sink` stores it) of the rows of the batch and their decisions.
    Under `root`: `routes`, `counters`, `feedback`, `thresholds` and the `registry`.
    """
    registry = f"{root}/registry"
    learn = learning_sink(f"{root}/feedback", f"{root}/thresholds", config, config.base_threshold, registry, iterations, depth)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        entry = published(session, registry, batch_id)
        known = config if entry is None else replace(config, base_threshold=entry.threshold)
        forecast = predict_confidence(batch, load_predictor(session, registry, entry))
        routing_sink(f"{root}/routes", f"{root}/counters", known)(forecast, batch_id)
        learn(judge(batch, session.read.parquet(f"{root}/routes/batch={batch_id}")), batch_id)

    return write


def run_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
