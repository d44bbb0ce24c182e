"""Streams over several micro-batches, with late rows and repeated batches."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from docsluice.operators.confidence import predict_confidence
from docsluice.operators.routing import route_under_budget
from docsluice.config import RoutingConfig
from docsluice.operators.metrics import recent_history_stats
from docsluice.streaming import streams
from tests.test_routing import COLUMNS, by_loop

CONFIG = RoutingConfig(0.6, 0.05, 0.3, rows_per_fold=16)


def arriving(spark, folder, rows, schema, parts):
    """A stream that meets the rows in that many micro-batches."""
    size = -(-len(rows) // parts)
    for part in range(parts):
        chosen = rows[part * size : (part + 1) * size]
        spark.createDataFrame(chosen, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={part}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(*[f"{folder}/*"]).drop("part")
    )


def requests(count=240):
    chance = random.Random(5)
    rows = [
        (number, number * 90, chance.randrange(100) / 100, chance.randrange(100) / 100, None) for number in range(count)
    ]
    return rows


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_routes_equal_the_batch(spark, tmp_path):
    rows = requests()
    source = arriving(spark, str(tmp_path / "in"), rows, COLUMNS, 3)
    expected = by_loop(rows, CONFIG)

    sink = streams.routing_sink(str(tmp_path / "out"), str(tmp_path / "counters"), CONFIG)
    query = finish(streams.run_batches(source, sink, str(tmp_path / "log")))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    routed = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: (r.decision, r.threshold) for r in routed.collect()} == expected

    # The last batch once more, as after a lost driver.
    last = routed.agg(F.max("batch")).first()[0]
    ids = {r.doc_id for r in routed.filter(F.col("batch") == last).collect()}
    sink(spark.createDataFrame([r for r in rows if r[0] in ids], COLUMNS), last)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: (r.decision, r.threshold) for r in again.collect()} == expected

    with streams.state_store(spark):
        stateful = streams.stream_routes(source, CONFIG)
        finish(streams.to_table(stateful, str(tmp_path / "out2"), str(tmp_path / "log2")))
    kept = spark.read.parquet(str(tmp_path / "out2"))
    assert {r.doc_id: (r.decision, r.threshold) for r in kept.collect()} == expected


def test_late_rows_are_routed_and_left_out_of_usage(spark, tmp_path):
    rows = [(n, n * 60, 0.2, 0.0, None) for n in range(180)] + [(500, 30, 0.2, 0.0, None)] + [(501, 40000, 0.2, 0.0, None)]
    source = arriving(spark, str(tmp_path / "in"), rows, COLUMNS, 2)
    sink = streams.routing_sink(str(tmp_path / "out"), str(tmp_path / "counters"), CONFIG)
    finish(streams.run_batches(source, sink, str(tmp_path / "log")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)

    timed = source.select(F.timestamp_seconds("ts_s").alias("ts"), F.lit("LLM").alias("decision"))
    finish(streams.to_table(streams.stream_usage(timed), str(tmp_path / "usage"), str(tmp_path / "log3")))
    usage = {r.hour_s: (r.total, r.llm_count, r.cost_mills) for r in spark.read.parquet(str(tmp_path / "usage")).collect()}
    assert usage[3600] == (60, 60, 600)
    assert set(usage) == {0, 3600, 7200}


def test_feedback_is_learned_from_at_update_points(spark, tmp_path):
    schema = (
        "doc_id long, routing_decision string, ml_confidence double, ml_correct boolean, llm_correct boolean, timestamp double"
    )
    rows = [(n, "ML", 0.5, n % 2 == 0, True, float(n)) for n in range(240)]
    source = arriving(spark, str(tmp_path / "in"), rows, schema, 4)
    sink = streams.learning_sink(str(tmp_path / "feedback"), str(tmp_path / "state"), RoutingConfig(), 0.75)
    finish(streams.run_batches(source, sink, str(tmp_path / "log")))
    states = spark.read.parquet(str(tmp_path / "state")).filter("rows IS NOT NULL").orderBy("arrived").collect()
    # 60, 120, 180, 240 rows: the first batch passes no update point, each of the others one.
    assert [(r.batch, r.rows, r.threshold) for r in states] == [(1, 100, 0.755), (2, 150, 0.76), (3, 200, 0.765)]


def test_thresholds_do_not_depend_on_the_batches(spark, tmp_path):
    schema = (
        "doc_id long, routing_decision string, ml_confidence double, ml_correct boolean, llm_correct boolean, timestamp double"
    )
    chance = random.Random(11)
    rows = [(n, chance.choice(["ML", "LLM"]), chance.random(), chance.random() < 0.4, chance.random() < 0.6, float(n)) for n in range(420)]
    found = []
    for parts in (1, 4, 12):
        folder = tmp_path / str(parts)
        source = arriving(spark, str(folder / "in"), rows, schema, parts)
        sink = streams.learning_sink(str(folder / "feedback"), str(folder / "state"), RoutingConfig(feedback_buffer=200), 0.75)
        finish(streams.run_batches(source, sink, str(folder / "log")))
        points = spark.read.parquet(str(folder / "state")).filter("rows IS NOT NULL").drop("batch")
        found.append(sorted(map(tuple, points.collect())))
    # Once the buffer of 200 rows is full, every row is an update point.
    assert len(found[0]) == 3 + 220
    assert found[0] == found[1] == found[2]


def test_old_replays_meet_their_counters(spark, tmp_path):
    """A backlog far older than the newest hour goes on with its hour's budget."""
    rows = [(n, n % 3 * 3_600_000 + n * 20, 0.2, 0.0, None) for n in range(150)]
    expected = by_loop(sorted(rows, key=lambda row: row[1]), CONFIG)
    source = arriving(spark, str(tmp_path / "in"), rows, COLUMNS, 3)
    sink = streams.routing_sink(str(tmp_path / "out"), str(tmp_path / "counters"), CONFIG)
    finish(streams.run_batches(source, sink, str(tmp_path / "log")))
    assert {r.doc_id: (r.decision, r.threshold) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected


def test_rows_in_any_order_within_the_delay(spark, tmp_path):
    # The watermark starts at 0: rows of the first second of the epoch would be late.
    rows = [(n, ts + 7_200, p, load, "LLM" if n % 17 == 0 else None) for n, ts, p, load, _ in requests(200)]
    expected = by_loop(rows, CONFIG)
    # Seven rows are ten and a half minutes; every row comes at most six places from its own.
    draw = random.Random(6)
    mixed = [row for _, row in sorted((n + draw.uniform(0, 6), row) for n, row in enumerate(rows))]
    assert mixed != rows
    source = arriving(spark, str(tmp_path / "in"), mixed, COLUMNS, 5)
    with streams.state_store(spark, idle_batches=True):
        routed = streams.stream_routes_in_order(source, CONFIG, "11 minutes")
        query = finish(streams.to_table(routed, str(tmp_path / "out"), str(tmp_path / "log")))
    found = {r.doc_id: (r.decision, r.threshold) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    passed = max(row[1] for row in rows) - 660
    assert found == {row[0]: expected[row[0]] for row in rows if row[1] < passed}
    assert sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"]) == 0
    # The rows held back come out when later ones arrive.
    later = [(1000, rows[-1][1] + 7200, 0.5, 0.1, None)]
    spark.createDataFrame(later, COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in" / "part=9"))
    with streams.state_store(spark, idle_batches=True):
        finish(streams.to_table(streams.stream_routes_in_order(source, CONFIG, "11 minutes"), str(tmp_path / "out"), str(tmp_path / "log")))
    found = {r.doc_id: (r.decision, r.threshold) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == expected


def test_batches_route_by_what_came_before(spark, tmp_path):
    """Thresholds and predictor of batch n come from the batches before it, also in a repeat."""
    from docsluice.operators.features import with_features
    from docsluice.sources.registry import load_predictor, published

    content = F.expr("repeat(concat('word', CAST(id % 7 AS STRING), ' '), CAST(5 + id % 40 AS INT))")
    docs = spark.range(320).select(
        F.col("id").alias("doc_id"), (F.col("id") * 10).alias("ts_s"), F.lit(0.1).alias("load"), F.lit(None).cast("string").alias("forced"),
        content.alias("content"), F.lit(None).cast("string").alias("sender_email"), F.lit("txt").alias("file_extension"), F.lit(9).cast("long").alias("file_size"),
    )
    rows = with_features(docs).select("doc_id", "ts_s", "load", "forced", "features")
    source = str(tmp_path / "in")
    for part in range(4):
        rows.filter(f"doc_id DIV 80 = {part}").coalesce(1).write.mode("append").parquet(source)
    arriving_rows = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def judge(batch, decided):
        return batch.join(decided.select("doc_id", F.col("decision").alias("routing_decision")), "doc_id").select(
            "doc_id", "routing_decision", "features", (0.2 + F.col("doc_id") % 40 / 80).alias("ml_confidence"),
            (F.col("doc_id") % 4 == 0).alias("ml_correct"), F.lit(True).alias("llm_correct"), F.col("ts_s").cast("double").alias("timestamp"),
        )

    root, config = str(tmp_path / "loop"), RoutingConfig(budget_per_hour=0.05)
    sink = streams.learning_router_sink(root, config, judge, iterations=3, depth=3)
    finish(streams.run_batches(arriving_rows, sink, str(tmp_path / "log")))
    found = spark.read.parquet(f"{root}/routes").orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(320))
    # 80, 160, 240, 320 rows: no update point, one, one that trains, one that trains.
    entries = [published(spark, f"{root}/registry", n) for n in range(5)]
    assert [None if e is None else e.predictor for e in entries] == [None, None, None, 3, 4]
    assert entries[3].threshold != 0.75
    for part in range(4):
        batch = rows.filter(f"doc_id DIV 80 = {part}")
        model = load_predictor(spark, f"{root}/registry", entries[part])
        base = 0.75 if entries[part] is None else entries[part].threshold
        counters = spark.read.parquet(f"{root}/counters/batch={part - 1}") if part else None
        again = route_under_budget(predict_confidence(batch, model), replace(config, base_threshold=base), counters)
        expected = {r.doc_id: (r.decision, r.threshold) for r in again.collect()}
        assert {r.doc_id: (r.decision, r.threshold) for r in found if r.batch == part} == expected
    # The second batch again, after later ones have published.
    sink(rows.filter("doc_id DIV 80 = 1"), 1)
    assert spark.read.parquet(f"{root}/routes").orderBy("doc_id").collect() == found
    assert [published(spark, f"{root}/registry", n) for n in range(5)] == entries


def test_statistics_of_the_newest(spark, tmp_path):
    schema = "doc_id long, ts_s long, total_time_ms double, actual_confidence double"
    rows = [(n, n, float(n), 0.9 if n >= 90 else 0.1) for n in range(100)]
    source = arriving(spark, str(tmp_path / "in"), rows, schema, 5)
    sink = streams.stats_sink(str(tmp_path / "rows"), str(tmp_path / "stats"), recent_history_stats, 20)
    finish(streams.run_batches(source, sink, str(tmp_path / "log")))
    last = spark.read.parquet(str(tmp_path / "stats")).orderBy(F.col("batch").desc()).first()
    assert (last.avg_processing_time_ms, last.routing_accuracy_estimate, last.total) == (89.5, 0.5, 100)


def test_late_rows_correct_closed_hours(spark, tmp_path):
    draw = random.Random(4)
    rows = [(n, draw.randrange(8 * 3600), draw.choice(["LLM", "ML", None])) for n in range(400)] + [(900, None, "LLM")]
    source = arriving(spark, str(tmp_path / "in"), rows, "doc_id long, ts_s long, decision string", 5)
    root = str(tmp_path / "usage")
    sink = streams.usage_sink(root, delay_s=600, buckets=3)
    finish(streams.run_batches(source, sink, str(tmp_path / "log")))

    parts = [rows[start : start + 81] for start in range(0, len(rows), 81)]
    newest, expected = None, {}
    for number, part in enumerate(parts):
        touched = set()
        for _, ts, decision in part:
            if ts is None:
                continue
            hour = ts - ts % 3600
            late = newest is not None and hour + 3600 <= newest - 600
            total, costly, late_rows, corrections = expected.get(hour, (0, 0, 0, 0))
            expected[hour] = (total + 1, costly + (decision == "LLM"), late_rows + late, corrections + (late and hour not in touched))
            touched.add(hour)
        newest = max([newest or 0] + [ts for _, ts, _ in part if ts is not None])
        found = streams.read_usage(spark, root, number + 1).collect()
        assert {r.hour_s: (r.total, r.llm_count, r.late, r.corrections) for r in found} == expected
    assert sum(late for _, _, late, _ in expected.values()) == spark.read.parquet(f"{root}/late").count() > 0

    # A batch that comes again, and one without rows, change nothing.
    last = spark.createDataFrame(parts[-1], "doc_id long, ts_s long, decision string")
    sink(last, 4)
    sink(last.filter("false"), 5)
    found = streams.read_usage(spark, root).collect()
    assert {r.hour_s: (r.total, r.llm_count, r.late, r.corrections) for r in found} == expected
    sink(spark.createDataFrame([(1, 5, "LLM")], "doc_id long, ts_s long, decision string"), 6)
    assert streams.read_usage(spark, root).filter("hour_s = 0").head().total == expected[0][0] + 1


def test_usage_that_starts_without_rows(spark, tmp_path):
    sink = streams.usage_sink(str(tmp_path / "usage"))
    frame = spark.createDataFrame([(7, "LLM")], "ts_s long, decision string")
    sink(frame.filter("false"), 0)
    sink(frame, 1)
    assert [(r.hour_s, r.total, r.late) for r in streams.read_usage(spark, str(tmp_path / "usage")).collect()] == [(0, 1, 0)]
