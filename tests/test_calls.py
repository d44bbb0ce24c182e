"""Retry and circuit breaker of the external call, and the plug-in classifier."""

from __future__ import annotations

import threading
import time

import pandas as pd
import pytest

from docsluice.config import CallConfig
from docsluice.operators.model_call import BREAKER_OPEN, Breaker, TokenBucket, _answered, _ask, call_model, pause_after
from docsluice.plans.classify import classify, classify_with

QUICK = CallConfig(base_delay=0.0)


def flaky(failures: int):
    left = [failures]

    def client(prompt: str) -> str:
        if left[0]:
            left[0] -= 1
            raise OSError("down")
        return prompt.upper()

    return client


def test_retries():
    assert _ask(flaky(2), "a", Breaker(QUICK), QUICK)[:3] == ("A", None, 3)
    assert _ask(flaky(3), "a", Breaker(QUICK), QUICK)[:3] == (None, "OSError: down", 3)


def test_breaker_opens_probes_and_closes():
    breaker = Breaker(CallConfig(failure_threshold=2, recovery_timeout=60, success_threshold=2))
    breaker.failed(0)
    breaker.succeeded()
    breaker.failed(1)
    assert breaker.admits(1)
    breaker.failed(2)
    assert not breaker.admits(61)
    assert breaker.admits(62)
    # One failure while probing blocks again.
    breaker.failed(62)
    assert not breaker.admits(121)
    assert breaker.admits(122)
    breaker.succeeded()
    breaker.succeeded()
    breaker.failed(123)
    assert breaker.admits(123)


def test_open_breaker_is_an_error_of_the_row():
    config = CallConfig(base_delay=0.0, failure_threshold=3)
    breaker = Breaker(config)
    assert _ask(flaky(3), "a", breaker, config)[1] == "OSError: down"
    assert _ask(flaky(0), "a", breaker, config)[:3] == (None, BREAKER_OPEN, 3)


def test_pauses_grow_and_stay_bounded():
    steady = CallConfig(jitter=False)
    assert [pause_after(attempt, steady) for attempt in (0, 1, 2, 10)] == [1.0, 2.0, 4.0, 60.0]
    assert all(0.75 <= pause_after(0, CallConfig()) <= 1.25 for _ in range(100))


def test_calls_keep_every_row(spark):
    def factory(timeout: float):
        def client(prompt: str) -> str:
            if prompt.endswith("3"):
                raise ValueError("no threes")
            return f"{prompt}/{timeout:g}"

        return client

    rows = spark.range(40).selectExpr("id AS doc_id", "concat('p', CAST(id AS STRING)) AS prompt")
    config = CallConfig(base_delay=0.0, failure_threshold=1000, concurrency=3)
    found = {r.doc_id: (r.response, r.call_error, r.attempts) for r in call_model(rows, "prompt", factory, config).collect()}
    assert found[4] == ("p4/30", None, 1)
    assert found[13] == (None, "ValueError: no threes", 3)
    assert len(found) == 40


def test_calls_in_flight_keep_order_and_bound():
    under_way, most, lock = [0], [0], threading.Lock()

    def client(text: str) -> str:
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        # The first row of each batch is the slowest.
        time.sleep(0.2 if text.endswith("0") else 0.01)
        with lock:
            under_way[0] -= 1
        return text.upper()

    batches = [pd.DataFrame({"prompt": [f"b{n}r{row}" for row in range(size)]}) for n, size in enumerate((30, 0, 1, 25, 40))]
    config, breaker = CallConfig(base_delay=0.0, in_flight=8), Breaker(QUICK)
    began = time.monotonic()
    found = list(_answered(iter(batches), "prompt", lambda text: _ask(client, text, breaker, config), 8))
    took = time.monotonic() - began
    assert [batch is given for (batch, _), given in zip(found, batches)] == [True] * len(batches)
    assert [[a[0] for a in answers] for _, answers in found] == [[t.upper() for t in batch["prompt"]] for batch in batches]
    alone = sum(0.2 if text.endswith("0") else 0.01 for batch in batches for text in batch["prompt"])
    assert 2 <= most[0] <= 8 and took < alone / 4


def test_hung_calls_end_at_the_deadline():
    released = threading.Event()

    def client(text: str) -> str:
        if text == "hang":
            released.wait(30)
        return text

    config = CallConfig(base_delay=0.0, max_attempts=2, in_flight=4, deadline=0.1, failure_threshold=1000)
    breaker = Breaker(config)
    batch = pd.DataFrame({"prompt": ["a", "hang", "b", "hang", "c"] * 4})
    began = time.monotonic()
    [(_, answers)] = _answered(iter([batch]), "prompt", lambda text: _ask(client, text, breaker, config), 4)
    assert time.monotonic() - began < 5
    released.set()
    late = (None, "TimeoutError: no answer within 0.1 s", 2)
    assert [a[:3] for a in answers] == [late if text == "hang" else (text, None, 1) for text in batch["prompt"]]
    assert all(a[3] >= 200 for a in answers if a[1])


def test_hung_calls_open_the_breaker():
    config = CallConfig(base_delay=0.0, max_attempts=1, deadline=0.05, failure_threshold=2)
    breaker, never = Breaker(config), threading.Event()
    found = [_ask(lambda text: never.wait(5), "x", breaker, config)[1] for _ in range(4)]
    assert found == ["TimeoutError: no answer within 0.05 s"] * 2 + [BREAKER_OPEN] * 2
    never.set()


def test_tokens_come_back_at_the_rate():
    bucket = TokenBucket(2.0, burst=3)
    assert [bucket.reserve(10.0) for _ in range(5)] == [0.0, 0.0, 0.0, 0.5, 1.0]
    assert bucket.reserve(11.0) == 0.5
    assert [bucket.reserve(60.0) for _ in range(4)] == [0.0, 0.0, 0.0, 0.5]
    assert [TokenBucket(None).reserve(0.0) for _ in range(9)] == [0.0] * 9
    # Any stretch of time sees at most the burst and what the rate brings.
    bucket, now, calls = TokenBucket(5.0, burst=2), 0.0, []
    for _ in range(40):
        now += 0.05
        calls.append(now + bucket.reserve(now))
    assert all(sum(a <= c <= a + 1.0 for c in calls) <= 2 + 5 + 1 for a in calls)


def test_rate_needs_the_number_of_partitions(spark):
    for wrong in ({"calls_per_minute": 30.0}, {"in_flight": 0}, {"deadline": 0.0}, {"burst": 0}):
        with pytest.raises(ValueError):
            CallConfig(**wrong)
    rows = spark.range(8).selectExpr("CAST(id AS STRING) AS prompt")
    config = CallConfig(base_delay=0.0, concurrency=2, in_flight=4, calls_per_minute=1200.0)
    began = time.monotonic()
    found = call_model(rows, "prompt", lambda timeout: str.upper, config).collect()
    # Ten calls a second and partition: the last of four waits three tenths of a second.
    assert len(found) == 8 and max(row.call_ms for row in found) >= 250 and time.monotonic() - began >= 0.3


def test_time_of_calls_reaches_the_results(spark):
    from docsluice.config import RoutingConfig
    from docsluice.plans.classify import hybrid_classify
    from docsluice.plans.learning import record

    docs = spark.createDataFrame(
        [(n, f"some text to read {n}", None, "txt", 17, n, 0.0) for n in range(4)],
        "doc_id long, content string, sender_email string, file_extension string, file_size long, ts_s long, load double",
    )

    def factory(timeout: float):
        def client(prompt: str) -> str:
            time.sleep(0.02)
            return '{"category": "form", "confidence": 0.5}'

        return client

    def ml(rows):
        return rows.selectExpr("doc_id", "'memo' AS category", "0.9 AS confidence", "1.5D AS processing_time_ms")

    results = hybrid_classify(docs, ml, lambda prompts: call_model(prompts, "prompt", factory, QUICK), RoutingConfig())
    found = {r.doc_id: (r.classifier_type, r.processing_time_ms) for r in results.collect()}
    assert found.keys() == set(range(4))
    assert all(ms >= 20 if kind == "LLM" else ms == 1.5 for kind, ms in found.values())
    history, feedback = record(results, docs)
    column = next(name for name in history.columns if "time_ms" in name)
    assert all(row[column] is not None for row in history.collect())


def test_modes(spark):
    docs = spark.createDataFrame(
        [(1, "some text to read", None, "txt", 17), (2, "  ", None, "txt", 2)],
        "doc_id long, content string, sender_email string, file_extension string, file_size long",
    )

    def ml(rows):
        return rows.selectExpr("doc_id", "'MEMO' AS category", "2.0 AS confidence")

    def ask(prompts):
        return prompts.selectExpr(
            "doc_id", "'{\"category\": \"form\", \"confidence\": 0.5}' AS response", "CAST(NULL AS STRING) AS call_error"
        )

    from docsluice.config import RoutingConfig

    cheap = {r.doc_id: (r.category, r.confidence, r.classifier_type) for r in classify(docs, RoutingConfig(), ml=ml).collect()}
    assert cheap == {1: ("memo", 1.0, "ML"), 2: (None, None, None)}
    costly = {r.doc_id: (r.category, r.error) for r in classify(docs, RoutingConfig(), ask=ask).collect()}
    assert costly == {1: ("form", None), 2: (None, "Empty document content")}
    timed = docs.selectExpr("*", "CAST(0 AS BIGINT) AS ts_s", "0.0D AS load")
    both = {r.doc_id: (r.category, r.classifier_type) for r in classify(timed, RoutingConfig(), ml, ask).collect()}
    # Untrained, the forecast lies below the threshold: the costly model is asked.
    assert both == {1: ("form", "LLM"), 2: (None, None)}
    with pytest.raises(ValueError):
        classify(docs, RoutingConfig())
    with pytest.raises(ValueError):
        classify_with("unheard of", docs)
