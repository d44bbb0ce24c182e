"""Calls of an external model, one client per partition, several calls under way at a time."""

from __future__ import annotations

import queue
import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docsluice.config import CallConfig

# Builds, inside the task, the function that answers one prompt; gets the time-out in seconds.
# With `in_flight` above 1 the function is called by several threads at a time.
ClientFactory = Callable[[float], Callable[[str], str]]

BREAKER_OPEN = "circuit breaker is open"


# Response, error, attempts and milliseconds from the first attempt to the last.
Answer = tuple[str | None, str | None, int, float]

# Rows handed out for each call at a time, and characters of their prompts in all. A row at the front that takes as long
# as hundreds of others holds up its batch, but not the calls: they go on with the rows behind it.
AHEAD, HELD = 1024, 32 << 20


class Breaker:
    """Refuses calls for a while after too many failures; the threads of a partition share it."""

    def __init__(self, config: CallConfig) -> None:
        self.config = config
        self.failures = 0
        self.probes: int | None = None
        self.blocked_until: float | None = None
        self.lock = threading.Lock()

    def admits(self, now: float) -> bool:
        with self.lock:
            if self.blocked_until is not None and now >= self.blocked_until:
                self.blocked_until = None
                self.probes = 0
            return self.blocked_until is None

    def succeeded(self) -> None:
        with self.lock:
            if self.probes is None:
                self.failures = 0
                return
            self.probes += 1
            if self.probes >= self.config.success_threshold:
                self.probes, self.failures = None, 0

    def failed(self, now: float) -> None:
        with self.lock:
            self.failures += 1
            if self.failures >= self.config.failure_threshold:
                self.blocked_until = now + self.config.recovery_timeout


class TokenBucket:
    """A token a call; tokens come back at a steady rate, up to `burst` of them. Without a rate nobody waits."""

    def __init__(self, per_second: float | None, burst: int = 1) -> None:
        self.per_second, self.burst, self.tokens = per_second, burst, float(burst)
        self.at: float | None = None
        self.lock = threading.Lock()

    def reserve(self, now: float) -> float:
        """Takes a token, one that is yet to come if need be; the seconds until it is there."""
        if self.per_second is None:
            return 0.0
        with self.lock:
            if self.at is not None:
                self.tokens = min(float(self.burst), self.tokens + max(0.0, now - self.at) * self.per_second)
            self.at = now if self.at is None else max(now, self.at)
            self.tokens -= 1
            return max(0.0, -self.tokens / self.per_second)


def pause_after(attempt: int, config: CallConfig) -> float:
    """Seconds to wait after the given attempt, counted from 0."""
    pause = min(config.base_delay * config.exponential_base**attempt, config.max_delay)
    spread = 0.25 * pause if config.jitter else 0.0
    return max(0.0, pause + random.uniform(-spread, spread))


def call_model(
    df: DataFrame, prompt: str, client_factory: ClientFactory, config: CallConfig = CallConfig()
) -> DataFrame:
    """Adds `response`, `call_error`, `attempts` and `call_ms`; a failing call gives an error, never a failing job.

    Keep the frame narrow: every column crosses to Python. Client, breaker and rate
    belong to the partition; `in_flight` calls are under way at a time, and rows come
    back in their order. A call that misses the deadline is given up and counts as
    failed, whatever becomes of it. A task that is run again calls again, so write the
    result before it is used twice.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("response", T.StringType()),
            T.StructField("call_error", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("call_ms", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory(config.timeout)
        breaker = Breaker(config)
        rate = None if config.calls_per_minute is None else config.calls_per_minute / 60 / config.concurrency
        bucket = TokenBucket(rate, config.burst)
        for batch, answers in _answered(batches, prompt, lambda text: _ask(client, text, breaker, config, bucket), config.in_flight):
            columns = zip(*answers) if answers else ([], [], [], [])
            yield batch.assign(**dict(zip(("response", "call_error", "attempts", "call_ms"), map(list, columns))))

    spread = df.repartition(config.concurrency) if config.concurrency else df
    return spread.mapInPandas(run, schema)


def _answered(
    batches: Iterator[pd.DataFrame], prompt: str, ask: Callable[[str], Answer], in_flight: int
) -> Iterator[tuple[pd.DataFrame, list[Answer]]]:
    """Every batch with the answers to its rows, in order; rows of the next batch are under way before one is done."""
    if in_flight == 1:
        for batch in batches:
            yield batch, [ask(text) for text in batch[prompt]]
        return
    pool = ThreadPoolExecutor(in_flight)
    waiting: deque[tuple[Future, int]] = deque()
    held = 0
    open_batches: deque[tuple[pd.DataFrame, list[Answer]]] = deque()

    def settle(most: int) -> Iterator[tuple[pd.DataFrame, list[Answer]]]:
        """Takes the oldest answers until at most so many rows are out, of no more text than is held, and gives away the batches that are complete."""
        nonlocal held
        while waiting and (len(waiting) > most or held > HELD):
            first = next(found for found in open_batches if len(found[1]) < len(found[0]))
            answer, size = waiting.popleft()
            first[1].append(answer.result())
            held -= size
        while open_batches and len(open_batches[0][1]) == len(open_batches[0][0]):
            yield open_batches.popleft()

    try:
        for batch in batches:
            open_batches.append((batch, []))
            for text in batch[prompt]:
                waiting.append((pool.submit(ask, text), len(text or "")))
                held += waiting[-1][1]
                if len(waiting) >= AHEAD * in_flight or held > HELD:
                    yield from settle(AHEAD * in_flight - 1)
            # Of a batch that is read only its last rows are still out.
            yield from settle(AHEAD * in_flight - 1)
        yield from settle(0)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def _within(client: Callable[[str], str], text: str, deadline: float | None) -> str:
    """The client's answer; a call that does not come back in time is left to itself in a thread that holds nobody up."""
    if deadline is None:
        return client(text)
    came: queue.SimpleQueue = queue.SimpleQueue()

    def call() -> None:
        try:
            came.put((client(text), None))
        except BaseException as error:  # handed to the caller, who decides
            came.put((None, error))

    threading.Thread(target=call, daemon=True).start()
    try:
        answer, error = came.get(timeout=deadline)
    except queue.Empty:
        raise TimeoutError(f"no answer within {deadline:g} s") from None
    if error is not None:
        raise error
    return answer


def _ask(
    client: Callable[[str], str], text: str, breaker: Breaker, config: CallConfig, bucket: TokenBucket | None = None
) -> Answer:
    problem, began = None, time.monotonic()
    for attempt in range(config.max_attempts):
        if attempt:
            time.sleep(pause_after(attempt - 1, config))
        if not breaker.admits(time.monotonic()):
            problem = BREAKER_OPEN
            continue
        if bucket is not None and (pause := bucket.reserve(time.monotonic())):
            time.sleep(pause)
        try:
            answer = _within(client, text, config.deadline)
        except Exception as error:  # whatever the client raises is this row's error
            problem = f"{type(error).__name__}: {error}"
            breaker.failed(time.monotonic())
        else:
            breaker.succeeded()
            return answer, None, attempt + 1, 1000 * (time.monotonic() - began)
    return None, problem, config.max_attempts, 1000 * (time.monotonic() - began)
