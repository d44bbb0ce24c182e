"""Job parameters, with the defaults every operator uses."""

from __future__ import annotations

from dataclasses import dataclass

# Costs in integer mills (1 mill = 0.001), so that sums are exact.
ML_COST_MILLS = 1
LLM_COST_MILLS = 10


@dataclass(frozen=True)
class RoutingConfig:
    """Threshold and hourly budget of the router."""

    base_threshold: float = 0.75
    budget_per_hour: float = 10.0
    max_llm_ratio: float = 0.3
    learning_rate: float = 0.1
    # An hour with more rows than this is folded in several chunks.
    rows_per_fold: int = 200_000
    # The newest feedback rows that a change of the threshold or a retrained predictor rests on.
    feedback_buffer: int = 5000

    def __post_init__(self) -> None:
        for name in ("base_threshold", "max_llm_ratio"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.budget_per_hour <= 0:
            raise ValueError("budget_per_hour must be positive")
        if self.rows_per_fold < 1 or self.feedback_buffer < 1:
            raise ValueError("rows_per_fold and feedback_buffer must be positive")

    @property
    def budget_mills(self) -> int:
        return round(self.budget_per_hour * 1000)


@dataclass(frozen=True)
class TermConfig:
    """Vocabulary of the TF-IDF features; `stop_words=None` means Spark's English list."""

    max_features: int = 1000
    min_df: int = 2
    max_df: float = 0.95
    stop_words: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        # The vocabulary is handed to every task.
        if not 1 <= self.max_features <= 1_000_000:
            raise ValueError("max_features must lie between 1 and 1,000,000")


@dataclass(frozen=True)
class CallConfig:
    """Retry, circuit breaker and concurrency of an external model call."""

    # Names and defaults that callers rely on.
    max_attempts: int = 3
    base_delay: float = 1.0
    max_delay: float = 60.0
    exponential_base: float = 2.0
    jitter: bool = True
    failure_threshold: int = 5
    recovery_timeout: float = 60.0
    success_threshold: int = 3
    # Seconds one call may take; handed to the client, which owns the connection.
    timeout: float = 30.0
    # Number of partitions, hence of concurrent clients; None keeps the input's.
    concurrency: int | None = None
    # Calls that one partition has under way at a time; they share its client, breaker and rate.
    in_flight: int = 1
    # Seconds after which a call that has not come back is given up; None waits as long as the client does.
    deadline: float | None = None
    # Calls a minute of all partitions together, shared out evenly; needs `concurrency`.
    calls_per_minute: float | None = None
    # Calls a partition may make at once after a quiet time.
    burst: int = 1

    def __post_init__(self) -> None:
        if self.in_flight < 1 or self.burst < 1 or self.max_attempts < 1:
            raise ValueError("in_flight, burst and max_attempts must be positive")
        if self.deadline is not None and self.deadline <= 0:
            raise ValueError("deadline must be positive")
        if self.calls_per_minute is not None and (self.calls_per_minute <= 0 or not self.concurrency):
            raise ValueError("calls_per_minute must be positive and needs the number of partitions in concurrency")


MAX_CHARS = 2000
ROUTING_CHARS = 800
