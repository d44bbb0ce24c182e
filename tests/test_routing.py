"""The budget router against a plain loop, in particular where hours are cut into chunks."""

from __future__ import annotations

import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsluice.config import RoutingConfig
from docsluice.operators.routing import (
    HIGHEST,
    LOWEST,
    chain_summaries,
    decide_batches,
    route_under_budget,
    summarize_batches,
)

COLUMNS = "doc_id long, ts_s long, predicted double, load double, forced string"


def loop(rows, config, total=0, llm=0):
    """Decision and threshold of each row, one after the other."""
    found = []
    for predicted, load, forced in rows:
        mills = total + 9 * llm
        threshold = config.base_threshold
        if mills * 10 > config.budget_mills * 8:
            threshold -= 0.1
        elif mills * 10 < config.budget_mills * 5:
            threshold += 0.05
        if load > 0.8:
            threshold -= 0.1
        if llm / max(1, total) > config.max_llm_ratio:
            threshold -= 0.15
        threshold = round(max(0.1, min(0.9, threshold)), 6)
        decision = forced or ("LLM" if predicted < threshold else "ML")
        found.append((decision, threshold))
        total += 1
        llm += decision == "LLM"
    return found


row = st.tuples(
    st.integers(0, 20).map(lambda n: n / 20),
    st.sampled_from([0.0, 0.5, 0.9]),
    st.sampled_from([None, None, None, None, "ML", "LLM"]),
)
config = st.builds(
    RoutingConfig,
    base_threshold=st.sampled_from([0.1, 0.45, 0.6, 0.75, 1.0]),
    budget_per_hour=st.sampled_from([0.01, 0.05, 0.2, 10.0]),
    max_llm_ratio=st.sampled_from([0.0, 0.1, 0.3, 0.5, 1.0]),
)


def as_frame(rows, start=0, chunk=0, total=0, llm=0):
    frame = pd.DataFrame(rows, columns=["predicted", "load", "forced"]).astype({"forced": object})
    return frame.assign(
        doc_id=range(start, start + len(rows)), hour_s=3600, chunk=chunk, start_total=total, start_llm=llm
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(row, min_size=1, max_size=120), config, st.integers(1, 40), st.integers(1, 30))
def test_chunks_give_what_the_loop_gives(rows, routing, size, batch):
    expected = loop(rows, routing)
    chunks = [
        as_frame(rows[first : first + size], first, chunk=first, total=first) for first in range(0, len(rows), size)
    ]
    whole = pd.concat(chunks)
    # Arrow batches end anywhere.
    batches = [whole.iloc[first : first + batch] for first in range(0, len(whole), batch)]
    summaries = pd.concat(summarize_batches(batches, routing))
    assert len(summaries) == len(chunks)
    entries = pd.concat(chain_summaries([summaries.sort_values("chunk")]))
    starts = dict(zip(entries["chunk"], entries["start_llm"]))
    known = [part.assign(start_llm=part["chunk"].map(starts)) for part in batches]
    decided = pd.concat(decide_batches(known, routing))
    assert list(zip(decided["decision"], decided["threshold"])) == expected
    assert decided["threshold"].between(LOWEST, HIGHEST).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(row, min_size=2, max_size=60), config, st.data())
def test_counters_carry_on(rows, routing, data):
    cut = data.draw(st.integers(1, len(rows) - 1))
    expected = loop(rows, routing)
    llm = sum(decision == "LLM" for decision, _ in expected[:cut])
    decided = pd.concat(decide_batches([as_frame(rows[cut:], cut, total=cut, llm=llm)], routing))
    assert list(zip(decided["decision"], decided["threshold"])) == expected[cut:]


def requests(seed: int):
    """A third of all rows in one hour, half of those in one second."""
    chance = random.Random(seed)
    rows = []
    for number in range(1500):
        hour = 7 if number % 3 == 0 else chance.randrange(40)
        second = 100 if number % 6 == 0 else chance.randrange(3600)
        forced = chance.choice([None] * 8 + ["ML", "LLM"])
        rows.append((number, hour * 3600 + second, chance.randrange(100) / 100, chance.randrange(100) / 100, forced))
    chance.shuffle(rows)
    return rows


def by_loop(rows, routing):
    expected = {}
    for hour in {ts // 3600 for _, ts, *_ in rows}:
        ordered = sorted((r for r in rows if r[1] // 3600 == hour), key=lambda r: (r[1], r[0]))
        for (number, *_), found in zip(ordered, loop([r[2:] for r in ordered], routing)):
            expected[number] = found
    return expected


def test_hot_hour_is_cut_and_stays_exact(spark):
    rows = requests(1)
    frame = spark.createDataFrame(rows, COLUMNS)
    for size in (1_000_000, 64):
        routing = RoutingConfig(0.6, 0.2, 0.3, rows_per_fold=size)
        routes = route_under_budget(frame, routing)
        found = {r.doc_id: (r.decision, r.threshold) for r in routes.collect()}
        assert found == by_loop(rows, routing)


def test_hours_continue_from_counters(spark):
    rows = requests(2)
    early = [r for r in rows if r[1] % 3600 < 1800]
    late = [r for r in rows if r[1] % 3600 >= 1800]
    routing = RoutingConfig(0.6, 0.2, 0.3, rows_per_fold=64)
    first = route_under_budget(spark.createDataFrame(early, COLUMNS), routing)
    counters = first.groupBy("hour_s").agg(
        F.count("*").alias("total"), F.count_if(F.col("decision") == "LLM").alias("llm")
    )
    second = route_under_budget(spark.createDataFrame(late, COLUMNS), routing, counters)
    found = {r.doc_id: (r.decision, r.threshold) for r in first.unionByName(second).collect()}
    assert found == by_loop(rows, routing)
