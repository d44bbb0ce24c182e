"""The router: thresholds, gate and decisions under an hourly budget.

Inside an hour each decision depends on the decisions before it: the threshold
falls as the cost and the share of costly calls grow. Since n, the number of
earlier rows, is known from the order alone, the only unknown is k, the number
of costly ones among them, and because the threshold never rises with k, row i
goes to the costly model exactly if k <= cut_i. A run of rows therefore maps k
to k + (1 per row whose cut is not yet passed), a monotone step function, and
step functions can be composed: an hour of any size is cut into chunks, each
chunk is summarised on its own, the small summaries are chained, and each chunk
is then decided on its own with the right k. Hours that fit one chunk are
decided directly.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.config import LLM_COST_MILLS, ML_COST_MILLS, RoutingConfig
from docsluice.functions.answers import parse_routing_answer
from docsluice.operators.ordering import in_chunks
from docsluice.session import bounded

# Changes of the threshold and its range.
CHEAP_HOUR, COSTLY_HOUR, HIGH_LOAD, HIGH_RATIO = 0.05, -0.1, -0.1, -0.15
LOWEST, HIGHEST = 0.1, 0.9
# Fixed value: the confidence assumed before the predictor is trained.
UNTRAINED_CONFIDENCE = 0.6

NEVER, ALWAYS = -1, 2**62

SUMMARY_COLUMNS = ["hour_s", "chunk", "start_total", "hour_llm", "shift", "gap_from", "gap_to"]

DECISION_SCHEMA = (
    "doc_id long, hour_s long, earlier long, earlier_llm long, threshold double, decision string, "
    "threshold_after double"
)


def hour_of(seconds: Column) -> Column:
    return seconds - F.pmod(seconds, F.lit(3600))


def adaptive_threshold(
    total: Column, llm: Column, mills: Column, load: Column, config: RoutingConfig
) -> Column:
    """Threshold for the next row, given the hour's counters before it."""
    budget = config.budget_mills
    by_cost = (
        F.when(mills * 10 > budget * 8, COSTLY_HOUR).when(mills * 10 < budget * 5, CHEAP_HOUR).otherwise(0.0)
    )
    by_load = F.when(load > 0.8, HIGH_LOAD).otherwise(0.0)
    ratio = llm / F.greatest(total, F.lit(1))
    by_ratio = F.when(ratio > config.max_llm_ratio, HIGH_RATIO).otherwise(0.0)
    moved = F.lit(config.base_threshold) + by_cost + by_load + by_ratio
    return F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), moved)), 6)


def heuristic_route(predicted: Column, threshold: Column) -> Column:
    return F.when(predicted < threshold, "LLM").otherwise("ML")


def needs_reasoning(features: Column, predicted: Column, load: Column) -> Column:
    """Is the row in the grey zone, where the external model is asked for the route?"""
    content = (
        (features["tech_term_density"] > 0.1)
        | (features["formatting_complexity"] > 0.05)
        | features["has_mixed_content"]
        | features["semantic_similarity_flag"]
    )
    return predicted.between(0.4, 0.7) & content & (load < 0.8)


def with_routing_answers(gated: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds `forced` and `confidence` to rows (doc_id, predicted, gate): gated rows take the answer's route."""
    joined = gated.join(answers.select("doc_id", "response"), "doc_id", "left")
    answer = parse_routing_answer(F.col("response"), F.col("predicted"))
    return (
        joined.withColumn("_answer", answer)
        .withColumn("forced", F.when(F.col("gate"), F.col("_answer.decision")))
        .withColumn("confidence", F.when(F.col("gate"), F.col("_answer.confidence")).otherwise(F.col("predicted")))
        .drop("_answer", "response")
    )


def route_under_budget(rows: DataFrame, config: RoutingConfig, counters: DataFrame | None = None) -> DataFrame:
    """Decisions for rows (doc_id, ts_s, predicted, load, forced), in order of (ts_s, doc_id) within each hour.

    `forced` is null, or a decision that is kept and still charged. `counters`
    (hour_s, total, llm) tells what the hours have seen before these rows.
    """
    slim = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("ts_s").cast("long").alias("ts_s"),
        F.col("predicted").cast("double").alias("predicted"),
        F.coalesce(F.col("load"), F.lit(0.0)).cast("double").alias("load"),
        F.col("forced").cast("string").alias("forced"),
        hour_of(F.col("ts_s").cast("long")).alias("hour_s"),
    )
    zero = F.lit(0).cast("long")
    if counters is None:
        slim = slim.withColumns({"start_total": zero, "start_llm": zero})
    else:
        known = counters.select("hour_s", F.col("total").alias("start_total"), F.col("llm").alias("start_llm"))
        slim = slim.join(bounded(known), "hour_s", "left").fillna(0, ["start_total", "start_llm"])
    sizes = slim.groupBy("hour_s").agg(F.count("*").alias("_n"))
    hot = bounded(sizes.filter(F.col("_n") > config.rows_per_fold).select("hour_s"))
    if hot.isEmpty():
        return _decide(slim.withColumn("chunk", zero), ["ts_s", "doc_id"], config)
    usual = slim.join(hot, "hour_s", "left_anti").withColumn("chunk", zero)
    direct = _decide(usual, ["ts_s", "doc_id"], config)
    return direct.unionByName(_route_in_chunks(slim.join(hot, "hour_s", "left_semi"), config))


def _in_runs(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each run, an hour or one chunk of it, in one partition and in order; a partition holds many runs."""
    return rows.repartition("hour_s", "chunk").sortWithinPartitions("hour_s", "chunk", *order)


def _decide(rows: DataFrame, order: list[str], config: RoutingConfig) -> DataFrame:
    return _in_runs(rows, order).mapInPandas(lambda batches: decide_batches(batches, config), DECISION_SCHEMA)


def _route_in_chunks(rows: DataFrame, config: RoutingConfig) -> DataFrame:
    chunks = in_chunks(rows, ["hour_s", "ts_s", "doc_id"], config.rows_per_fold)
    earlier = Window.partitionBy("hour_s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunks.groupBy("hour_s", "chunk")
        .agg(F.count("*").alias("_n"), F.first("start_total").alias("_total"))
        .select(
            "hour_s",
            "chunk",
            (F.col("_total") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("start_total"),
        )
    )
    placed = chunks.drop("start_total").join(starts, ["hour_s", "chunk"])
    summaries = _in_runs(placed, ["chunk_row"]).mapInPandas(
        lambda batches: summarize_batches(batches, config),
        "hour_s long, chunk long, start_total long, hour_llm long, shift long, gap_from array<long>, gap_to array<long>",
    )
    # One small record per chunk, read in order and never held together.
    entries = (
        summaries.repartition("hour_s")
        .sortWithinPartitions("hour_s", "chunk")
        .mapInPandas(chain_summaries, "hour_s long, chunk long, start_total long, start_llm long")
    )
    known = chunks.drop("start_total", "start_llm").join(entries, ["hour_s", "chunk"])
    return _decide(known, ["chunk_row"], config)


# ---- inside a task: one Arrow batch at a time ----


def _threshold_table(config: RoutingConfig) -> np.ndarray:
    """Thresholds by [cost band][high load][high ratio]; bands: cheap, middle, costly."""
    table = np.empty((3, 2, 2))
    for band, by_cost in enumerate((CHEAP_HOUR, 0.0, COSTLY_HOUR)):
        for loaded in (0, 1):
            for over in (0, 1):
                moved = config.base_threshold + by_cost + loaded * HIGH_LOAD + over * HIGH_RATIO
                table[band, loaded, over] = round(max(LOWEST, min(HIGHEST, moved)), 6)
    return table


def _thresholds(total: np.ndarray, llm: np.ndarray, loaded: np.ndarray, config: RoutingConfig) -> np.ndarray:
    mills = ML_COST_MILLS * (total - llm) + LLM_COST_MILLS * llm
    band = np.where(mills * 10 > config.budget_mills * 8, 2, np.where(mills * 10 < config.budget_mills * 5, 0, 1))
    over = (llm / np.maximum(total, 1) > config.max_llm_ratio).astype(int)
    return _threshold_table(config)[band, loaded, over]


def _cuts(pdf: pd.DataFrame, total: np.ndarray, config: RoutingConfig) -> np.ndarray:
    """Per row the largest number of earlier costly rows with which it still goes to the costly model."""
    extra = LLM_COST_MILLS - ML_COST_MILLS
    spent = ML_COST_MILLS * total
    # mills * 10 < 5 * budget, and mills * 10 <= 8 * budget, solved for k.
    cheap = (5 * config.budget_mills - 1 - 10 * spent) // (10 * extra)
    middle = (8 * config.budget_mills - 10 * spent) // (10 * extra)
    within = np.floor(config.max_llm_ratio * total).astype(np.int64)
    rows = np.maximum(total, 1)
    within = np.where((within + 1) / rows <= config.max_llm_ratio, within + 1, within)
    within = np.where(within / rows > config.max_llm_ratio, within - 1, within)

    loaded = (pdf["load"].to_numpy() > 0.8).astype(int)
    below = pdf["predicted"].to_numpy()[:, None, None] < _threshold_table(config)[:, loaded, :].transpose(1, 0, 2)
    cut = np.full(len(pdf), NEVER, dtype=np.int64)
    for band, limit in enumerate((cheap, middle, np.full(len(pdf), ALWAYS))):
        for over, reach in ((0, np.minimum(limit, within)), (1, limit)):
            cut = np.where(below[:, band, over], np.maximum(cut, reach), cut)
    forced = pdf["forced"].to_numpy()
    return np.where(forced == "LLM", ALWAYS, np.where(forced == "ML", NEVER, cut))


def _places(pdf: pd.DataFrame, last: tuple[int, int] | None, following: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start in the batch, and the number of earlier rows of the hour for each row.

    `last` is the run the previous batch ended in, `following` the place of its next row.
    """
    hours, chunks = pdf["hour_s"].to_numpy(), pdf["chunk"].to_numpy()
    fresh = np.empty(len(pdf), dtype=bool)
    fresh[0] = last != (hours[0], chunks[0])
    fresh[1:] = (hours[1:] != hours[:-1]) | (chunks[1:] != chunks[:-1])
    position = np.arange(len(pdf), dtype=np.int64)
    run = np.cumsum(fresh) - 1
    starts = np.append(np.flatnonzero(fresh), 0)
    inside = pdf["start_total"].to_numpy()[starts[run]] + position - starts[run]
    return fresh, np.where(run < 0, following + position, inside)


def decide_batches(batches: Iterable[pd.DataFrame], config: RoutingConfig) -> Iterator[pd.DataFrame]:
    """Decisions of ordered runs; each run begins with its counters in `start_total` and `start_llm`."""
    last, following, k = None, 0, 0
    for pdf in batches:
        if not len(pdf):
            continue
        fresh, total = _places(pdf, last, following)
        cuts = _cuts(pdf, total, config)
        before = np.empty(len(pdf), dtype=np.int64)
        starts = np.where(fresh, pdf["start_llm"].to_numpy(), NEVER).tolist()
        for row, (cut, start) in enumerate(zip(cuts.tolist(), starts)):
            if start >= 0:
                k = start
            before[row] = k
            if k <= cut:
                k += 1
        costly = before <= cuts
        loaded = (pdf["load"].to_numpy() > 0.8).astype(int)
        yield pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].to_numpy(),
                "hour_s": pdf["hour_s"].to_numpy(),
                "earlier": total,
                "earlier_llm": before,
                "threshold": _thresholds(total, before, loaded, config),
                "decision": np.where(costly, "LLM", "ML"),
                "threshold_after": _thresholds(total + 1, before + costly, loaded, config),
            }
        )
        last = (pdf["hour_s"].iloc[-1], pdf["chunk"].iloc[-1])
        following = int(total[-1]) + 1


def summarize_batches(batches: Iterable[pd.DataFrame], config: RoutingConfig) -> Iterator[pd.DataFrame]:
    """The step function of each chunk: k becomes k + shift - (number of gaps below k).

    A row with cut c makes k = c and k = c + 1 meet; in terms of the k at the
    start of the chunk it closes one gap between neighbours. Only starts from 0
    to the number of earlier rows can occur, so other gaps are not kept.
    """
    last, following, start, hour_llm, shift = None, 0, 0, 0, 0
    gaps: list[int] = []
    for pdf in batches:
        if not len(pdf):
            continue
        fresh, total = _places(pdf, last, following)
        done = []
        for row, (cut, begins) in enumerate(zip(_cuts(pdf, total, config).tolist(), fresh.tolist())):
            if begins:
                if last is not None:
                    done.append((*last, start, hour_llm, shift, *_as_runs(gaps)))
                last = (pdf["hour_s"].iloc[row], pdf["chunk"].iloc[row])
                start, hour_llm = int(total[row]), int(pdf["start_llm"].iloc[row])
                shift, gaps = 0, []
            if cut < 0:
                continue
            if cut < ALWAYS:
                gap = _open_gap(gaps, cut - shift)
                if gap < 0:
                    # Every start is already past the cut.
                    continue
                if gap < start:
                    insort(gaps, gap)
            shift += 1
        following = int(total[-1]) + 1
        yield pd.DataFrame(done, columns=SUMMARY_COLUMNS)
    if last is not None:
        yield pd.DataFrame([(*last, start, hour_llm, shift, *_as_runs(gaps))], columns=SUMMARY_COLUMNS)


def _as_runs(gaps: list[int]) -> tuple[list[int], list[int]]:
    """First and last number of each unbroken run."""
    firsts = [gap for place, gap in enumerate(gaps) if place == 0 or gap != gaps[place - 1] + 1]
    lasts = [gap for place, gap in enumerate(gaps) if place == len(gaps) - 1 or gap != gaps[place + 1] - 1]
    return firsts, lasts


def _open_gap(gaps: list[int], index: int) -> int:
    """The open gap with `index` open gaps from 0 up to it; negative if the gap lies below 0."""
    low, high = 0, len(gaps)
    while low < high:
        middle = (low + high) // 2
        if gaps[middle] - middle > index:
            high = middle
        else:
            low = middle + 1
    return index + low


def chain_summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The number of costly rows before each chunk; chunks arrive in order, hour by hour."""
    hour, k = None, 0
    for batch in batches:
        starts = []
        for record in batch.itertuples(index=False):
            if record.hour_s != hour:
                hour, k = record.hour_s, record.hour_llm
            starts.append(k)
            closed = sum(
                min(to, k - 1) - since + 1 for since, to in zip(record.gap_from, record.gap_to) if since < k
            )
            k += record.shift - closed
        yield batch[["hour_s", "chunk", "start_total"]].assign(start_llm=starts)
