"""Checks of the router and of whole classification."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import functions as F

from checks.expressions import DOC_FEATURES, PARSED, ROUTE_ANSWER, ROUTE_CONFIDENCE, prompt_sql, sample_sql
from checks.registry import check, rounded, table
from checks.views import EVENT_ROWS, event_rows, pick, spark_view, sql_views
from docsluice.config import CallConfig, RoutingConfig
from docsluice.operators.model_call import call_model
from docsluice.operators.features import with_features
from docsluice.operators.routing import (
    adaptive_threshold,
    heuristic_route,
    hour_of,
    needs_reasoning,
    route_under_budget,
    with_routing_answers,
)
from docsluice.operators.ordering import running_totals
from docsluice.operators.prefilter import BITMAP_BYTES, BROADCAST_BYTES, likely_among
from docsluice.plans.classify import classify_with, hybrid_classify, llm_classify, register_classifier
from docsluice.schema import CATEGORIES

# Small enough that every change of the threshold occurs.
CONFIG = RoutingConfig(base_threshold=0.6, budget_per_hour=0.05, max_llm_ratio=0.3)


def threshold_sql(n: str, k: str, load: str) -> str:
    return f"""round(greatest(0.1, least(0.9, CAST(0.6 AS DOUBLE)
      + CASE WHEN ({n} + 9 * {k}) * 10 > 400 THEN -0.1 WHEN ({n} + 9 * {k}) * 10 < 250 THEN 0.05 ELSE 0 END
      + CASE WHEN {load} > 0.8 THEN -0.1 ELSE 0 END
      + CASE WHEN {k} / greatest({n}, 1) > 0.3 THEN -0.15 ELSE 0 END)), 6)"""


def fold_sql(source: str) -> str:
    """Decisions in order, one recursion step per place in the hour; `source` has doc_id, ts_s, predicted, load, forced."""

    def decided(n: str, k: str) -> str:
        return f"""coalesce(s.forced, CASE WHEN s.predicted < {threshold_sql(n, k, 's.load')} THEN 'LLM' ELSE 'ML' END)"""

    n, k = "(f.earlier + 1)", "(f.earlier_llm + CASE WHEN f.decision = 'LLM' THEN 1 ELSE 0 END)"
    return f""", queued AS (SELECT *, ts_s - ts_s % 3600 AS hour_s,
      row_number() OVER (PARTITION BY ts_s - ts_s % 3600 ORDER BY ts_s, doc_id) AS place FROM {source}),
  fold AS (
    SELECT s.doc_id, s.hour_s, s.place, s.load, CAST(0 AS BIGINT) AS earlier, CAST(0 AS BIGINT) AS earlier_llm,
      {threshold_sql('0', '0', 's.load')} AS threshold, {decided('0', '0')} AS decision FROM queued s WHERE place = 1
    UNION ALL
    SELECT s.doc_id, s.hour_s, s.place, s.load, CAST({n} AS BIGINT), CAST({k} AS BIGINT), {threshold_sql(n, k, 's.load')}, {decided(n, k)}
    FROM fold f JOIN queued s ON s.hour_s = f.hour_s AND s.place = f.place + 1),
  routed AS (SELECT doc_id, hour_s, earlier, earlier_llm, threshold, decision,
    {threshold_sql("(earlier + 1)", "(earlier_llm + CASE WHEN decision = 'LLM' THEN 1 ELSE 0 END)", 'load')} AS threshold_after FROM fold)"""


EVENTS = "WITH RECURSIVE " + EVENT_ROWS


@check(
    "adaptive_threshold",
    EVENTS
    + f""", counted AS (SELECT doc_id, load, count(*) OVER earlier AS n,
      coalesce(sum(CAST(predicted < 0.35 AS INTEGER)) OVER earlier, 0) AS k FROM event_rows
      WINDOW earlier AS (PARTITION BY ts_s - ts_s % 3600 ORDER BY ts_s, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id, {threshold_sql('n', 'k', 'load')} AS threshold FROM counted""",
)
def threshold(spark, folder):
    rows = event_rows(spark, folder).withColumn("hour_s", hour_of(F.col("ts_s")))
    amounts = {"n": F.lit(1), "k": (F.col("predicted") < 0.35).cast("long")}
    counted = running_totals(rows, ["hour_s"], ["ts_s", "doc_id"], amounts)
    n, k = F.col("n"), F.col("k")
    return counted.select("doc_id", adaptive_threshold(n, k, n + 9 * k, F.col("load"), CONFIG).alias("threshold"))


@check(
    "route_static",
    sql_views("doc_meta") + " SELECT doc_id, CASE WHEN ml_confidence < 0.6 THEN 'LLM' ELSE 'ML' END AS decision FROM doc_meta",
)
def route_static(spark, folder):
    return spark_view(spark, folder, "doc_meta").select(
        "doc_id", heuristic_route(F.col("ml_confidence"), F.lit(0.6)).alias("decision")
    )


GATE = """ml_confidence BETWEEN 0.4 AND 0.7 AND (tech_term_density > 0.1 OR formatting_complexity > 0.05 OR has_mixed_content
  OR semantic_similarity_flag) AND load < 0.8"""


@check("llm_gate", DOC_FEATURES + f" SELECT doc_id, {GATE} AS gate FROM features")
def gate(spark, folder):
    featured = with_features(spark_view(spark, folder, "doc_meta"))
    return featured.select(
        "doc_id", needs_reasoning(F.col("features"), F.col("ml_confidence"), F.col("load")).alias("gate")
    )


ASSISTED = (
    sql_views("doc_meta", "routing_answers")
    + DOC_FEATURES.removeprefix(sql_views("doc_meta"))
    + f""", asked AS (SELECT f.doc_id, ts_s, f.load, f.ml_confidence AS p, {GATE.replace('ml_confidence', 'f.ml_confidence').replace('load <', 'f.load <')} AS gate, response
    FROM features f JOIN doc_meta d USING (doc_id) LEFT JOIN routing_answers USING (doc_id)),
  settled AS (SELECT doc_id, ts_s, load, p AS predicted, CASE WHEN gate THEN {ROUTE_ANSWER} END AS forced,
    CASE WHEN gate THEN {ROUTE_CONFIDENCE} ELSE p END AS confidence FROM asked)"""
)


@check(
    "route_llm_assisted",
    ASSISTED + " SELECT doc_id, forced, round(confidence, 6) AS confidence FROM settled",
)
def route_llm_assisted(spark, folder):
    featured = with_features(spark_view(spark, folder, "doc_meta"))
    gated = featured.select(
        "doc_id",
        F.col("ml_confidence").alias("predicted"),
        needs_reasoning(F.col("features"), F.col("ml_confidence"), F.col("load")).alias("gate"),
    )
    settled = with_routing_answers(gated, spark_view(spark, folder, "routing_answers"))
    return rounded(settled.select("doc_id", "forced", "confidence"), "confidence")


@check(
    "route_budgeted",
    EVENTS + fold_sql("event_rows") + " SELECT doc_id, hour_s, earlier, earlier_llm, threshold, decision, threshold_after FROM routed",
)
def route_budgeted(spark, folder):
    return route_under_budget(event_rows(spark, folder), CONFIG)


@check(
    "route_budgeted_chunks",
    EVENTS + fold_sql("event_rows") + " SELECT doc_id, hour_s, earlier, earlier_llm, threshold, decision, threshold_after FROM routed",
)
def route_budgeted_chunks(spark, folder):
    """The same with every busy hour cut into chunks of six rows."""
    return route_under_budget(event_rows(spark, folder), RoutingConfig(0.6, 0.05, 0.3, rows_per_fold=6))


# The costly model of the checks reads the prompt: its hash picks the answer, and some calls fail.
ANSWERS = {
    0: "concat('{{\"category\": \"', {name}, '\", \"confidence\": 0.', {cents}, ', \"reasoning\": \"clear\"}}')",
    1: "concat('Here it is: {{\"category\": \"', {name}, '\", \"confidence\": 0.', {cents}, '}} as asked.')",
    2: "concat('Category: ', upper({name}), ', Confidence: 0.', {cents})",
    3: "'I cannot say.'",
    4: "concat('{{\"category\": \"contract\", \"confidence\": 1.', {cents}, '}}')",
}


def answer_rule(number: str) -> str:
    """The answer as SQL for both engines; `number` is an expression for a hash of the prompt below 65,536."""
    name, cents = pick(f"{number} % 16"), f"lpad(CAST({number} % 97 AS STRING), 2, '0')"
    cases = " ".join(f"WHEN {kind} THEN {rule.format(name=name, cents=cents)}" for kind, rule in ANSWERS.items())
    return f"CASE {number} % 5 {cases} END"


def reading_client(prompts):
    """Rows (doc_id, response, call_error) from rows (doc_id, prompt); one call in sixteen fails."""
    hashed = prompts.select("doc_id", F.conv(F.left(F.md5("prompt"), F.lit(4)), 16, 10).cast("long").alias("h"))
    fails = F.col("h") % 16 == 7
    return hashed.select(
        "doc_id",
        F.when(~fails, F.expr(answer_rule("h"))).alias("response"),
        F.when(fails, "call failed").alias("call_error"),
    )


PROMPTED = (
    sample_sql(2000)
    + f""", hashed AS (SELECT doc_id, CAST(concat('0x', left(md5({prompt_sql()}), 4)) AS BIGINT) AS h
    FROM sampled WHERE trim(content, E' \\n\\t\\r') <> ''),
  llm_answers AS (SELECT doc_id, CASE WHEN h % 16 <> 7 THEN {answer_rule('h')} END AS response,
    CASE WHEN h % 16 = 7 THEN 'call failed' END AS call_error FROM hashed)"""
)
KNOWN = ", ".join(f"'{name}'" for name in CATEGORIES)
BLANK = "trim(content, E' \\n\\t\\r') = ''"


@check(
    "llm_classify",
    sql_views("doc_meta")
    + PROMPTED
    + PARSED
    + f""" SELECT d.doc_id, CASE WHEN NOT {BLANK} THEN CASE WHEN call_error IS NULL AND lower(category) IN ({KNOWN})
        THEN lower(category) ELSE 'letter' END END AS category,
      round(CASE WHEN NOT {BLANK} THEN CASE WHEN call_error IS NULL THEN greatest(0.0, least(1.0, confidence)) ELSE 0.0 END END, 6) AS confidence,
      CASE WHEN call_error IS NULL THEN reasoning ELSE 'Classification failed: call failed' END AS reasoning,
      CASE WHEN {BLANK} THEN 'Empty document content' END AS error
    FROM doc_meta d LEFT JOIN parsed USING (doc_id) LEFT JOIN llm_answers USING (doc_id)""",
)
def llm_alone(spark, folder):
    return rounded(llm_classify(spark_view(spark, folder, "doc_meta"), reading_client), "confidence")


# The cheap model of the checks reads the text: its number of characters and first word decide; it knows nothing to say about some texts.
CHEAP_SQL = f"""SELECT doc_id, {pick("length(content) % 16")} AS category,
  CAST(length(content) % 100 AS DOUBLE) / 100 AS confidence FROM doc_meta WHERE length(content) % 9 <> 4"""


def cheap_model(docs):
    return docs.filter(F.length("content") % 9 != 4).select(
        "doc_id",
        F.expr(pick("length(content) % 16")).alias("category"),
        ((F.length("content") % 100).cast("double") / 100).alias("confidence"),
    )


HYBRID = (
    sql_views("doc_meta", "routing_answers")
    + ASSISTED.removeprefix(sql_views("doc_meta", "routing_answers"))
    + fold_sql("settled")
    + PROMPTED
    + PARSED
    + f""", answered AS (SELECT doc_id, CASE WHEN lower(category) IN ({KNOWN}) THEN lower(category) ELSE 'letter' END AS category,
      greatest(0.0, least(1.0, confidence)) AS confidence, reasoning FROM parsed JOIN llm_answers USING (doc_id) WHERE call_error IS NULL),
  cheap AS ({CHEAP_SQL}),
  picked AS (SELECT r.doc_id, r.decision, s.confidence AS predicted, r.threshold, r.threshold_after,
      CASE WHEN trim(d.content, E' \\n\\t\\r') = '' THEN 'Empty document content'
        WHEN (r.decision = 'ML' OR a.doc_id IS NULL) AND m.doc_id IS NULL THEN 'No classifier gave a result' END AS error,
      r.decision = 'LLM' AND a.doc_id IS NOT NULL AS costly, a.category AS llm_category, a.confidence AS llm_confidence, a.reasoning,
      m.category AS ml_category, m.confidence AS ml_confidence
    FROM routed r JOIN settled s USING (doc_id) JOIN doc_meta d USING (doc_id) LEFT JOIN cheap m USING (doc_id) LEFT JOIN answered a USING (doc_id)),
  hybrid AS (SELECT doc_id, CASE WHEN error IS NULL THEN CASE WHEN costly THEN llm_category ELSE ml_category END END AS category,
    round(CASE WHEN error IS NULL THEN CASE WHEN costly THEN llm_confidence ELSE ml_confidence END END, 6) AS confidence,
    CASE WHEN error IS NULL THEN CASE WHEN costly THEN 'LLM' ELSE 'ML' END END AS classifier_type,
    decision, round(predicted, 6) AS predicted, threshold, threshold_after,
    CASE WHEN error IS NULL THEN CASE WHEN costly THEN CAST(0.01 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END END AS cost,
    CASE WHEN costly THEN reasoning END AS reasoning, error FROM picked)"""
)


def hybrid_results(spark, folder, mode="keep"):
    routing = spark_view(spark, folder, "routing_answers")
    results = hybrid_classify(
        spark_view(spark, folder, "doc_meta"),
        ml=cheap_model,
        ask=reading_client,
        config=CONFIG,
        forecast=lambda featured: featured.withColumn("predicted", F.col("ml_confidence")),
        ask_route=lambda prompts: prompts.select("doc_id").join(routing, "doc_id"),
        mode=mode,
    )
    return rounded(results, "confidence", "predicted")


@check("hybrid_classify", HYBRID + " SELECT * FROM hybrid")
def hybrid(spark, folder):
    return hybrid_results(spark, folder)


@check("hybrid_both_failed", HYBRID + " SELECT doc_id, decision, error FROM hybrid WHERE error IS NOT NULL")
def hybrid_both_failed(spark, folder):
    """Documents without a result: blank ones, and those neither model could classify."""
    return hybrid_results(spark, folder).filter("error IS NOT NULL").select("doc_id", "decision", "error")


@check(
    "custom_classifier",
    sql_views("doc_meta")
    + """ SELECT doc_id, CASE WHEN trim(content, E' \\n\\t\\r') = '' THEN NULL WHEN contains(content, '|') THEN 'form' ELSE 'memo' END AS category,
      CASE WHEN trim(content, E' \\n\\t\\r') = '' THEN NULL ELSE CAST(1 AS DOUBLE) END AS confidence,
      CASE WHEN trim(content, E' \\n\\t\\r') = '' THEN 'Empty document content' END AS error FROM doc_meta""",
)
def custom_classifier(spark, folder):
    register_classifier(
        "by layout",
        lambda docs: docs.select(
            "doc_id",
            F.when(F.contains("content", F.lit("|")), "FORM").otherwise("Memo").alias("category"),
            F.lit(7.5).alias("confidence"),
        ),
    )
    return classify_with("by layout", spark_view(spark, folder, "doc_meta"))


def hashing_client(timeout: float):
    """Stands for a model server: answers with a hash, and always fails on some prompts."""

    def answer(prompt: str) -> str:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        if digest[0] == "0":
            raise ConnectionError("refused")
        return digest

    return answer


@check(
    "call_model",
    sql_views("doc_meta")
    + sample_sql(2000)
    + f""", prompts AS (SELECT doc_id, md5({prompt_sql()}) AS digest FROM sampled)
    SELECT doc_id, CASE WHEN digest[1] <> '0' THEN digest END AS response,
      CASE WHEN digest[1] = '0' THEN 'ConnectionError: refused' END AS call_error,
      CASE WHEN digest[1] = '0' THEN 3 ELSE 1 END AS attempts FROM prompts""",
)
def external_call(spark, folder):
    from docsluice.plans.classify import category_prompts

    prompts = category_prompts(spark_view(spark, folder, "doc_meta"))
    # No waiting, and a breaker that stays out of the way: both are tested on their own.
    config = CallConfig(base_delay=0.0, failure_threshold=1_000_000_000)
    return call_model(prompts, "prompt", hashing_client, config).drop("prompt", "call_ms")


def slow_client(timeout: float):
    """Stands for a slow model server that never comes back on some prompts and refuses others."""
    answer = hashing_client(timeout)

    def slowly(prompt: str) -> str:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        time.sleep(60 if digest.startswith("f0") else 0.002)
        return answer(prompt)

    return slowly


@check(
    "call_model_in_flight",
    sql_views("doc_meta")
    + sample_sql(2000)
    + f""", prompts AS (SELECT doc_id, md5({prompt_sql()}) AS digest FROM sampled)
    SELECT doc_id, CASE WHEN digest[1] <> '0' AND digest[1:2] <> 'f0' THEN digest END AS response,
      CASE WHEN digest[1] = '0' THEN 'ConnectionError: refused' WHEN digest[1:2] = 'f0' THEN 'TimeoutError: no answer within 0.5 s' END AS call_error,
      CASE WHEN digest[1] = '0' OR digest[1:2] = 'f0' THEN 2 ELSE 1 END AS attempts, TRUE AS timed FROM prompts""",
)
def calls_in_flight(spark, folder):
    """Sixteen calls at a time in each of two partitions: calls that never come back are errors after the deadline."""
    from docsluice.plans.classify import category_prompts

    prompts = category_prompts(spark_view(spark, folder, "doc_meta"))
    config = CallConfig(base_delay=0.0, failure_threshold=1_000_000_000, max_attempts=2, concurrency=2, in_flight=16, deadline=0.5)
    called = call_model(prompts, "prompt", slow_client, config)
    waited = F.when(F.col("call_error").startswith("TimeoutError"), F.col("call_ms") >= 1000).otherwise(F.col("call_ms") >= 0)
    return called.select("doc_id", "response", "call_error", "attempts", waited.alias("timed"))


@check(
    "likely_among_keys",
    """SELECT share, blocks, chosen, CASE WHEN chosen THEN n END AS kept, TRUE AS less_than_one_in_fifty FROM (
      SELECT share, blocks, o_orderkey % share = 0 AS chosen, count(*) AS n
      FROM orders, (VALUES (2), (40)) s(share), (VALUES ('one'), ('several')) b(blocks) GROUP BY ALL)""",
)
def likely_among_keys(spark, folder):
    """Orders by filters of half and of a fortieth of their keys, broadcast whole or one bitmap at a time."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    found = None
    for share in (2, 40):
        chosen = (F.col("o_orderkey") % share == 0).alias("chosen")
        total = orders.groupBy(chosen).agg(F.count("*").alias("total"))
        for blocks, most in (("one", BROADCAST_BYTES), ("several", BITMAP_BYTES)):
            passed = likely_among(orders, orders.select("o_orderkey").filter(f"o_orderkey % {share} = 0"), "o_orderkey", most)
            counts = total.join(passed.groupBy(chosen).agg(F.count("*").alias("n")), "chosen", "left").select(
                F.lit(share).alias("share"),
                F.lit(blocks).alias("blocks"),
                "chosen",
                F.when(F.col("chosen"), F.col("n")).alias("kept"),
                (F.col("chosen") | (F.coalesce("n", F.lit(0)) < 0.02 * F.col("total"))).alias("less_than_one_in_fifty"),
            )
            found = counts if found is None else found.unionByName(counts)
    return found
