"""Classification of whole document tables by the cheap model, the costly one, or both under a budget.

Documents have doc_id, content, sender_email, file_extension, file_size, ts_s and load.
Texts are read where they lie and never shuffled: only routing numbers, samples of
the documents that go to the costly model (and of a few that a filter lets through)
and results travel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.config import MAX_CHARS, RoutingConfig
from docsluice.functions.answers import parse_category_answer
from docsluice.functions.prompts import classification_prompt, metadata_json, routing_prompt
from docsluice.functions.results import clamp, cost, normalize_category
from docsluice.operators.confidence import ConfidenceModel, predict_confidence
from docsluice.operators.features import with_features
from docsluice.operators.prefilter import likely_among
from docsluice.operators.results import check_documents, keep_or_drop
from docsluice.operators.routing import needs_reasoning, route_under_budget, with_routing_answers
from docsluice.schema import FEATURE_NAMES
from docsluice.session import reliable

# From documents to rows (doc_id, category, confidence).
Classifier = Callable[[DataFrame], DataFrame]
# From rows (doc_id, prompt) to rows (doc_id, response, call_error).
Asker = Callable[[DataFrame], DataFrame]
# From documents with the struct `features` to the same with the column `predicted`.
Forecast = Callable[[DataFrame], DataFrame]

CLASSIFIERS: dict[str, Classifier] = {}

# Error of a document that no classifier gave a result for.
NO_RESULT = "No classifier gave a result"
# Fixed value: the opening of the reason of a failed call.
FAILED_CALL = "Classification failed: "


def register_classifier(name: str, classifier: Classifier) -> None:
    """Makes a classifier of one's own available by name."""
    CLASSIFIERS[name] = classifier


def classify_with(name: str, docs: DataFrame) -> DataFrame:
    """Results of a registered classifier, normalised, with an error row for each empty document."""
    if name not in CLASSIFIERS:
        raise ValueError(f"no classifier named {name}; known: {', '.join(sorted(CLASSIFIERS)) or 'none'}")
    checked = check_documents(docs)
    results = CLASSIFIERS[name](checked.filter("error IS NULL").drop("error"))
    found = results.select(
        "doc_id",
        normalize_category(F.col("category")).alias("category"),
        clamp(F.col("confidence")).alias("confidence"),
        F.lit(None).cast("string").alias("error"),
    )
    empty = checked.filter("error IS NOT NULL").select(
        "doc_id",
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("double").alias("confidence"),
        "error",
    )
    return found.unionByName(empty)


def forecast_with(model: ConfidenceModel | None) -> Forecast:
    return lambda featured: predict_confidence(featured, model)


def decide_routes(
    docs: DataFrame, config: RoutingConfig, forecast: Forecast = forecast_with(None), ask: Asker | None = None
) -> DataFrame:
    """Rows (doc_id, hour_s, decision, predicted, threshold, threshold_after, error); `ask` settles the grey zone.

    `error` marks documents without text; they are routed and charged like others.
    """
    forecasted = forecast(with_features(check_documents(docs)))
    features = {name: F.col("features")[name] for name in FEATURE_NAMES}
    gate = F.lit(False) if ask is None else needs_reasoning(F.col("features"), F.col("predicted"), F.col("load"))
    gated = forecasted.withColumn("gate", gate)
    prompt = F.lit(None).cast("string") if ask is None else F.when(
        F.col("gate"), routing_prompt(F.col("content"), features, F.col("predicted"))
    )
    # One pass over the texts; what follows reads these narrow rows.
    rows = reliable(gated.select("doc_id", "ts_s", "load", "predicted", "gate", "error", prompt.alias("prompt")))
    if ask is None:
        settled = rows.select("*", F.lit(None).cast("string").alias("forced"), F.col("predicted").alias("confidence"))
    else:
        answers = reliable(ask(rows.filter("gate").select("doc_id", "prompt")))
        settled = with_routing_answers(rows.drop("prompt"), answers)
    routes = route_under_budget(settled, config)
    return routes.join(settled.select("doc_id", F.col("confidence").alias("predicted"), "error"), "doc_id").select(
        "doc_id", "hour_s", "decision", "predicted", "threshold", "threshold_after", "error"
    )


def category_prompts(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rows (doc_id, prompt)."""
    metadata = metadata_json(
        **{name: F.col(name) for name in ("sender_email", "file_extension", "file_size") if name in docs.columns}
    )
    return docs.select("doc_id", classification_prompt(F.col("content"), metadata, max_chars).alias("prompt"))


def read_answers(answers: DataFrame) -> DataFrame:
    """Rows (doc_id, category, confidence, reasoning, error) from answers of the costly model.

    With `processing_time_ms` if the answers say how long their calls took.
    """
    parsed = answers.withColumn("answer", parse_category_answer(F.col("response")))
    timed = [F.col("call_ms").alias("processing_time_ms")] if "call_ms" in answers.columns else []
    return parsed.select(
        "doc_id",
        normalize_category(F.col("answer.category")).alias("category"),
        clamp(F.col("answer.confidence")).alias("confidence"),
        F.col("answer.reasoning").alias("reasoning"),
        F.col("call_error").alias("error"),
        *timed,
    )


def llm_classify(docs: DataFrame, ask: Asker, max_chars: int = MAX_CHARS) -> DataFrame:
    """Every document by the costly model alone: doc_id, category, confidence, reasoning, error.

    A failed call gives the default category, confidence 0 and the reason. A document
    without text is not sent; it has an error and no category.
    """
    checked = check_documents(docs)
    answered = read_answers(ask(category_prompts(checked.filter("error IS NULL"), max_chars)))
    failed = F.col("error").isNotNull()
    found = answered.select(
        "doc_id",
        F.when(failed, "letter").otherwise(F.col("category")).alias("category"),
        F.when(failed, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(failed, F.concat(F.lit(FAILED_CALL), "error")).otherwise(F.col("reasoning")).alias("reasoning"),
        F.lit(None).cast("string").alias("error"),
    )
    return found.unionByName(checked.filter("error IS NOT NULL").select("doc_id", "error"), allowMissingColumns=True)


def hybrid_classify(
    docs: DataFrame,
    ml: Classifier,
    ask: Asker,
    config: RoutingConfig,
    forecast: Forecast = forecast_with(None),
    ask_route: Asker | None = None,
    mode: str = "keep",
) -> DataFrame:
    """Routes every document and returns one result row each; `mode="drop"` leaves out documents that failed.

    Columns: doc_id, category, confidence, classifier_type, decision, predicted,
    threshold, threshold_after, cost, reasoning, error, and processing_time_ms if the
    answers or the cheap model's rows say how long they took. Where the costly model fails, the
    cheap one's result is used; a document that neither can classify has an error and
    neither category nor cost. Either model sees only the documents it is needed for.
    """
    routes = reliable(decide_routes(docs, config, forecast, ask_route))
    texts = check_documents(docs).filter("error IS NULL").drop("error")
    to_llm = routes.filter("decision = 'LLM' AND error IS NULL").select("doc_id")
    # Texts of other documents are left out before samples are cut, and prompts before they are moved.
    prompts = category_prompts(likely_among(texts, to_llm)).join(to_llm, "doc_id", "left_semi")
    # Kept, because a call must not be made twice.
    costly = reliable(read_answers(ask(prompts))).filter("error IS NULL")
    costly_ms = [F.col("processing_time_ms").alias("_llm_ms")] if "processing_time_ms" in costly.columns else []
    costly = costly.select(
        *costly_ms,
        "doc_id",
        F.lit("LLM").alias("_costly"),
        F.col("category").alias("_llm_category"),
        F.col("confidence").alias("_llm_confidence"),
        F.col("reasoning").alias("reasoning"),
    )
    routed = reliable(routes.join(costly, "doc_id", "left"))
    to_ml = routed.filter("_costly IS NULL AND error IS NULL").select("doc_id")
    cheap = ml(likely_among(texts, to_ml))
    cheap_ms = [F.col("processing_time_ms").alias("_ml_ms")] if "processing_time_ms" in cheap.columns else []
    cheap = cheap.select(
        *cheap_ms,
        "doc_id",
        F.lit("ML").alias("_cheap"),
        F.col("category").alias("_ml_category"),
        F.col("confidence").alias("_ml_confidence"),
    )
    joined = routed.join(cheap, "doc_id", "left")
    used = F.coalesce("_costly", "_cheap")
    error = F.coalesce("error", F.when(used.isNull(), NO_RESULT))
    answered = F.col("_costly").isNotNull()
    measured = [F.when(answered == (name == "_llm_ms"), F.col(name)) for name in ("_llm_ms", "_ml_ms") if name in joined.columns]
    times = [F.coalesce(*measured).alias("processing_time_ms")] if measured else []
    category = normalize_category(F.when(answered, F.col("_llm_category")).otherwise(F.col("_ml_category")))
    results = joined.select(
        "doc_id",
        F.when(error.isNull(), category).alias("category"),
        clamp(F.when(answered, F.col("_llm_confidence")).otherwise(F.col("_ml_confidence"))).alias("confidence"),
        F.when(error.isNull(), used).alias("classifier_type"),
        "decision",
        "predicted",
        "threshold",
        "threshold_after",
        F.when(error.isNull(), cost(used)).alias("cost"),
        "reasoning",
        error.alias("error"),
        *times,
    )
    return keep_or_drop(results, mode)


def classify(
    docs: DataFrame, config: RoutingConfig, ml: Classifier | None = None, ask: Asker | None = None
) -> DataFrame:
    """Rows (doc_id, category, confidence, classifier_type, error) by whatever classifiers are at hand."""
    if ml is not None and ask is not None:
        return hybrid_classify(docs, ml, ask, config).select(
            "doc_id", "category", "confidence", "classifier_type", "error"
        )
    if ml is None and ask is None:
        raise ValueError("no classifier available")
    checked = check_documents(docs)
    usable = checked.filter("error IS NULL").drop("error")
    results = ml(usable) if ask is None else llm_classify(usable, ask).drop("error")
    found = results.select(
        "doc_id",
        normalize_category(F.col("category")).alias("category"),
        clamp(F.col("confidence")).alias("confidence"),
        F.lit("ML" if ask is None else "LLM").alias("classifier_type"),
    )
    joined = checked.select("doc_id", "error").join(found, "doc_id", "left")
    error = F.coalesce("error", F.when(F.col("classifier_type").isNull(), NO_RESULT))
    return joined.select(*found.columns, error.alias("error"))
