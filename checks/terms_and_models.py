"""Checks of term weights, naive Bayes and the trained models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import ORACLES, check, rounded
from checks.views import spark_view, sql_views
from docsluice.config import TermConfig
from docsluice.operators import bayes, bayes_blocks, learners, terms
from docsluice.operators.boosting import SoftmaxBoosting
from docsluice.operators.confidence import load_confidence, predict_confidence, save_confidence, train_confidence
from docsluice.operators.features import with_features
from docsluice.operators.kernel_svm import KernelSVM
from docsluice.plans import learning
from docsluice.session import fresh_path, reliable

STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "de", "la", "und", "les", "et")
CONFIG = TermConfig(stop_words=STOP_WORDS)

UNWANTED = ", ".join(f"'{word}'" for word in STOP_WORDS)
TERMS = (
    sql_views("doc_meta")
    + f""", tokens AS (SELECT doc_id, lang AS label,
      list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({UNWANTED})) AS words FROM doc_meta),
  grams AS (SELECT doc_id, label, unnest(words) AS term FROM tokens
    UNION ALL SELECT doc_id, label, unnest(list_transform(range(1, len(words)), lambda i: concat(words[i], ' ', words[i + 1]))) FROM tokens),
  tf AS (SELECT doc_id, label, term, count(*) AS tf FROM grams GROUP BY ALL)"""
)
VOCABULARY = (
    TERMS
    + """, frequent AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, (SELECT count(*) FROM doc_meta) AS documents FROM tf GROUP BY 1
      HAVING count(*) >= 2 AND count(*) <= (SELECT count(*) FROM doc_meta) * CAST(0.95 AS DOUBLE)),
  top AS (SELECT * FROM frequent ORDER BY tf DESC, term LIMIT 1000),
  vocabulary AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS index, term, tf, df, ln((1 + documents) / (1 + df)) + 1 AS idf FROM top)"""
)


def with_terms(spark, folder):
    docs = spark_view(spark, folder, "doc_meta").select("doc_id", "content", F.col("lang").alias("label"))
    return terms.with_terms(docs, "content", CONFIG).select("doc_id", "label", "content", "terms")


@check("term_frequency", TERMS + " SELECT doc_id, term, tf FROM tf")
def term_frequency(spark, folder):
    return terms.term_frequency(with_terms(spark, folder))


@check("document_frequency", VOCABULARY + " SELECT term, tf, df, documents FROM frequent")
def document_frequency(spark, folder):
    return terms.document_frequency(with_terms(spark, folder), CONFIG, "content")


@check("tfidf_vocabulary", VOCABULARY + " SELECT index, term, tf FROM vocabulary")
def tfidf_vocabulary(spark, folder):
    return terms.fit_vocabulary(with_terms(spark, folder), CONFIG, "content").select("index", "term", "tf")


@check("tfidf_idf", VOCABULARY + " SELECT term, df, round(idf, 6) AS idf FROM vocabulary")
def tfidf_idf(spark, folder):
    return rounded(terms.fit_vocabulary(with_terms(spark, folder), CONFIG, "content").select("term", "df", "idf"), "idf")


@check(
    "tfidf",
    VOCABULARY
    + """, raw AS (SELECT doc_id, term, tf.tf * idf AS weight FROM tf JOIN vocabulary v USING (term))
    SELECT doc_id, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
)
def tfidf(spark, folder):
    rows = with_terms(spark, folder)
    vocabulary = terms.fit_vocabulary(rows, CONFIG, "content")
    vectors = terms.term_pipeline(vocabulary).transform(terms.known_terms(rows, vocabulary))
    return rounded(terms.term_weights(vectors, vocabulary), "weight")


@check(
    "naive_bayes",
    VOCABULARY
    + """, weights AS (SELECT doc_id, label, term, tf.tf FROM tf JOIN vocabulary v USING (term)),
  priors AS (SELECT label, ln(count(*) / (SELECT count(*) FROM doc_meta)) AS log_prior FROM tokens GROUP BY 1),
  per_class AS (SELECT label, sum(tf) AS total FROM weights GROUP BY 1),
  per_term AS (SELECT label, term, sum(tf) AS n FROM weights GROUP BY 1, 2),
  likelihoods AS (SELECT c.label, v.term, ln((coalesce(n, 0) + 1) / (total + (SELECT count(*) FROM vocabulary))) AS log_likelihood
    FROM per_class c CROSS JOIN vocabulary v LEFT JOIN per_term t ON t.label = c.label AND t.term = v.term),
  evidence AS (SELECT doc_id, l.label, sum(w.tf * log_likelihood) AS score FROM weights w JOIN likelihoods l USING (term) GROUP BY 1, 2),
  scores AS (SELECT t.doc_id, p.label, log_prior + coalesce(score, 0) AS score FROM tokens t CROSS JOIN priors p
    LEFT JOIN evidence e ON e.doc_id = t.doc_id AND e.label = p.label),
  best AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place FROM scores)
  SELECT doc_id, min(label) FILTER (place = 1) AS category, round(1 / sum(exp(score - top)), 6) AS confidence FROM best GROUP BY 1""",
)
def naive_bayes(spark, folder):
    rows = with_terms(spark, folder)
    vocabulary = terms.fit_vocabulary(rows, CONFIG, "content")
    # Narrow next to the texts, and needed for training and for scoring.
    vectors = reliable(
        terms.term_pipeline(vocabulary, "count").transform(terms.known_terms(rows, vocabulary)).select("doc_id", "label", "term_vector")
    )
    return rounded(bayes.score_bayes(vectors, *bayes.fit_bayes(vectors, vocabulary)), "confidence")


@check("naive_bayes_blocks", ORACLES["naive_bayes"])
def naive_bayes_blocks(spark, folder):
    """The same with the model as a table: blocks of few classes and of many documents meet."""
    rows = with_terms(spark, folder)
    vocabulary = terms.fit_vocabulary(rows, CONFIG, "content")
    vectors = reliable(
        terms.term_pipeline(vocabulary, "count").transform(terms.known_terms(rows, vocabulary)).select("doc_id", "label", "term_vector")
    )
    model = bayes_blocks.fit_bayes_blocks(vectors, vocabulary)
    return rounded(bayes_blocks.score_bayes_blocks(vectors, model, classes=2), "confidence")


# Few trees and iterations: these queries show the jobs, not the best model.
def quick_learners():
    return learners.estimators(trees=10, iterations=10, boosting=2)


def named(spark, folder):
    """File names of the documents, with labels that the names do not always tell."""
    return spark_view(spark, folder, "doc_meta").select(
        "doc_id", "filename", F.expr("CASE WHEN doc_id % 4 = 0 THEN lang ELSE label END AS label")
    )


GROUPED = "concat('g', CAST((doc_id * 7) % 16 % 4 AS STRING))"
MODELS = ("Random Forest", "Gradient Boosting", "Logistic Regression", "SVM", "Naive Bayes")


@check(
    "train_models",
    f"""WITH sizes AS (SELECT {GROUPED} AS label, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS test FROM documents GROUP BY 1),
  splits AS (SELECT 'test' AS split, sum(test) AS n FROM sizes UNION ALL SELECT 'train', sum(n - test) FROM sizes)
  SELECT model, split, CAST(n AS BIGINT) AS n, TRUE AS between_0_and_1, TRUE AS not_below_majority
  FROM splits, (VALUES {', '.join(f"('{name}')" for name in MODELS)}) m(model)""",
)
def train_models(spark, folder):
    """All five learners on four classes that the names tell: sizes of the splits, and accuracies against the majority's share."""
    docs = spark_view(spark, folder, "doc_meta").select("doc_id", "filename", F.expr(GROUPED).alias("label"))
    trained = learning.train(docs, quick_learners(), CONFIG)
    most = trained.predictions.groupBy("model", "split", "label").count().groupBy("model", "split")
    share = most.agg((F.max("count") / F.sum("count")).alias("share"))
    return trained.accuracy.join(share, ["model", "split"]).select(
        "model",
        "split",
        "n",
        F.col("accuracy").between(0, 1).alias("between_0_and_1"),
        (F.col("accuracy") >= F.col("share")).alias("not_below_majority"),
    )


def _crossed(spark, folder):
    """Orders at places that follow from their numbers; the class is told by the quarter, which no straight line does."""
    from pyspark.ml.feature import VectorAssembler

    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    placed = orders.select("o_orderkey", (F.col("o_orderkey") * 37 % 101 / 50 - 1).alias("x"), (F.col("o_orderkey") * 53 % 103 / 51 - 1).alias("y"))
    classed = placed.withColumn("label_encoded", (F.col("x") * F.col("y") > 0).cast("double"))
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(classed)


@check(
    "kernel_svm",
    """SELECT (o_orderkey * 37 % 101 / 50.0 - 1) * (o_orderkey * 53 % 103 / 51.0 - 1) > 0 AS same_sign, count(*) AS n,
      TRUE AS nine_in_ten_right, TRUE AS linear_is_not, TRUE AS chances_sum_to_1 FROM orders GROUP BY 1""",
)
def kernel_svm(spark, folder):
    """A class by quarters of a square: the radial kernel tells it, a linear model does not."""
    rows = _crossed(spark, folder)
    train = rows.filter("o_orderkey % 2 = 0")
    linear = learners.estimators(iterations=50)["Logistic Regression"].fit(train).transform(rows)
    # Over both classes: a model that always says the same is right for one of them.
    linear = linear.agg((F.avg((F.col("prediction") == F.col("label_encoded")).cast("int")) < 0.7).alias("linear_is_not"))
    scored = KernelSVM(iterations=50).fit(train).transform(rows)
    total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b)
    found = scored.groupBy((F.col("label_encoded") == 1).alias("same_sign")).agg(
        F.count("*").alias("n"),
        (F.avg((F.col("prediction") == F.col("label_encoded")).cast("int")) >= 0.9).alias("nine_in_ten_right"),
        F.bool_and(F.abs(total - 1) < 1e-9).alias("chances_sum_to_1"),
    )
    return found.crossJoin(linear)


@check(
    "softmax_boosting",
    """SELECT round, TRUE AS loss_falls, TRUE AS starts_at_the_shares, TRUE AS scores_give_the_last_loss, classes
    FROM range(1, 6) r(round), (SELECT count(DISTINCT label) AS classes FROM (SELECT CASE WHEN (o_orderkey * 37 % 101 / 50.0 - 1) * (o_orderkey * 53 % 103 / 51.0 - 1) <= 0 THEN 0
      WHEN o_orderkey * 37 % 101 > 50 THEN 1 ELSE 2 END AS label FROM orders))""",
)
def softmax_boosting(spark, folder):
    """Five rounds over three classes: the training loss after each, and the loss recomputed from the model's probabilities."""
    rows = _crossed(spark, folder).withColumn("label_encoded", F.expr("CASE WHEN label_encoded = 0 THEN 0 WHEN x > 0 THEN 1 ELSE 2 END").cast("double"))
    model = SoftmaxBoosting(rounds=5, depth=3).fit(rows)
    losses = model.getOrDefault("losses")
    shares = rows.groupBy("label_encoded").count().agg(F.collect_list("count").alias("n"), F.sum("count").alias("total"), F.count("*").alias("classes"))
    entropy = F.aggregate("n", F.lit(0.0), lambda a, n: a - n / F.col("total") * F.log(n / F.col("total")))
    chance = F.get(vector_to_array("probability"), F.col("label_encoded").cast("int"))
    again = model.transform(rows).agg(F.avg(-F.log(chance)).alias("again"))
    steps = spark.createDataFrame([(n, now < before) for n, (before, now) in enumerate(zip(losses, losses[1:]), 1)], "round long, loss_falls boolean")
    return steps.crossJoin(shares).crossJoin(again).select(
        "round",
        "loss_falls",
        (F.abs(entropy - losses[0]) < 1e-9).alias("starts_at_the_shares"),
        (F.abs(F.col("again") - losses[-1]) < 1e-9).alias("scores_give_the_last_loss"),
        "classes",
    )


def quick_forest(spark, folder):
    only = {name: learner for name, learner in quick_learners().items() if name == "Random Forest"}
    return learning.train(named(spark, folder), only, CONFIG)


def is_known(trained):
    return F.col("category").isin(trained.labels)


@check(
    "ml_predict",
    "SELECT doc_id, TRUE AS known, TRUE AS sure, CAST(0.001 AS DOUBLE) AS cost, 'ML prediction using Random Forest' AS reasoning FROM documents",
)
def ml_predict(spark, folder):
    """A known category for every document, a confidence no lower than that of an even guess, cost and reason."""
    trained = quick_forest(spark, folder)
    docs = spark_view(spark, folder, "doc_meta")
    found = learning.ml_predict(
        docs, trained.assembly, trained.best, trained.models[trained.best], trained.labels, CONFIG
    )
    sure = F.col("confidence").between(1 / len(trained.labels) - 1e-9, 1)
    return found.select("doc_id", is_known(trained).alias("known"), sure.alias("sure"), "cost", "reasoning")


@check("predict_filenames", "SELECT page_id, TRUE AS known FROM pages")
def predict_filenames(spark, folder):
    """Labels for file names that were not trained on: the addresses of the web pages."""
    trained = quick_forest(spark, folder)
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(F.col("page_id").alias("doc_id"), "url")
    found = learning.ml_predict(
        pages, trained.assembly, trained.best, trained.models[trained.best], trained.labels, CONFIG, text="url"
    )
    return found.select(F.col("doc_id").alias("page_id"), is_known(trained).alias("known"))


@check(
    "feature_importance",
    "SELECT unnest(range(1, 21)) AS place, TRUE AS named, TRUE AS between_0_and_1, TRUE AS in_order",
)
def feature_importance(spark, folder):
    """The twenty most important features: named, between 0 and 1, falling."""
    trained = quick_forest(spark, folder)
    rows = learners.feature_importance(trained.models["Random Forest"], trained.feature_names, spark)
    order = Window.orderBy(F.col("importance").desc(), "feature")
    return rows.select(
        F.row_number().over(order).cast("long").alias("place"),
        F.col("feature").isin(trained.feature_names).alias("named"),
        F.col("importance").between(0, 1).alias("between_0_and_1"),
        (F.col("importance") <= F.coalesce(F.lag("importance").over(order), F.lit(1.0))).alias("in_order"),
    )


@check("model_roundtrip", "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS different FROM documents")
def model_roundtrip(spark, folder):
    """The models read back predict for every document what the trained ones do."""
    trained = quick_forest(spark, folder)
    path = fresh_path(spark, "models")
    learners.save_models(
        path, trained.assembly, trained.models, trained.labels, trained.best, spark, trained.feature_names, CONFIG
    )
    assembly, models, labels, best = learners.load_models(path, spark)
    names, config = learners.load_settings(path, spark)
    assert (names, config) == (trained.feature_names, CONFIG)
    docs = spark_view(spark, folder, "doc_meta")
    before = learning.ml_predict(
        docs, trained.assembly, trained.best, trained.models[trained.best], trained.labels, CONFIG
    )
    after = learning.ml_predict(docs, assembly, best, models[best], labels, config)
    pairs = before.join(after.select("doc_id", F.struct("category", "confidence").alias("after")), "doc_id", "left")
    different = ~F.struct("category", "confidence").eqNullSafe(F.col("after"))
    return pairs.agg(F.count("*").alias("documents"), F.count_if(different).alias("different"))


def examples(spark, folder):
    """Examples whose confidence the features tell: long words make the cheap model less sure."""
    docs = with_features(spark_view(spark, folder, "doc_meta"))
    sure = F.greatest(F.lit(0.1), F.least(F.lit(0.9), 1.2 - F.col("features.avg_word_length") / 10))
    return docs.select("doc_id", "ts_s", "features", sure.alias("ml_confidence"))


@check(
    "train_confidence",
    "SELECT count(*) AS examples, TRUE AS better_than_the_mean, TRUE AS ordered FROM documents",
)
def confidence_quality(spark, folder):
    rows = reliable(examples(spark, folder))
    model = train_confidence(rows, ["ts_s", "doc_id"])
    variance = rows.agg(F.var_pop("ml_confidence")).first()[0]
    return spark.createDataFrame(
        [(model.examples, model.mse <= variance, model.mae**2 <= model.mse)],
        "examples long, better_than_the_mean boolean, ordered boolean",
    )


@check("predict_confidence", "SELECT doc_id, TRUE AS in_range, TRUE AS same FROM documents")
def confidence(spark, folder):
    """A forecast for every document within the bounds, and the same from the predictor read back."""
    rows = reliable(examples(spark, folder))
    model = train_confidence(rows, ["ts_s", "doc_id"], iterations=5, depth=3)
    path = fresh_path(spark, "predictor")
    save_confidence(model, path, spark)
    before, after = predict_confidence(rows, model), predict_confidence(rows, load_confidence(path, spark))
    pairs = before.select("doc_id", "predicted").join(after.select("doc_id", F.col("predicted").alias("again")), "doc_id")
    return pairs.select(
        "doc_id", F.col("predicted").between(0.1, 0.95).alias("in_range"), F.col("predicted").eqNullSafe(F.col("again")).alias("same")
    )


@check(
    "predict_confidence_untrained",
    sql_views("doc_meta") + " SELECT doc_id, CAST(0.6 AS DOUBLE) AS predicted FROM doc_meta",
)
def untrained_confidence(spark, folder):
    return predict_confidence(examples(spark, folder)).select("doc_id", "predicted")
