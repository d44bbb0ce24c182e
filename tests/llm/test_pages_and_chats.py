"""Operators over pages, vectors and conversations against plain loops, on awkward rows and on the smallest tables."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsluice.llm import langid
from docsluice.llm.chat import preference_pairs
from docsluice.llm.queries import ORACLES, QUERIES, RULES
from docsluice.llm.topk import top_k, usable
from docsluice.llm.urls import judge_urls
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])[:2] == []


def test_fused_language_of_awkward_pages(spark):
    words = {"en": "the and of that with this is to be in", "de": "der die und nicht ist ein mit für auf den", "fr": "le la et de que pour dans une est les"}
    training = spark.createDataFrame([(" ".join([text] * 30), lang) for lang, text in words.items()] + [(None, "en"), ("x", None)], "text string, lang string")
    model = langid.train(training)
    assert model.languages == ("de", "en", "fr")
    pages = [
        (1, f"<html lang=en><script>der die und</script>{words['en']}</html>", "en", "http://a.example.com/"),
        (2, words["de"], "en", "https://b.example.de/x"),
        (3, None, None, None),
        (4, "", "de", "no address"),
        (5, "12 34 %% 5", "fr", "http://c.fr"),
        (6, "zq0xjv kqzxw vxqj wqk zzxq jjqx", "en", "http://a.example.com/"),
        (7, words["fr"] * 2000, "xx", "http://c.fr?x"),
        (7, words["fr"] * 2000, "xx", "http://c.fr?x"),
        (None, words["de"], None, "http://b.example.de"),
    ]
    frame = spark.createDataFrame(pages, "id long, text string, declared string, url string")
    rows = langid.identify(frame.withColumn("place", langid.host_levels(F.col("url"))), model, html=True).collect()
    found = sorted((str(row["id"]), row["language"]) for row in rows)
    assert found == sorted([("1", "en"), ("2", "de"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "und"), ("7", "fr"), ("7", "fr"), ("None", "de")])
    assert all(row["accepted"] == (row["language"] != "und") for row in rows)
    empty = frame.filter("false").withColumn("place", langid.host_levels(F.col("url")))
    assert langid.identify(empty, model).count() == 0
    nothing = langid.train(training.filter("lang IS NULL"))
    assert {r["language"] for r in langid.identify(frame.withColumn("place", langid.host_levels(F.col("url"))), nothing).collect()} == {"und"}


def test_host_prior_decides_a_short_text(spark):
    model = langid.TextModel(("aa", "bb"), np.tile(np.log(np.array([2e-5, 2e-5, 1.5e-5])), (langid.SLOTS, 1)).astype(np.float32))
    even = langid.identify(
        spark.createDataFrame([(1, "some words", "aa", "x.example.com")], "id long, text string, declared string, url string").withColumn(
            "place", langid.host_levels(F.concat(F.lit("http://"), "url"))
        ),
        model,
    ).head()
    assert even["host"] == "x.example.com" and even["declared"] == "aa"


def test_language_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter("doc_id % 5 <> 0"))
    held = docs.filter("doc_id % 5 = 0").select(
        F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), langid.host_levels(F.lit("")).alias("place")
    )
    found = langid.identify(held, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert found.filter("language = lang").count() >= 0.97 * found.count()


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def plain_rule(host, path):
    best = None
    for rule in RULES:
        fits = (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)
        if fits and (best is None or len(rule.target) > len(best.target)):
            best = rule
    return best


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://Example.NET/en/a?x#y", "http://a.example.net/de/", "http://net", "http://net/", "http://xnet/",
        "HTTP://EXAMPLE.com/de/x", "http://example.com/de", "http://ÄB.org/fr/é?", "a://b://c.org/fr/", "http://org/fr/#/x", "http://x.org?/fr/",
        "http://example.net/en/" + "a" * 50_000, "http://example.net/en/\nx", "://", "http://a.b.com/q?a=1&b=2&&c", "http://a.b.com/q?a=1&b=2&&c",
    ]
    pages = spark.createDataFrame([(n % 17, url, "x", 1.0, "s") for n, url in enumerate(urls)], "page_id long, url string, path string, label double, suffix string")
    for frame in (pages, spark.read.parquet("/root/testdata/sf0.01/pages.parquet")):
        given = {(row["page_id"], *plain_parts(row["url"])) for row in frame.select("page_id", "url").collect()}
        rows = judge_urls(frame, RULES).collect()
        assert len(rows) == frame.count()
        assert {(row["page_id"], row["host"], row["path"]) for row in rows} == given
        for row in rows:
            rule = plain_rule(row["host"], row["path"])
            assert row["rule"] == (rule.target if rule else None)
            assert row["verdict"] == rule.verdict if rule else row["verdict"] in ("allow", "block")
    assert judge_urls(pages.filter("false"), RULES).count() == 0
    assert {row["verdict"] for row in judge_urls(pages, []).collect()} == {"allow"}


def test_url_trees_learn_what_rules_say(spark):
    """Rules that only differ in features the trees see are recovered on addresses no rule decides."""
    rows = [(n, f"http://h{n % 50}.{'spam' if n % 2 else 'good'}.test/{'a-' * (9 if n % 2 else 1)}{n}") for n in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    from docsluice.llm.urls import Rule

    rules = [Rule(f"h{n}.{kind}.test/", verdict) for n in range(40) for kind, verdict in (("spam", "block"), ("good", "allow"))]
    found = judge_urls(pages, rules).filter("rule IS NULL").collect()
    assert len(found) == 400
    assert sum((row["verdict"] == "block") == (row["page_id"] % 2 == 1) for row in found) >= 380


def plain_top(rows, k):
    scored = defaultdict(list)
    for query, asks, q in rows:
        if asks:
            scored[query] += [(-sum(a * b for a, b in zip(q, v)), key) for key, _, v in rows if key != query and len(v) == len(q)]
    return {query: [(key, -score) for score, key in sorted(found)[:k]] for query, found in scored.items() if found}


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k(spark, block):
    draw = np.random.default_rng(1)
    rows = [(n, n % 7 == 0, draw.integers(-50, 50, 12).tolist()) for n in range(150)]
    rows += [(200 + n, n == 3, [3] * 12) for n in range(40)] + [(300, True, [0] * 12), (301, False, [0] * 12)]
    # Another dimension, alone in it, repeated rows, and a key with different vectors, one of them not asking.
    rows += [(401, True, [1, 2]), (403, False, [5, 1]), (403, False, [5, 1]), (404, True, [7] * 3), (0, True, rows[0][2])]
    rows += [(7, True, draw.integers(-50, 50, 12).tolist()), (8, True, [1, 1]), (8, False, [2] * 12)]
    odd = [(400, True, None), (402, True, []), (None, True, [1] * 12)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, asks boolean, vector array<long>").withColumns(
        {name: F.lit(1) for name in ("id", "v", "block", "length", "score", "rank")}
    )
    found = defaultdict(list)
    for row in sorted(top_k(frame, F.col("asks"), 5, block=block).collect(), key=lambda r: r["rank"]):
        found[row["query_id"]].append((row["vec_id"], row["score"]))
    assert dict(found) == plain_top(rows, 5)
    assert top_k(frame.filter("false"), F.col("asks")).count() == 0
    few = top_k(spark.createDataFrame(rows[:3], "vec_id long, asks boolean, vector array<long>"), F.lit(True), 5).count()
    assert few == 6


def test_top_k_of_mixed_dimensions_equals_sql(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = [(n % 120, draw.normal(0, 1, 3 if n % 5 else 4).tolist()) for n in range(200)]
    rows += rows[:60] + [(50, None), (100, [0.5, None, 1.0]), (100, [float("nan")] * 3), (150, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert differences(QUERIES["op2_top_k"](spark, str(tmp_path)), connection, ORACLES["op2_top_k"])[:2] == []


def test_scores_beyond_53_bits_are_exact(spark):
    rows = [(1, True, [2**29, 1]), (2, False, [2**29, 3]), (3, False, [2**29, 2])]
    frame = spark.createDataFrame(rows, "vec_id long, asks boolean, vector array<long>")
    assert [(r["vec_id"], r["score"]) for r in top_k(frame, F.col("asks"), 2).orderBy("rank").collect()] == [(2, 2**58 + 3), (3, 2**58 + 2)]


def test_usable_vectors(spark):
    rows = [(1, [1.0, None]), (2, [float("nan")]), (3, [float("inf")]), (4, None), (5, []), (6, [0.5, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in frame.filter(usable(F.col("embedding"))).collect()] == [6]


def test_preference_pairs(spark):
    side = "pair_id long, turn long, role string, text string, part string, c boolean"
    turns = lambda pair, *texts: [(pair, n, "assistant" if n % 2 else "user", text, "x", True) for n, text in enumerate(texts)]
    chosen = turns(1, "q", "a", "q2", "good") + turns(2, "same", "same") + turns(3, "only") + turns(None, "n", "yes") + turns(5, "q", "long " * 40_000)
    rejected = turns(1, "q", "a", "q2", "bad", "more") + turns(2, "same", "same") + turns(None, "n", "no") + turns(4, "other") + turns(5, "q", "")
    chosen += chosen[:2]
    found = preference_pairs(spark.createDataFrame(chosen, side), spark.createDataFrame(rejected, side)).collect()
    parts = defaultdict(str)
    for row in sorted(found, key=lambda r: (r["part"], r["turn"])):
        parts[row["pair_id"], row["part"]] += row["rendered"]
        assert row["masked_chars"] + row["trained_chars"] == len(row["rendered"])
        assert (row["trained_chars"] > 0) == (row["part"] != "prompt" and row["role"] == "assistant")
    u, a = "<|im_start|>user\n", "<|im_start|>assistant\n"
    end = "<|im_end|>\n"
    assert parts == {
        (1, "prompt"): f"{u}q{end}{a}a{end}{u}q2{end}", (1, "chosen"): f"{a}good{end}", (1, "rejected"): f"{a}bad{end}{u}more{end}",
        (2, "prompt"): f"{u}same{end}{a}same{end}", (3, "chosen"): f"{u}only{end}", (4, "rejected"): f"{u}other{end}",
        (None, "prompt"): f"{u}n{end}", (None, "chosen"): f"{a}yes{end}", (None, "rejected"): f"{a}no{end}",
        (5, "prompt"): f"{u}q{end}", (5, "chosen"): f"{a}{'long ' * 40_000}{end}", (5, "rejected"): f"{a}{end}",
    }
    nothing = spark.createDataFrame([], side)
    assert preference_pairs(nothing, nothing).count() == 0
