"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Everything is a DataFrame expression or Spark's own learner: no Python runs on the
executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters",
    "hyphens", "secure", "suffix_log", "suffix_rate", "segment_rate",
]


@dataclass(frozen=True)
class Rule:
    """`target` is a host and the beginning of a path, like `example.net/en/`; fits the host and its subdomains."""

    target: str
    verdict: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return self.target[len(self.host) :]


@dataclass(frozen=True)
class TreeConfig:
    """`train_rows` bounds the labelled sample the trees are fitted on; statistics cover all labelled rows."""

    train_rows: int = 20_000
    trees: int = 20
    depth: int = 4
    smoothing: float = 10.0
    seed: int = 42


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without `://`."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """`value(rule)` of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.target)):
        on_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.when(on_host & F.startswith(path, F.lit(rule.path)), F.lit(value(rule))).otherwise(found)
    return found


def lexical_features(df: DataFrame) -> DataFrame:
    """Adds the features that one address gives by itself; needs url, host and path."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    symbols = F.array_distinct(F.split(url, ""))
    # Shannon entropy of the characters: log2 n - (sum of c log2 c) / n.
    weight = F.aggregate(
        symbols,
        F.lit(0.0),
        lambda total, symbol: total
        + F.when(
            symbol != "", (F.length(url) - F.length(F.replace(url, symbol, F.lit("")))).cast("double")
        ).otherwise(0.0)
        * F.log2(F.greatest(F.length(url) - F.length(F.replace(url, symbol, F.lit(""))), F.lit(1)).cast("double")),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.regexp_count("path", F.lit("/+[^/]+")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
            "entropy": F.log2(size.cast("double")) - weight / size,
            "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "secure": F.startswith(F.lower(url), F.lit("https:")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "segment": F.regexp_extract("path", "^/+([^/]*)", 1),
        }
    )


def _with_rates(df: DataFrame, labelled: DataFrame, smoothing: float) -> DataFrame:
    """Adds how common a suffix is and the smoothed share of blocked addresses of its suffix and first segment."""
    for name in ("suffix", "segment"):
        rate = (F.sum("label") + F.lit(smoothing / 2)) / (F.count("*") + F.lit(smoothing))
        rates = kept(labelled.groupBy(name).agg(rate.alias(f"{name}_rate")), f"url-{name}")
        df = df.join(rates, name, "left").withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(0.5)))
    common = kept(df.groupBy("suffix").agg(F.log(F.count("*").cast("double")).alias("suffix_log")), "url-suffix")
    return df.join(common, "suffix")


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", config: TreeConfig = TreeConfig()) -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    The verdict is that of the longest fitting rule, else that of the trees, which
    learn from the addresses that rules decide: a sample of at most `train_rows` of
    them, by the hash of the address; rates and counts come from all rows. If rules
    decide nothing every address is allowed; if all their verdicts are alike, so are
    the trees'. A null address has empty parts and is judged like any other.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule = rule_of(F.col("host"), F.col("path"), rules, lambda r: r.target)
    verdict = rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    rows = kept(lexical_features(rows.withColumns({"rule": rule, "ruled": verdict})), "url-features")
    labelled = rows.filter("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double"))
    full = _with_rates(rows, labelled, config.smoothing)
    label = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("double"))
    full = kept(full.withColumn("label", label), "url-rows")
    known = full.filter("label IS NOT NULL").orderBy(F.xxhash64("url"), "id").limit(config.train_rows)
    sample = kept(known.select("label", *FEATURES).repartition(4), "url-sample")
    blocked, count = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).head()
    named = F.col("id").alias(key), "host", "path", "rule"
    if blocked in (0, count):
        only = "block" if count and blocked == count else "allow"
        return full.select(*named, F.coalesce("ruled", F.lit(only)).alias("verdict"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    learner = GBTClassifier(maxIter=config.trees, maxDepth=config.depth, seed=config.seed, stepSize=0.2)
    model = learner.fit(assemble.transform(sample).select("label", "features"))
    judged = model.transform(assemble.transform(full.filter("label IS NULL")))
    guess = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    decided = full.filter("label IS NOT NULL").select(*named, F.col("ruled").alias("verdict"))
    return decided.unionByName(judged.select(*named, guess.alias("verdict")))
