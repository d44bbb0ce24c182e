"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents that belong to the same set of sources are alike to the mix, so one
aggregate turns the table into a small network: a node per membership pattern with
the words of its documents, a node per source with its quota, and an arc for every
membership. A pattern's words may be used up to `repeats` times; the first use costs
nothing, each further one more than the one before, so a flow of least cost repeats
as little as possible and spreads what must be repeated. The flow says how many
words of each pattern the mix takes; whole passes over a pattern go to all its
documents, the rest to the documents that come first in a seeded order.

Only sums by pattern and by hash prefix leave the executors: a row per pattern.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import kept
from docsluice.session import small_table

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights go round over the sources in their order; `repeats` bounds uses of a document."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    repeats: int = 3
    seed: int = 42


def word_count(text: str) -> Column:
    """Number of words of a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], mix: Mix, words: int | None = None) -> list[float]:
    """Quota of each source: shares of all words by weight, none above `repeats` times its own words.

    `words` is the size of the mix, by default that of all sources. What sources cannot take is shared again by weight among the others: with the
    right level every quota is the smaller of its bound and level times weight.
    """
    weights = [mix.weights[place % len(mix.weights)] for place in range(len(sizes))]
    bounds = [float(mix.repeats * size) for size in sizes]
    rest, weight, level = float(sum(sizes) if words is None else words), float(sum(weights)), 0.0
    for place in sorted(range(len(sizes)), key=lambda i: (bounds[i] / weights[i], i)):
        level = rest / weight
        if bounds[place] > level * weights[place]:
            break
        rest, weight = rest - bounds[place], weight - weights[place]
    return [min(bound, level * w) for bound, w in zip(bounds, weights)]


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[int]:
    """Words taken of each pattern; `patterns` holds (places of its sources, its words).

    Pass k over a pattern costs k - 1 a word. All arcs of one pass cost the same, so
    the least cost comes from the largest flow through first passes, then through
    second ones and so on; a word once taken may move to another source of its
    pattern, but is never given back.
    """
    taken, filled = [0] * len(patterns), [0] * len(quotas)
    flow: list[dict[int, int]] = [{} for _ in patterns]
    members: list[list[int]] = [[] for _ in quotas]
    for number, (sources, _) in enumerate(patterns):
        for source in sources:
            members[source].append(number)
    for passes in range(1, repeats + 1):
        for number, (sources, words) in enumerate(patterns):
            while taken[number] < passes * words:
                path = _path(patterns, sources, quotas, filled, members, flow)
                if path is None:
                    break
                last, moves = path[-1][1], list(zip(path, path[1:]))
                amount = min(
                    passes * words - taken[number],
                    quotas[last] - filled[last],
                    *[flow[via][here] for (_, here), (via, _) in moves],
                )
                taken[number] += amount
                filled[last] += amount
                flow[number][path[0][1]] = flow[number].get(path[0][1], 0) + amount
                for (_, here), (via, there) in moves:
                    flow[via][here] -= amount
                    flow[via][there] = flow[via].get(there, 0) + amount
    return taken


def _path(patterns, starts, quotas, filled, members, flow) -> list[tuple[int, int]] | None:
    """Shortest chain (-, source), (pattern, source), ... to a source with room.

    A step goes from a source over a pattern that holds words there to another source of that pattern.
    """
    came: dict[int, tuple[int, int] | None] = {source: None for source in starts}
    queue = list(starts)
    for source in queue:
        if filled[source] < quotas[source]:
            path = []
            while came[source] is not None:
                via, before = came[source]
                path.append((via, source))
                source = before
            return [(-1, source), *reversed(path)]
        for pattern in members[source]:
            if flow[pattern].get(source, 0) > 0:
                for other in patterns[pattern][0]:
                    if other not in came:
                        came[other] = (pattern, source)
                        queue.append(other)
    return None


def mix_sources(
    docs: DataFrame,
    sources: Column,
    size: Column | None = None,
    key: str = "doc_id",
    mix: Mix = Mix(),
    tag: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents and the sources.

    Documents, one row per input row: key, pattern, size, taken (words the mix takes,
    repeats counted). Sources: source, source_size, target. `sources` is the array of
    the sources a document belongs to; a null source is a source of its own, the last.
    `size` is a document's number of words, by default of the column `text`.
    Documents of size 0 are taken 0 times. Repeated rows stand next to each other in
    the seeded order and are told apart by nothing else. An empty table gives no rows.
    `tag`, a number the caller tells rows by, is handed through with the documents.
    """
    spark = docs.sparkSession
    salt = F.concat(F.lit(f"{mix.seed}-"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    named = F.transform(sources, lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name")))
    rows = kept(
        docs.select(
            F.col(key).alias("id"),
            (F.lit(None) if tag is None else tag).cast("long").alias("tag"),
            (word_count("text") if size is None else size).alias("size"),
            F.array_sort(F.array_distinct(named)).alias("pattern"),
            F.sha2(salt, 256).alias("place"),
        ),
        "mix-rows",
    )
    found = sorted(
        ([tuple(source) for source in row["pattern"]], row["words"])
        for row in rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect()
    )
    names = sorted({source for pattern, _ in found for source in pattern})
    places = {name: place for place, name in enumerate(names)}
    network = [(tuple(places[name] for name in pattern), words) for pattern, words in found]
    sizes = [sum(words for pattern, words in network if place in pattern) for place in range(len(names))]
    quotas = targets(sizes, mix, sum(words for _, words in network))
    taken = min_cost_flow(network, [math.floor(quota) for quota in quotas], mix.repeats)

    source_type = pa.struct([("none", pa.bool_()), ("name", pa.string())])
    plan = small_table(
        spark,
        (
            ([{"none": none, "name": name} for none, name in pattern], used // words if words else 0, used % words if words else 0)
            for (pattern, words), used in zip(found, taken)
        ),
        pa.schema([("pattern", pa.list_(source_type)), ("passes", pa.int64()), ("rest", pa.int64())]),
    )
    table = small_table(
        spark,
        ((None if none else name, size, quota) for (none, name), size, quota in zip(names, sizes, quotas)),
        pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64())]),
    )
    return _select(rows, plan).select(F.col("id").alias(key), "tag", "pattern", "size", "taken"), table


def _select(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds `taken`: all passes, and one more for the first documents until the rest of the pattern is spent.

    A document is among them if more than half of it still fits. The cut is found
    from sums over hash prefixes; only the rows of the one prefix that straddles it
    are put in order.
    """
    prefix = F.left("place", F.lit(3))
    sums = rows.groupBy("pattern", prefix.alias("prefix")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("prefix"))
    prefixes = kept(
        sums.join(plan, "pattern")
        .withColumn("before", upto - F.col("words"))
        .withColumn("left", F.col("rest") - F.col("before"))
        .select("pattern", "prefix", "passes", "left", ((F.col("left") > 0) & (F.col("left") < F.col("words"))).alias("cut")),
        "mix-prefixes",
    )
    placed = rows.withColumn("prefix", prefix).join(prefixes, ["pattern", "prefix"])
    whole = placed.filter(~F.col("cut")).withColumn("extra", F.col("left") > 0)
    order = Window.partitionBy("pattern", "prefix").orderBy("place", "id", "size", "tag")
    cut = (
        placed.filter("cut")
        .withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("extra", 2 * F.col("before") + F.col("size") <= 2 * F.col("left"))
        .drop("before")
    )
    return whole.unionByName(cut).withColumn("taken", F.col("size") * (F.col("passes") + F.col("extra").cast("long")))
