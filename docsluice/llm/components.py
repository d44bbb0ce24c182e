"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node that is not the smallest of its component; links are (a, b).

    Each half round links the larger (then the smaller) neighbours of every node
    to its smallest neighbour, until nothing changes: the logarithm of the size of a
    component many rounds. The smallest neighbour of a node is an aggregate; joins
    are between stored tables, so that a node with very many links is split.
    """
    edges = kept(_distinct(links.select("a", "b")), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = _star(edges, larger=True)
        edges = _star(edges, larger=False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _distinct(pairs: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node, once each, without loops."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 65_521))).head())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = kept(seen.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "links-least")
    met = seen.join(least, "a")
    if larger:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return kept(_distinct(moved), "links")
