"""The trie of conversation prefixes by ROLLUP over columns of turn ids.

A turn is told by 128 bits of the SHA-256 of its role and text. Conversations that are
alike in all turns (two sums of hashes over places and turns, and the length) are one
sequence with a weight. The first turns of every sequence become columns, and one
ROLLUP over them aggregates the prefixes of all lengths together; grouping_id tells how
long each is. A second ROLLUP over the nodes found sums what lies in every subtree.

Sequences longer than a block of columns go on in another block, keyed by the node they
have reached, as long as that node has other sequences too. What only one sequence
reaches does not branch any more: there every turn is a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import kept
from docsluice.operators.ordering import running_totals
from docsluice.session import bounded

WORDS = r"[^\x20\x09-\x0D]+"
# Conversation ids are gathered in ranges of this many; longer lists are hashed as a stream of ranges.
RANGE = 256
# From so many rows on, what meets at one node is joined by a broadcast of such nodes.
CROWD = 1_000
TURN = "struct<id:binary,words:bigint>"
NOBODY = hashlib.sha256().hexdigest()


@dataclass(frozen=True)
class Blocks:
    """Columns of the first block and of those after it."""

    first: int = 8
    later: int = 32


def ordered_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Narrow rows (conv, place from 0, id, words) of all turns; null role and text count as empty.

    Turns are ordered by number, null first, ties by digest. Rows without a conversation
    are left out, repeated rows are turns of their own. Places come from counts over
    ranges of the whole order, so that no conversation has to fit a task.
    """
    said_by, said = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(said_by).cast("string"), F.lit(":"), said_by, said), 256)), 1, 16)
    rows = conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        digest.alias("id"),
        F.regexp_count(said, F.lit(WORDS)).cast("long").alias("words"),
    )
    placed = running_totals(kept(rows, "trie-rows"), ["conv"], ["turn", "id"], {"place": F.lit(1)})
    return kept(placed.select("conv", F.col("place").cast("int").alias("place"), "id", "words"), "trie-turns")


def with_borrowed_heads(turns: DataFrame, step: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of conversation c - c % step: (turns, conversations).

    h = crc32(c) % (most + 1) turns of that conversation (all if fewer, none if absent)
    take the place of c's own first h turns. A conversation may end up without turns.
    """
    h, base = F.crc32(F.col("conv").cast("string")) % (most + 1), F.col("conv") - F.col("conv") % step
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = kept(convs.select("conv", "n", h.cast("int").alias("h"), base.alias("base")), "trie-conversations")
    heads = turns.filter((base == F.col("conv")) & (F.col("place") < most)).withColumnRenamed("conv", "base")
    borrowed = convs.join(heads, "base").filter("place < h").select("conv", "place", "id", "words")
    lent = convs.filter("conv = base").select("base", F.least("n", F.lit(most)).cast("int").alias("lent"))
    # Own turns keep their places but where fewer turns than h could be borrowed.
    gaps = convs.join(lent, "base", "left").withColumn("gap", F.col("h") - F.least("h", F.coalesce("lent", F.lit(0))))
    own = turns.filter(F.col("place") >= h).join(bounded(gaps.filter("gap > 0").select("conv", "gap")), "conv", "left")
    own = own.select("conv", (F.col("place") - F.coalesce("gap", F.lit(0))).cast("int").alias("place"), "id", "words")
    return kept(borrowed.unionByName(own), "trie-rebuilt"), convs.select("conv")


def prefix_trie(turns: DataFrame, convs: DataFrame, blocks: Blocks = Blocks()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_id.

    `turns` are (conv, place from 0 without gaps, id, words), `convs` (conv) has every
    conversation once, also those without turns. A node is a distinct sequence of the
    first `depth` turns, from the root of depth 0; its conversations are those that
    start with it, `conv_id` the smallest of them. Subtrees include their top;
    `saved_tokens` sums (n_convs - 1) * words of the last turn over the subtree.
    `ends_sha256` is over the ids of the conversations that end at the node. Without
    conversations there is no node.
    """
    smallest = convs.agg(F.min("conv")).head()[0]
    whole = _sequences(turns, convs, blocks.first)
    sequences, digests = kept(_alike(whole), "trie-sequences"), _end_digests(whole)
    active = sequences.withColumn("key", F.lit(smallest).cast("long"))
    start, levels, chains = 0, [], []
    while True:
        width = blocks.later if start else blocks.first
        found = kept(_nodes(active, start, width), "trie-nodes")
        end = start + width
        reached = found.filter(F.col("level") == width).select("key", *_columns(width), F.col("conv").alias("node"), "n_sequences")
        going = _met(_path(active.filter(F.col("n") > end), width), _path(reached, width), "n_sequences", ["node", "n_sequences"])
        used = sum((F.coalesce(F.col(f"t{i}.words"), F.lit(0)) for i in range(1, width + 1)), F.lit(0))
        going = kept(going.select("conv", "n", "weight", (F.col("rest") - used).alias("rest"), "node", "n_sequences"), "trie-going")
        chain = going.filter("n_sequences = 1")
        levels.append((start, width, found, chain))
        chains.append(_chain(turns, chain, end))
        going = going.filter("n_sequences > 1").select("conv", "n", "weight", "rest", F.col("node").alias("key"))
        if going.isEmpty():
            break
        start = end
        active = kept(_pivot(turns, going, start, blocks.later), "trie-block")

    parts, below = [], None
    for start, width, found, chain in reversed(levels):
        summed = kept(_subtrees(found, _ends_of(chain, below), start, width), "trie-subtrees")
        below = summed.filter("level = 0").select(F.col("key").alias("conv"), F.col("below").alias("children"), "n_leaves", "saved_tokens")
        parts.append(_with_parents(summed, start, width))
    nodes = parts[0]
    for part in [*parts[1:], *chains]:
        nodes = nodes.unionByName(part)
    return nodes.join(digests, "ends", "left").select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("sha256", F.lit(NOBODY)).alias("ends_sha256"),
        "turn_id",
    )


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def _turn_columns(first: int, width: int) -> list[Column]:
    turn = F.struct("id", "words")
    return [F.max(F.when(F.col("place") == first + i, turn)).cast(TURN).alias(f"t{i + 1}") for i in range(width)]


def _sequences(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """Every conversation with two sums that tell its turns, its length, its words and its first turns."""
    nothing = convs.select("conv", F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("words"))
    hashed = (F.when(F.col("place").isNotNull(), F.xxhash64(*parts)) for parts in (("place", "id"), ("id", F.lit("-"), "place")))
    one, two = (F.coalesce(F.bit_xor(value), F.lit(0)) for value in hashed)
    rows = turns.select("conv", "place", "id", "words").unionByName(nothing).groupBy("conv")
    return kept(
        rows.agg(F.count("place").alias("n"), one.alias("a"), two.alias("b"), F.sum("words").alias("rest"), *_turn_columns(0, width)), "trie-whole"
    )


def _alike(whole: DataFrame) -> DataFrame:
    """One row per sequence: its smallest conversation, n, weight (conversations), rest (words not yet in a block) and columns."""
    columns = [name for name in whole.columns if name.startswith("t")]
    return whole.groupBy("a", "b", "n").agg(
        F.min("conv").alias("conv"), F.count("*").alias("weight"), *[F.first(name).alias(name) for name in ("rest", *columns)]
    )


def _end_digests(whole: DataFrame) -> DataFrame:
    """ends (smallest conversation of a sequence), sha256 of its conversations; lists of several ranges are hashed as streams."""
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string"))
    ranges = whole.groupBy("a", "b", "n", F.floor(F.col("conv") / RANGE).alias("part")).agg(
        F.min("conv").alias("least"), F.array_join(ids, ",").alias("ids")
    )
    ranges = kept(ranges, "trie-ranges")
    lists = ranges.groupBy("a", "b", "n").agg(F.count("*").alias("parts"), F.min("least").alias("ends"), F.min("ids").alias("ids"))
    lists = kept(lists, "trie-lists")
    single = lists.filter("parts = 1").select("ends", F.sha2("ids", 256).alias("sha256"))
    long = lists.filter("parts > 1").select("a", "b", "n", "ends")
    streamed = ranges.join(bounded(long), ["a", "b", "n"]).select("ends", "part", F.col("ids").cast("binary").alias("ids"))
    streamed = streamed.repartition("ends").sortWithinPartitions("ends", "part")
    return kept(single.unionByName(streamed.mapInArrow(_hash_ranges, "ends long, sha256 string")), "trie-digests")


def _hash_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ranges of each list, which follow each other, joined by commas."""
    last, running = None, None
    for batch in batches:
        done = []
        for ends, ids in zip(batch.column("ends").to_pylist(), batch.column("ids")):
            if ends != last:
                if running is not None:
                    done.append((last, running.hexdigest()))
                last, running = ends, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_buffer())
        yield pa.RecordBatch.from_pydict({"ends": pa.array([x for x, _ in done], pa.int64()), "sha256": pa.array([x for _, x in done], pa.string())})
    if running is not None:
        yield pa.RecordBatch.from_pydict({"ends": pa.array([last], pa.int64()), "sha256": [running.hexdigest()]})


def _level(width: int) -> str:
    """Columns that are not rolled up, from grouping_id, whose lowest bits stand for the last columns."""
    return f"{width} - bit_count(grouping_id())"


def _real(rolled: DataFrame, width: int) -> DataFrame:
    """Groups that stand for a prefix: in others the last column is empty as sequences have ended before."""
    last = F.element_at(F.array(*[F.col(name) for name in _columns(width)]), F.greatest(F.col("level"), F.lit(1)))
    return rolled.withColumn("last", last).filter("level = 0 OR last IS NOT NULL")


def _nodes(active: DataFrame, start: int, width: int) -> DataFrame:
    """All prefixes inside a block, keyed by the node before it; the root belongs to the first block."""
    names = ", ".join(_columns(width))
    rolled = active.sparkSession.sql(
        f"""
        SELECT key, {names}, CAST({_level(width)} AS INT) AS level, min(conv) AS conv, CAST(sum(weight) AS BIGINT) AS n_convs,
          max(n) AS longest, count(*) AS n_sequences, min(struct(n, conv)) AS shortest
        FROM {{active}} GROUP BY key, ROLLUP({names})
        """,
        active=active,
    )
    depth = F.col("level") + start
    nodes = _real(rolled, width).withColumn("ends", F.when(F.col("shortest.n") == depth, F.col("shortest.conv"))).drop("shortest")
    return nodes.filter("level > 0") if start else nodes


def _subtrees(found: DataFrame, beyond: DataFrame, start: int, width: int) -> DataFrame:
    """Nodes with the sums over their subtrees, and a row of level 0 per key for what a block adds to the node before it."""
    depth = F.col("level") + start
    own = found.join(beyond, (F.col("level") == width) & (F.col("conv") == F.col("node")), "left").select(
        *found.columns,
        F.when(F.col("longest") == depth, 1).otherwise(F.coalesce("leaves_beyond", F.lit(0))).alias("leaves"),
        (
            F.when(F.col("level") > 0, (F.col("n_convs") - 1) * F.col("last.words")).otherwise(0) + F.coalesce("saved_beyond", F.lit(0))
        ).alias("saved"),
        F.coalesce("children_beyond", F.lit(0)).alias("beyond"),
    )
    names = ", ".join(_columns(width))
    at_level = ", ".join(f"count_if(level = {i})" for i in range(1, width + 1))
    rolled = own.sparkSession.sql(
        f"""
        SELECT key, {names}, CAST({_level(width)} AS INT) AS level, CAST(sum(leaves) AS BIGINT) AS n_leaves,
          CAST(sum(saved) AS BIGINT) AS saved_tokens, array({at_level}) AS at_level,
          min(struct(level, conv, n_convs, ends, beyond)) AS top
        FROM {{own}} GROUP BY key, ROLLUP({names})
        """,
        own=own,
    )
    below = F.when(F.col("level") < width, F.get("at_level", F.col("level"))).otherwise(F.col("top.beyond")).cast("long")
    return _real(rolled, width).withColumn("below", below).drop("at_level")


def _ends_of(chain: DataFrame, below: DataFrame | None) -> DataFrame:
    """What lies beyond the last nodes of a block: unbranched tails and the next block."""
    names = ["node", "children_beyond", "leaves_beyond", "saved_beyond"]
    tails = chain.select("node", F.lit(1).cast("long"), F.lit(1).cast("long"), (F.col("weight") - 1) * F.col("rest")).toDF(*names)
    return tails if below is None else tails.unionByName(below.toDF(*names))


def _path(rows: DataFrame, width: int | Column) -> DataFrame:
    """Adds two hashes over the key and the first `width` columns."""
    columns = [F.col(name) for name in rows.columns if name[0] == "t" and name[1:].isdigit()]
    used = [F.when(F.lit(i) < width, column["id"]) for i, column in enumerate(columns)]
    level = width if isinstance(width, Column) else F.lit(width)
    return rows.withColumns({"p": F.xxhash64("key", level, *used), "q": F.xxhash64(*reversed(used), level, F.lit("-"), "key")})


def _met(rows: DataFrame, nodes: DataFrame, size: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of the node of their path; nodes that many rows meet are looked up before any row is moved."""
    nodes = nodes.select("p", "q", F.col(size).alias("met_rows"), *[F.col(name).alias(f"met_{name}") for name in columns])
    crowded = bounded(nodes.filter(F.col("met_rows") > CROWD).select("p", "q", *[F.col(f"met_{name}").alias(f"crowd_{name}") for name in columns]))
    looked = rows.join(crowded, ["p", "q"], "left")
    missing = F.col(f"crowd_{columns[0]}").isNull()
    names = [name for name in rows.columns if name not in columns]
    at_once = looked.filter(~missing).select(*names, *[F.col(f"crowd_{name}").alias(name) for name in columns])
    joined = looked.filter(missing).join(nodes.filter(F.col("met_rows") <= CROWD), ["p", "q"])
    return at_once.unionByName(joined.select(*names, *[F.col(f"met_{name}").alias(name) for name in columns]))


def _with_parents(summed: DataFrame, start: int, width: int) -> DataFrame:
    """Node rows of a block; the parent of its first level is the node that keys it."""
    nodes = summed.filter("level > 0") if start else summed
    nodes = nodes.withColumns({name: F.col(f"top.{name}") for name in ("conv", "n_convs", "ends")})
    deep = _path(nodes.filter("level > 1"), F.col("level") - 1)
    parents = _path(nodes.filter(F.col("level").between(1, width - 1)), F.col("level")).select("p", "q", "below", F.col("conv").alias("parent"))
    deep = _met(deep, parents, "below", ["parent"])
    first = nodes.filter("level <= 1").withColumn("parent", F.when(F.col("level") == 1, F.col("key")))
    return deep.select(*first.columns).unionByName(first).select(
        "conv",
        (F.col("level") + start).alias("depth"),
        "parent",
        "n_convs",
        F.col("below").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        "ends",
        F.when(F.col("level") > 0, F.col("last.id")).alias("turn_id"),
    )


def _pivot(turns: DataFrame, going: DataFrame, start: int, width: int) -> DataFrame:
    """The next columns of sequences that go on."""
    part = turns.filter(F.col("place").between(start, start + width - 1))
    rows = part.join(bounded(going), "conv")
    return rows.groupBy("conv", "key", "n", "weight", "rest").agg(*_turn_columns(start, width))


def _chain(turns: DataFrame, chain: DataFrame, end: int) -> DataFrame:
    """Nodes of the tails that belong to one sequence only: a node per turn."""
    rows = turns.filter(F.col("place") >= end).join(bounded(chain.drop("node", "n_sequences")), "conv")
    several = rows.filter("weight > 1")
    if not several.isEmpty():
        before = running_totals(kept(several, "trie-tails"), ["conv"], ["place"], {"before": F.col("words")})
        rows = rows.filter("weight = 1").withColumn("before", F.lit(0).cast("long")).unionByName(before)
    else:
        rows = rows.withColumn("before", F.lit(0).cast("long"))
    last = F.col("place") + 1 == F.col("n")
    return rows.select(
        "conv",
        (F.col("place") + 1).alias("depth"),
        F.col("conv").alias("parent"),
        F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("rest") - F.col("before"))).alias("saved_tokens"),
        F.when(last, F.col("conv")).alias("ends"),
        F.col("id").alias("turn_id"),
    )
