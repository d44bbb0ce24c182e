"""Near-duplicate detection by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments, and every segment has a table. A fingerprint
enters, in each table, the entries of a small Hamming ball around its segment; those
that meet in an entry are compared in full. With 64 bits, links at three or fewer
differing bits, two segments and balls of radius one nothing is missed: one of the
segments differs in at most one bit. Of the ball only the segment itself and the
values with one more bit set are entered, as the other side flips the bit too. Longer
fingerprints (see `SIMILAR`) rest on many segments, one of which very probably agrees.

A large entry gives a tree that connects what it links, not all its pairs; where a link is
verified by the texts, pairs that trees with failed links leave out follow. Entries around a
segment value that very many different fingerprints share are not filled; their
members enter finer entries instead, by balls around pieces of the other segments.
That is exact only where balls around all pieces are; longer fingerprints keep such an
entry, cut into pairs of blocks.

Segments that agree only very probably miss pairs. With `complete` these are found too:
of sets that share enough, ordered alike, the heads must have elements in common, so
texts whose heads share nothing are left out, and the others meet by their rarest
shingles (see `missed_links`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.llm.common import as_bytes, binary_rows, forget, give_back, kept, noted
from docsluice.llm.components import components
from docsluice.operators.prefilter import likely_among
from docsluice.session import bounded

SEED = 42
ENTRY = "entry long, finer long, fp binary"
PAIR = "a binary, b binary"
# Bits of each byte value, lowest first.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


@dataclass(frozen=True)
class Scheme:
    """Shingle width in words, fingerprint length in 64-bit words, link distance, index.

    `finer` is the width of the pieces of the other segments that crowded entries
    (more than `crowded` fingerprints with that very segment) are refined by; with
    `similarity` they are cut into blocks of that size instead. With
    `similarity` a link counts only if the texts share that part of all their different
    shingles; `reach` is then no more than the way to candidates. `repeats` says whether
    a shingle counts as often as it occurs.
    """

    width: int = 3
    words: int = 1
    reach: int = 3
    segment: int = 32
    radius: int = 1
    finer: int = 16
    crowded: int = 2048
    similarity: float | None = None
    repeats: bool = True

    def __post_init__(self) -> None:
        if 64 % self.segment or self.segment % self.finer or self.radius not in (0, 1):
            raise ValueError("segments divide 64 bits, pieces divide segments, the radius is 0 or 1")


# Three bits of 64: exact.
CLOSE = Scheme()
# Texts that share four fifths of their five-word shingles differ in about 78 of 512 bits, give or take 8, so 96 leave
# hardly one out. At least one of 32 segments of 16 bits then agrees with a probability of 0.91 (0.975 at 0.85, 0.998 at 0.9).
SIMILAR = Scheme(width=5, words=8, reach=96, segment=16, radius=0, finer=16, similarity=0.8, repeats=False)

# Entries of at most so many fingerprints give all their links; beyond the second number no matrix of distances is made.
SMALL, MATRIX = 8, 1024
# Heads are so long that those of similar texts share this number of shingles, and this part of those of long texts: more to
# tell chance and common passages by, for a few entries more.
SHARED, PART = 8, 0.1


def fingerprint(text: bytes, scheme: Scheme = CLOSE) -> bytes:
    """SimHash of the word shingles of a text, highest bit first. The last word is that of plain 64-bit hashes."""
    return _print(_counted(text, scheme), scheme)


def _counted(text: bytes, scheme: Scheme) -> np.ndarray:
    hashes = _shingle_hashes(text, scheme.width)
    return hashes if scheme.repeats else np.unique(hashes)


def _print(hashes: np.ndarray, scheme: Scheme) -> bytes:
    if not len(hashes):
        return bytes(8 * scheme.words)
    counts = [_bit_counts(hashes)]
    for number in range(1, scheme.words):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * number * 0x632BE59BD9B4E019 & (2**64 - 1) | 1)
        counts.append(_bit_counts(mixed ^ (mixed >> np.uint64(32))))
    return np.packbits(2 * np.concatenate(counts) > len(hashes), bitorder="little").tobytes()[::-1]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    places = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(8) * 256
    return (np.bincount(places.ravel(), minlength=2048).reshape(8, 256)[:, :, None] * BYTE_BITS).sum(axis=1).ravel()


def _rows(docs: DataFrame, key: str, text: str, tag: Column | None) -> DataFrame:
    return docs.select(
        F.col(key).cast("long").alias("id"),
        (F.lit(None) if tag is None else tag).cast("long").alias("tag"),
        as_bytes(text).alias("text"),
    )


def fingerprints(rows: DataFrame, scheme: Scheme = CLOSE, heads: bool = False) -> DataFrame:
    """Per row of id, tag and text (bytes): id, tag, fp. A text without words has fingerprint 0.

    With `heads`, for schemes without repeats, also the `head` of its shingles and how many of
    them, `common` at least, the head of any similar text has too.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first, common = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = _counted(text, scheme)
                found.append(_print(hashes, scheme))
                if heads:
                    first.append(hashes[: _head(len(hashes), scheme)].view(np.int64))
                    # A similar text may be smaller by the same share, and its head shorter.
                    common.append(_told(_least(scheme.similarity * len(hashes)), scheme))
            columns = {"id": batch.column("id"), "tag": batch.column("tag"), "fp": pa.array(found, pa.binary())}
            if heads:
                columns |= {"head": pa.array(first, pa.list_(pa.int64())), "common": pa.array(common, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)
            give_back()

    return rows.mapInArrow(scan, "id long, tag long, fp binary" + (", head array<long>, common int" if heads else ""))


def _least(share: float) -> int:
    """The least whole number not below a share, up to what its computation is wrong by."""
    return int(np.ceil(share - 1e-6))


def _head(size: int, scheme: Scheme) -> int:
    """So many of the first of a set, however all are ordered, hold `_told` of those that it shares with a similar set."""
    return size - _least(scheme.similarity * size) + _told(size, scheme)


def _told(size: int, scheme: Scheme) -> int:
    """So many of what a set shares with a similar one its head holds; never fewer for a larger set."""
    return min(max(SHARED, int(PART * size)), _least(scheme.similarity * size))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme = CLOSE, tag: Column | None = None, complete: bool = False
) -> DataFrame:
    """One row per input row: key, fingerprint, component_id (smallest key reachable over links).

    Words are separated by ASCII white space, A-Z is lower-cased, whole texts are
    read. Equal texts always share a component, empty and null ones too. A null key
    takes part and never names a component, unless all keys of it are null. Other
    columns are not read; an empty table gives no rows. The fingerprint is in hex,
    the highest bit first. `tag`, a number the caller tells rows by, is handed
    through if given, with `first_tag`, that of the row that names the component.
    `complete`, for schemes with `similarity`, links all similar texts, also those whose
    fingerprints do not meet.
    """
    if complete and (scheme.similarity is None or scheme.repeats):
        raise ValueError("complete needs a scheme with similarity and without repeats")
    source = _rows(docs, key, text, tag)
    whole: list[str] = []
    with noted(whole):
        rows = heads = kept(fingerprints(source, scheme, complete), "simhash-rows")
    if complete:
        rows = kept(heads.select("id", "tag", "fp"), "simhash-rows")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "tag")
    nodes = kept(rows.groupBy("fp").agg(F.min(name).alias("first")), "simhash-nodes")
    if scheme.similarity is None:
        roots = components(links(nodes.select("fp"), scheme))
    else:
        roots = components(similar_links(source, nodes, scheme))
    members = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = kept(members, "simhash-members")
    if complete:
        close = kept(close_ends(heads, members), "simhash-close")
        forget(docs.sparkSession, whole)
        missed = kept(missed_links(source, close, scheme), "simhash-missed")
        if not missed.isEmpty():
            # The links are between roots, so no link is gone through again.
            moved = components(missed).select(F.col("node").alias("root"), F.col("root").alias("to"))
            members = members.join(moved, "root", "left").select("fp", "first", F.coalesce("to", "root").alias("root"))
            members = kept(members, "simhash-members")
    named = kept(members.groupBy("root").agg(F.min("first").alias("names")), "simhash-names")
    found = kept(members.select("fp", "root").join(named, "root").select("fp", "names"), "simhash-found")
    tags = [] if tag is None else ["tag", F.col("names.tag").alias("first_tag")]
    return rows.join(found, "fp").select(
        F.col("id").alias(key),
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.col("names.id").alias("component_id"),
        *tags,
    )


def links(fps: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """Links (a, b) that connect the different fingerprints that meet within reach of each other."""
    if scheme.similarity is not None:
        return _sorted(_blocks(fps, scheme)).mapInArrow(_compare(scheme), PAIR)
    entries = fps.mapInArrow(_enter(scheme), ENTRY)
    own = fps.mapInArrow(_own(scheme), "entry long").groupBy("entry").count()
    full = own.filter(F.col("count") > scheme.crowded).select("entry")
    hot = kept(full.mapInArrow(_around(scheme), "entry long").distinct(), "simhash-crowded")
    if not hot.isEmpty():
        finer = entries.join(hot, "entry", "left_semi").select("entry", "finer", "fp").mapInArrow(_refine(scheme), ENTRY)
        entries = entries.join(hot, "entry", "left_anti").select("entry", "finer", "fp").unionByName(finer)
    return _sorted(entries).mapInArrow(_compare(scheme), PAIR)


def _sorted(entries: DataFrame) -> DataFrame:
    return entries.repartition("entry", "finer").sortWithinPartitions("entry", "finer", "fp")


def similar_links(source: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) of similar texts that connect all that the similar ones among the pairs that meet within reach connect.

    The trees of large entries are verified first. A tree says nothing about the pairs it
    leaves out if one of its links fails, so then every other pair that meets within
    reach is verified too, unless its sides are connected already. Both sides of such a
    pair are in some tree, so no other fingerprint is looked at again.
    """
    tried = kept(links(nodes.select("fp"), scheme).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    ends = kept(tried.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes, "fp"), "simhash-ends")
    texts: list[str] = []
    with noted(texts):
        sets = _shingles(source, ends, scheme)
    held = kept(_verified(tried, sets, scheme), "simhash-held")
    if held.count() == tried.count():
        forget(nodes.sparkSession, texts)
        return held
    rooted = ends.select("fp").join(components(held).withColumnRenamed("node", "fp"), "fp", "left")
    rooted = kept(rooted.select("fp", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    labels = kept(rooted.select("root").distinct().withColumn("label", F.monotonically_increasing_id()), "simhash-labels")
    labelled = bounded(rooted.join(labels, "root").select("fp", "label"))
    met = _sorted(_blocks(ends.select("fp"), scheme).join(labelled, "fp"))
    apart = met.select("entry", "finer", "side", "label", "fp").mapInArrow(_apart(scheme), PAIR)
    others = kept(apart.distinct().join(tried, ["a", "b"], "left_anti"), "simhash-others")
    found = kept(held.unionByName(_verified(others, sets, scheme)), "simhash-held")
    forget(nodes.sparkSession, texts)
    return found


def close_ends(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The members (fp, first, root) whose heads share enough shingles with any others to be similar; rows hold the heads."""
    node = F.xxhash64("fp")
    heads = rows.select(node.alias("node"), "common", F.explode("head").alias("shingle"))
    again = kept(heads.groupBy("shingle").count().filter("count > 1").select("shingle"), "simhash-again")
    met = likely_among(heads, again, "shingle").groupBy("node").agg(F.count("*").alias("n"), F.min("common").alias("common"))
    close = bounded(met.filter("n >= common").select("node"))
    ends = members.withColumn("node", node).join(close, "node", "left_semi")
    return ends.select("fp", "node", "root", F.xxhash64("root").alias("label"), "first")


def missed_links(source: DataFrame, ends: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) between the roots of all similar texts that have different ones; ends are the `close_ends`.

    Shingles are ordered by the number of texts that have them: similar texts share one
    that is so rare that too few come before it. What either has left after it tells most
    chance pairs, the others are verified.
    """
    sets = _shingles(source, ends, scheme)
    size = F.size("shingles")
    each = sets.select(F.xxhash64("fp").alias("node"), size.alias("size"), F.explode("shingles").alias("shingle"))
    often = kept(each.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1"), "simhash-often")
    # Shingles that no other text has come first and are no place to meet at.
    own = Window.partitionBy("node")
    placed = each.join(often, "shingle").withColumn("place", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "shingle")))
    left = F.col("size") - F.col("place") + 1
    rarest = placed.filter(left >= scheme.similarity * F.col("size") - 1e-6).select("shingle", "node", "size", left.alias("left"))
    rarest = kept(rarest.join(bounded(ends.select("node", "label")), "node"), "simhash-rarest")
    one, other = (rarest.select("shingle", *[F.col(name).alias(f"{name}_{side}") for name in ("node", "size", "left", "label")]) for side in "ab")
    shared = F.least("left_a", "left_b") >= scheme.similarity / (1 + scheme.similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    pairs = one.join(other, "shingle").filter((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & shared)
    pairs = kept(pairs.select("node_a", "node_b").distinct(), "simhash-rare")
    named = [ends.select(F.col("node").alias(f"node_{side}"), F.col("fp").alias(side)) for side in "ab"]
    found = _verified(pairs.join(named[0], "node_a").join(named[1], "node_b").select("a", "b"), sets, scheme)
    for side in "ab":
        found = found.join(ends.select(F.col("fp").alias(side), F.col("root").alias(f"root_{side}")), side)
    return found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()


def _blocks(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Entries of all fingerprints: entry, finer, side, fp.

    A crowded entry is cut into blocks of about `crowded` fingerprints, and every two
    blocks, and every block with itself (side 0), are an entry of their own. So all its
    members still meet, but never in one place.
    """
    entries = fps.mapInArrow(_enter(scheme), ENTRY).select("entry", "fp")
    sizes = (entries if scheme.radius else fps.mapInArrow(_own(scheme), "entry long")).groupBy("entry").count()
    full = sizes.filter(F.col("count") > scheme.crowded)
    full = bounded(full.select("entry", F.ceil(F.col("count") / scheme.crowded).cast("long").alias("parts")))
    if full.isEmpty():
        return entries.select("entry", F.lit(-1).cast("long").alias("finer"), F.lit(0).alias("side"), "fp")
    parts, block, other = F.col("parts"), F.col("block"), F.col("other")
    cut = entries.join(full, "entry", "left").withColumn("block", F.pmod(F.xxhash64("fp"), parts))
    others = F.when(parts.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
    return cut.withColumn("other", F.explode(others)).select(
        "entry",
        F.when(parts.isNull(), -1).otherwise(F.least(block, other) * parts + F.greatest(block, other)).alias("finer"),
        F.when(parts.isNull() | (block == other), 0).when(block < other, 1).otherwise(2).alias("side"),
        "fp",
    )


def _ball(values: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of `bits` bits, with those that have one bit more if the radius is 1, and the row each belongs to."""
    if not radius:
        return values, np.arange(len(values))
    flips = np.int64(1) << np.arange(bits, dtype=np.int64)
    rows, columns = np.nonzero((values[:, None] & flips) == 0)
    return np.concatenate([values, values[rows] | flips[columns]]), np.concatenate([np.arange(len(values)), rows])


def _pieces(fp: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints (rows of bytes) cut into pieces of that many bits: 8, 16 or 32."""
    return fp.view({8: "u1", 16: ">u2", 32: ">u4"}[bits]).astype(np.int64)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {name: _binary(column) if column.ndim == 2 else pa.array(column) for name, column in columns.items()}
    )


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def _enter(scheme: Scheme):
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = binary_rows(batch.column("fp"), 8 * scheme.words)
            for number, values in enumerate(_pieces(fp, scheme.segment).T):
                entry, rows = _ball(values, scheme.segment, scheme.radius)
                yield _batch(entry=entry | (number << 32), finer=np.full(len(rows), -1), fp=fp[rows])

    return enter


def _own(scheme: Scheme):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = _pieces(binary_rows(batch.column("fp"), 8 * scheme.words), scheme.segment)
            yield _batch(entry=(pieces | (np.arange(pieces.shape[1]) << 32)).ravel())

    return own


def _around(scheme: Scheme):
    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = batch.column("entry").to_numpy()
            values, rows = _ball(entry & 0xFFFFFFFF, scheme.segment, scheme.radius)
            yield _batch(entry=values | (entry[rows] >> 32 << 32))

    return around


def _refine(scheme: Scheme):
    share = scheme.segment // scheme.finer

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, fp = batch.column("entry").to_numpy(), binary_rows(batch.column("fp"), 8 * scheme.words)
            for number, values in enumerate(_pieces(fp, scheme.finer).T):
                other = np.flatnonzero(entry >> 32 != number // share)
                finer, rows = _ball(values[other], scheme.finer, scheme.radius)
                yield _batch(entry=entry[other][rows], finer=finer | (number << 32), fp=fp[other][rows])

    return refine


def _compare(scheme: Scheme):
    """Links of each entry."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fp,), bounds in _entries(batches, 8 * scheme.words):
            yield from _linked(fp, bounds, scheme.reach)
        give_back()

    return compare


def _apart(scheme: Scheme):
    """All pairs of each entry within reach whose labels differ, the smaller first.

    Pairs that meet in several entries come from that of the first segment they share.
    """

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fp, side, label, entry), bounds in _entries(batches, 8 * scheme.words, "side", "label", "entry"):
            words, starts, pieces = fp.view("<u8"), bounds[:-1], _pieces(fp, scheme.segment)
            several = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts) if len(label) else starts < 0
            for at, end in zip(starts[several].tolist(), bounds[1:][several].tolist()):
                step = max(1, (1 << 18) // ((end - at) * words.shape[1]))
                for low in range(at, end - 1, step):
                    high = min(low + step, end)
                    met = _distance(words[low:high, None], words[None, at:end]) <= scheme.reach
                    met &= label[low:high, None] != label[None, at:end]
                    # Sides 1 and 2 meet each other only; the rows of an entry are sorted by fingerprint.
                    met &= (side[low:high, None] + side[None, at:end]) % 3 == 0
                    met &= np.arange(low, high)[:, None] < np.arange(at, end)
                    one, other = np.nonzero(met)
                    if not scheme.radius:
                        number = int(entry[at] >> 32)
                        earlier = (pieces[low + one, :number] == pieces[at + other, :number]).any(axis=1)
                        one, other = one[~earlier], other[~earlier]
                    if len(one):
                        yield _batch(a=fp[low + one], b=fp[at + other])
        give_back()

    return apart


def _entries(batches: Iterator[pa.RecordBatch], size: int, *names: str) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Fingerprints and further columns of whole entries, and their bounds; rows come sorted, the last entry of a batch waits for the next."""
    waiting = None
    for batch in batches:
        rows = [batch.column("entry").to_numpy(), batch.column("finer").to_numpy(), binary_rows(batch.column("fp"), size)]
        rows += [batch.column(name).to_numpy() for name in names]
        if waiting is not None:
            rows = [np.concatenate(pair) for pair in zip(waiting, rows)]
        new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        cut = new[-1] if len(new) else 0
        waiting = [column[cut:] for column in rows]
        if cut:
            yield [column[:cut] for column in rows[2:]], np.concatenate([[0], new])
    if waiting is not None and len(waiting[0]):
        yield waiting[2:], np.array([0, len(waiting[0])])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _linked(fp: np.ndarray, bounds: np.ndarray, reach: int) -> Iterator[pa.RecordBatch]:
    """Links inside the entries between neighbouring `bounds`: all of small entries, a tree of larger ones."""
    words, sizes = fp.view("<u8"), np.diff(bounds)
    pairs = []
    for size in range(2, SMALL + 1):
        starts = bounds[:-1][sizes == size]
        for i in range(size):
            for j in range(i):
                near = starts[_distance(words[starts + i], words[starts + j]) <= reach] if len(starts) else starts
                pairs.append((fp[near + i], fp[near + j]))
    for at, size in zip(bounds[:-1][sizes > SMALL], sizes[sizes > SMALL]):
        one, other = _tree(words[at : at + size], reach)
        pairs.append((fp[at + one], fp[at + other]))
    a, b = (np.concatenate(side) for side in zip(*pairs))
    if len(a):
        yield _batch(a=a, b=b)


def _tree(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within reach that connect all that is connected, each fingerprint by a near link."""
    if len(words) > MATRIX:
        return _fronts(words, reach)
    step = max(1, (1 << 18) // (len(words) * words.shape[1]))
    far = np.concatenate([_distance(words[n : n + step, None], words[None]) for n in range(0, len(words), step)])
    np.fill_diagonal(far, np.iinfo(np.int64).max)
    members = np.flatnonzero((far <= reach).any(axis=1))
    one, other = [], []
    if len(members):
        # The shortest link to what is not yet in the tree, again and again.
        far = far[np.ix_(members, members)]
        least, source = far[0].copy(), np.zeros(len(members), np.int64)
        out = np.ones(len(members), bool)
        out[0] = False
        while out.any():
            new = int(np.where(out, least, np.iinfo(np.int64).max).argmin())
            if not out[new]:
                new = int(out.argmax())
            if least[new] <= reach:
                one.append(members[source[new]])
                other.append(members[new])
            out[new] = False
            closer = far[new] < least
            least[closer], source[closer] = far[new][closer], new
    return np.array(one, np.int64), np.array(other, np.int64)


def _fronts(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many fingerprints: a search in growing fronts, each linked to the nearest of the front that met it.

    Every fingerprint is once in a front and compared with those not yet reached.
    """
    left, one, other = np.arange(len(words)), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (1 << 18) // (len(left) * words.shape[1]))
            least, source = np.full(len(left), np.iinfo(np.int64).max), np.zeros(len(left), np.int64)
            for at in range(0, len(front), step):
                differing = _distance(words[front[at : at + step], None], words[left][None])
                nearest = differing.argmin(axis=0)
                here = differing[nearest, np.arange(len(left))]
                closer = here < least
                least[closer], source[closer] = here[closer], front[at + nearest[closer]]
            near = least <= reach
            one.append(source[near])
            other.append(left[near])
            front, left = left[near], left[~near]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *one]), np.concatenate([empty, *other])


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = [0, *ends[:-width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def _shingles(source: DataFrame, ends: DataFrame, scheme: Scheme) -> DataFrame:
    """The different shingles of linked fingerprints; texts of linked rows alone are read for it."""
    ends = bounded(ends.select("fp", F.col("first.id").alias("_id"), F.col("first.tag").alias("_tag")))
    met = source.join(ends, F.col("id").eqNullSafe(F.col("_id")) & F.col("tag").eqNullSafe(F.col("_tag")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sets = [], []
            for fp, text in zip(batch.column("fp").to_pylist(), batch.column("text").to_pylist()):
                # Rows may share key and tag; the fingerprint says which is meant.
                hashes = _counted(text, scheme)
                if _print(hashes, scheme) == fp:
                    fps.append(fp)
                    sets.append(np.unique(hashes).view(np.int64))
            yield pa.RecordBatch.from_pydict({"fp": pa.array(fps, pa.binary()), "shingles": pa.array(sets, pa.list_(pa.int64()))})
            give_back()

    repeated: list[str] = []
    with noted(repeated):
        sets = kept(met.select("fp", "text").mapInArrow(scan, "fp binary, shingles array<long>"), "simhash-shingles")
    # Only sets that came more than once are moved.
    again = bounded(sets.groupBy("fp").count().filter("count > 1").select("fp"))
    if again.isEmpty():
        return sets
    single = sets.join(again, "fp", "left_anti").unionByName(sets.join(again, "fp").dropDuplicates(["fp"]))
    single = kept(single, "simhash-shingles")
    forget(source.sparkSession, repeated)
    return single


def _verified(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """The links whose texts share at least `similarity` of their different shingles."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("of_a")), "a").join(
        sets.select(F.col("fp").alias("b"), F.col("shingles").alias("of_b")), "b"
    )
    shared = F.size(F.array_intersect("of_a", "of_b"))
    share = F.try_divide(shared, F.size("of_a") + F.size("of_b") - shared)
    return both.filter(share >= scheme.similarity).select("a", "b")
