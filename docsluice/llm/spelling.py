"""Groups of spelling variants by an index of variable-length grams.

A dictionary holds the grams that cut words: all of the least length, and longer ones
where the shorter one stands in too many words. A word, between two end marks, is cut
into the longest gram that begins at each place, less those that lie in an earlier one.
An edit at some place affects only the grams that reach it, or that a gram across it
could replace. Which these are depends on what stands left and right of the edit, and
both words of a pair share that, so both keep the same grams outside.

So the lists of all grams that an edit leaves untouched are merged at once, by their
intersection: the untouched left and right grams together are a key, one for every
place of a word that touches other grams. Words that meet under a key are verified by
their edit distance. A list that stays long is merged again by the grams of the least
length, which leave nothing untouched but the place itself; it then holds words that
differ in one character at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import as_bytes, kept, slices

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FIRST, LAST = "^", "$"
# Words or grams counted in a task before they are given away.
HELD = 200_000


@dataclass(frozen=True)
class Grams:
    """Lengths from `least` to `most`; a gram that more than `long` words hold is prolonged
    by characters with which at least `rare` words hold it, up to `entries` grams in all (a
    smaller dictionary has longer lists, not other results). Lists of more than `crowd`
    words are merged again."""

    least: int = 2
    most: int = 4
    long: int = 1_000
    rare: int = 100
    entries: int = 100_000
    crowd: int = 64


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", damaged: int = 97) -> DataFrame:
    """word, n over whole texts: runs of letters up to U+00FF, A-Z lower-cased, of at least one character.

    Where `damaged` divides the CRC-32 of "<key>:<run>", the run loses the character at
    that number modulo its length (0: no run does). Null texts have no words, a null key
    counts as empty; rows that repeat count again.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), as_bytes(text).alias("text"))
    parts = rows.mapInArrow(_counted(damaged), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(damaged: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for whole in batches:
            for batch in slices(whole, "text"):
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                    own = Counter(RUN.findall(text.translate(LOWER).decode("utf-8", "replace")))
                    if damaged:
                        start = zlib.crc32(f"{key}:".encode())
                        for run in [run for run in own if zlib.crc32(run.encode(), start) % damaged == 0]:
                            at = zlib.crc32(run.encode(), start) % len(run)
                            # Runs are taken as they stand in the text: a damaged one is not damaged again.
                            total[run[:at] + run[at + 1 :]] += own.pop(run)
                    total.update(own)
                    if len(total) >= HELD:
                        yield _counts(total)
                        total.clear()
        yield _counts(total)

    return count


def _counts(total: Counter[str]) -> pa.RecordBatch:
    found = [(word, n) for word, n in total.items() if word]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])


def spelling_groups(counts: DataFrame, shortest: int = 5, seldom: int = 3, grams: Grams = Grams()) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n) of `shortest` characters and `seldom` occurrences or more.

    Words are near if one inserted, deleted or replaced character makes one the other.
    The form of a word is its near word of largest n (ties: smallest in code point
    order) if that is at least twice the word's n; following forms ends at its root, the
    word itself if it has none. Words are taken to be different and without the end
    marks ^ and $; rows without word or n are left out. An empty table gives no rows.
    """
    words = kept(counts.filter((F.length("word") >= shortest) & (F.col("n") >= seldom)).select("word", F.col("n").cast("long")), "spelling-words")
    near = kept(near_words(words, grams), "spelling-near")
    sides = near.select("word", "n", "other", "other_n").unionByName(
        near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    best = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    known = -F.col("best.n") >= 2 * F.col("n")
    formed = kept(best.select("word", "n_near", F.when(known, F.col("best.other")).alias("form"), F.when(known, -F.col("best.n")).alias("form_n")), "spelling-forms")
    rooted = _roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return (
        words.join(formed, "word", "left")
        .join(rooted, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: every round doubles the number of forms followed; n at least doubles along each."""
    steps = kept(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = kept(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.drop("moved")


def near_words(words: DataFrame, grams: Grams = Grams()) -> DataFrame:
    """Every pair of near words once: word, n, other, other_n with word < other; `words` (word, n) are different."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, grams))
    keys = kept(words.select("word", "n").mapInArrow(_keyed(shared, grams), "key long, word string, n long"), "spelling-keys")
    lists = kept(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "spelling-lists")
    met = keys.join(lists, "key")
    again = met.filter(F.col("size") > grams.crowd).select("key", "word", "n")
    again = again.mapInArrow(_refined(shared, grams), "key long, word string, n long").distinct()
    every = kept(met.filter(F.col("size") <= grams.crowd).select("key", "word", "n").unionByName(again), "spelling-met")
    others = every.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = every.join(others, "key").filter("word < other AND levenshtein(word, other, 1) = 1")
    return pairs.select("word", "n", "other", "other_n").distinct()


def gram_dictionary(words: DataFrame, grams: Grams = Grams()) -> list[str]:
    """The grams longer than `least` that cut words, at most `entries`: frequent ones whose shorter gram stands in too many words."""
    counted = words.select("word").mapInArrow(_grams(grams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = kept(counted.filter(F.col("n") >= grams.rare), "spelling-grams")
    shorter = counted.select(F.col("gram").alias("shorter"), F.col("n").alias("shorter_n")).filter(F.col("n") > grams.long)
    longer = counted.filter(F.length("gram") > grams.least).withColumn("shorter", F.expr("left(gram, length(gram) - 1)"))
    chosen = longer.join(shorter, "shorter").orderBy(F.col("n").desc(), "gram").limit(grams.entries)
    return [row["gram"] for row in chosen.select("gram").collect()]


def _grams(grams: Grams):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                marked = FIRST + word + LAST
                lengths = range(grams.least, grams.most + 1)
                total.update({marked[p : p + q] for q in lengths for p in range(len(marked) - q + 1)})
                if len(total) >= HELD:
                    yield _counts(total).rename_columns(["gram", "n"])
                    total.clear()
        yield _counts(total).rename_columns(["gram", "n"])

    return count


class Cutter:
    """Cuts marked words by a dictionary and tells what edits leave untouched."""

    def __init__(self, dictionary: list[str], grams: Grams) -> None:
        self.least = grams.least
        self.known = frozenset(dictionary)
        self.most = max([self.least, *map(len, dictionary)])
        self.beginnings = {gram[:i] for gram in dictionary for i in range(1, len(gram))}
        self.endings = {gram[i:] for gram in dictionary for i in range(1, len(gram))}

    def ends(self, marked: str) -> list[int]:
        """For each place the end of the longest gram that begins there."""
        found = []
        for p in range(len(marked) - self.least + 1):
            for q in range(min(self.most, len(marked) - p), self.least, -1):
                if marked[p : p + q] in self.known:
                    found.append(p + q)
                    break
            else:
                found.append(p + self.least)
        return found

    def grams(self, marked: str) -> list[tuple[int, str]]:
        """Places and grams of the word, without those that lie in an earlier one."""
        out, top = [], 0
        for p, end in enumerate(self.ends(marked)):
            if end > top:
                out.append((p, marked[p:end]))
                top = end
        return out

    def untouched(self, marked: str) -> tuple[list[int], list[int]]:
        """left[l]: where the last gram ends that every word beginning with marked[:l] has there.

        right[r]: where the first gram begins that every word ending with marked[r:] has there.
        """
        size, ends = len(marked), self.ends(marked)
        left, right = [0] * (size + 1), [size] * (size + 1)
        for l in range(1, size):
            for p in range(l):
                # A longer gram could begin here and reach what follows.
                if l - p < self.least or (p + self.most > l and marked[p:l] in self.beginnings):
                    break
                left[l] = max(left[l], ends[p])
        for r in range(1, size):
            # As far as a gram from before could reach, those that end there may be left out.
            reach = next((e for e in range(min(self.most - 1, size - r), 0, -1) if e < self.least or marked[r : r + e] in self.endings), 0) + r
            top = reach
            for p in range(r, len(ends)):
                if ends[p] > top:
                    right[r] = p
                    break
        return left, right

    def contexts(self, marked: str) -> Iterator[tuple[tuple[int, str, str], int, int]]:
        """For every edit its key and what stands around it: marked[:l], and marked[r:] behind one or no character."""
        left, right = self.untouched(marked)
        size = len(marked)
        for l in range(1, size):
            for r in (l, l + 1):
                if r < size:
                    yield (l + size - r, marked[: left[l]], marked[right[r] :]), l, r


def _code(total: int, left: str, right: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{total} {left} {right}".encode()) - (1 << 63)


def _rows(found: list[tuple[int, str, int]]) -> pa.RecordBatch:
    columns = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))], ["key", "word", "n"])


def _keyed(shared: Broadcast, grams: Grams):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value, grams)
        for batch in batches:
            found = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                found += [(_code(*key), word, n) for key in {key for key, _, _ in cutter.contexts(FIRST + word + LAST)}]
            yield _rows(found)

    return emit


def _refined(shared: Broadcast, grams: Grams):
    """For words in a crowded list the keys by grams of the least length of the same edits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, plain = Cutter(shared.value, grams), Cutter([], grams)
        for batch in batches:
            found = []
            for key, word, n in zip(*(batch.column(name).to_pylist() for name in ("key", "word", "n"))):
                marked = FIRST + word + LAST
                left, right = plain.untouched(marked)
                around = {(l + len(marked) - r, marked[: left[l]], marked[right[r] :]) for own, l, r in cutter.contexts(marked) if _code(*own) == key}
                # Told apart from keys of the first merge.
                found += [(_code(-total, a, b), word, n) for total, a, b in around]
            yield _rows(found)

    return emit
