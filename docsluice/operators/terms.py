"""Terms of texts: 1- and 2-grams, vocabulary, TF-IDF.

The vocabulary takes one shuffle of partial counts per term. From the texts, terms
are made and counted as numbers of their words in one Python call, and become strings
once they are summed. Weights are computed inside each row against the vocabulary,
which never exceeds `max_features` terms and is therefore safe to hand to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.config import TermConfig
from docsluice.session import bounded, reliable, small_batches

# Fixed value: a token is a run of at least two letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
BETWEEN = r"[^\p{L}\p{N}_]+"

# Texts, terms and sums that a task looks at together.
TEXT_BYTES = 1 << 20
COUNTED_BYTES = 1 << 22
TERMS = 1 << 20
HELD_BYTES = 1 << 26
HELD_WORD_BYTES = 1 << 25
HANDED_ROWS = 1 << 14


def stop_words(config: TermConfig) -> list[str]:
    if config.stop_words is not None:
        return list(config.stop_words)
    return StopWordsRemover.loadDefaultStopWords("english")


def with_terms(df: DataFrame, text: str, config: TermConfig = TermConfig()) -> DataFrame:
    """Adds the array `terms`: the tokens without stop words and their neighbouring pairs."""
    # Terms are several times as large as their texts, and the JVM and the worker hold a batch each.
    small_batches(df.sparkSession)
    unwanted = pa.array(stop_words(config), pa.string())

    @F.arrow_udf("array<string>")
    def terms_of(texts: pa.Array) -> pa.Array:
        parts = [_terms(texts.slice(first, last - first), unwanted) for first, last in _runs(pc.binary_length(texts), TEXT_BYTES)]
        return pa.concat_arrays([*parts, pa.array([], pa.list_(pa.string()))])

    return df.withColumn("terms", terms_of(_lowered(text)))


def known_terms(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Leaves in `terms` those of the vocabulary; made by Python before, the others do not reach the JVM."""
    # At most max_features rows.
    known = pa.array([row.term for row in vocabulary.select("term").collect()], pa.string())

    @F.arrow_udf("array<string>")
    def known_of(lists: pa.Array) -> pa.Array:
        terms = pc.list_flatten(lists)
        wanted = pc.is_in(terms, known)
        row = pc.list_parent_indices(lists).to_numpy()[wanted.to_numpy(zero_copy_only=False)]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lists)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), terms.filter(wanted), mask=lists.is_null())

    return df.withColumn("terms", known_of("terms"))


def _lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def _runs(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about `most`, of one row at least."""
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, last
        first = last


def _terms(texts: pa.Array, unwanted: pa.Array) -> pa.Array:
    """Tokens and pairs of every text."""
    row, tokens = _tokens(texts, unwanted)
    beside = row[1:] == row[:-1]
    pairs = pc.binary_join_element_wise(tokens[:-1].filter(beside), tokens[1:].filter(beside), " ")
    rows = np.concatenate([row, row[1:][beside]])
    # A stable order by text keeps its tokens before its pairs.
    terms = pa.concat_arrays([tokens, pairs]).take(pa.array(np.argsort(rows, kind="stable")))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, terms)


def _tokens(texts: pa.Array, unwanted: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The tokens of all texts one after the other, and the row of each."""
    found = pc.split_pattern_regex(texts, BETWEEN)
    row, tokens = pc.list_parent_indices(found).to_numpy(), pc.list_flatten(found)
    wanted = pc.and_not(pc.greater_equal(pc.utf8_length(tokens), 2), pc.is_in(tokens, unwanted))
    return row[wanted.to_numpy(zero_copy_only=False)], tokens.filter(wanted)


def _counted(df: DataFrame, *columns: str) -> DataFrame:
    """A row per row and different term: the columns, term, tf. Terms are counted where they lie."""
    in_order = df.select(*columns, F.sort_array("terms").alias("_terms"))
    # In a sorted array the first of equal terms says where the others begin.
    first = F.transform("_terms", lambda term, place: F.when((place == 0) | ~term.eqNullSafe(F.get("_terms", place - 1)), place))
    starts = in_order.withColumn("_starts", F.filter(first, lambda place: place.isNotNull()))
    counts = F.transform(
        "_starts",
        lambda start, number: F.struct(
            F.get("_terms", start).alias("term"),
            (F.coalesce(F.get("_starts", number + 1), F.size("_terms")) - start).cast("long").alias("tf"),
        ),
    )
    return starts.select(*columns, F.inline(counts))


def term_frequency(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, term, tf) from the array `terms`; only rows whose key occurs again are shuffled."""
    again = df.groupBy(F.col(key).alias("_again")).count().filter("count > 1").select("_again")
    again = bounded(again)
    if again.isEmpty():
        return _counted(df, key)
    same = F.col(key).eqNullSafe(F.col("_again"))
    several = _counted(df.join(again, same, "left_semi"), key).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return _counted(df.join(again, same, "left_anti"), key).unionByName(several)


def document_frequency(df: DataFrame, config: TermConfig = TermConfig(), text: str | None = None) -> DataFrame:
    """Rows (term, tf, df, documents) for terms in enough and not too many documents.

    `text` names the column that `with_terms` makes the terms from with the same config, if
    it is at hand: they are then made where they are summed, and no list of them is moved.
    """
    kind = "term string, tf long, df long"
    if text is None:
        sums = df.select("terms").mapInArrow(_sum_terms, kind)
    else:
        small_batches(df.sparkSession)
        # A task has summed its terms: adding up again before the shuffle would only take memory.
        sums = df.select(_lowered(text)).mapInArrow(_sum_texts(pa.array(stop_words(config), pa.string())), kind).repartition("term")
    counts = sums.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    # Counting rows reads no text.
    documents = df.count()
    return counts.filter(
        (F.col("df") >= config.min_df) & (F.col("df") <= F.lit(documents * config.max_df))
    ).select("term", "tf", "df", F.lit(documents).cast("long").alias("documents"))


def _sum_texts(unwanted: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes the terms of texts, and their sums as far as `HELD_BYTES` go."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums()
        for batch in batches:
            texts = batch.column(0)
            for first, last in _runs(pc.binary_length(texts), COUNTED_BYTES):
                held.add(*_tokens(texts.slice(first, last - first), unwanted))
                if held.is_full():
                    yield from held.rows()
                    held = _Sums()
        yield from held.rows()

    return sums


class _Sums:
    """Sums of terms by ascending key: the number of the word, and of a pair's second word plus 1 in the lower half."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())
        self.keys = np.zeros(0, np.int64)
        self.tf, self.df = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.seen = 0

    def is_full(self) -> bool:
        # So many occurrences fit the sums; numbers of words fit half a key.
        return 16 * len(self.keys) > HELD_BYTES or self.words.nbytes > HELD_WORD_BYTES or self.seen > 1 << 30

    def add(self, row: np.ndarray, tokens: pa.Array) -> None:
        """The tokens of some texts, in their order, and the row of each."""
        if not len(row):
            return
        coded = tokens.dictionary_encode()
        code, bits, low = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary).bit_length(), int(row[-1]).bit_length()
        beside = row[1:] == row[:-1]
        pairs = (code[:-1][beside] << bits) + code[1:][beside] + 1
        # A place per occurrence: the term, then the row. In order, equal terms and rows stand together.
        places = np.concatenate([code << bits << low | row, pairs << low | row[1:][beside]])
        places.sort()
        rows = (np.diff(places, prepend=-1) != 0).astype(np.int32)
        terms = places >> low
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        tf, df = np.diff(starts, append=len(terms)).astype(np.int32), np.add.reduceat(rows, starts)
        self.seen += len(terms)
        number, terms = self._numbered(coded.dictionary), terms[starts]
        keys = number[terms >> bits] << 32 | np.append(0, number + 1)[terms & (1 << bits) - 1]
        order = np.argsort(keys)
        self._merge(keys[order], tf[order], df[order])

    def _numbered(self, words: pa.Array) -> np.ndarray:
        """The numbers of different words; new ones get the next."""
        known = pc.index_in(words, value_set=self.words)
        new = words.filter(known.is_null())
        number = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        number[number < 0] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        return number

    def _merge(self, keys: np.ndarray, tf: np.ndarray, df: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        old = np.append(self.keys, -1)[at] == keys
        self.tf[at[old]] += tf[old]
        self.df[at[old]] += df[old]
        at, new = at[~old], ~old
        self.keys = np.insert(self.keys, at, keys[new])
        self.tf, self.df = np.insert(self.tf, at, tf[new]), np.insert(self.df, at, df[new])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(self.keys), HANDED_ROWS):
            some = slice(first, first + HANDED_ROWS)
            left, right = self.keys[some] >> 32, self.keys[some] & (1 << 32) - 1
            word = self.words.take(pa.array(left))
            pair = pc.binary_join_element_wise(word, self.words.take(pa.array(np.maximum(right - 1, 0))), " ")
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pc.if_else(pa.array(right > 0), pair, word),
                    "tf": pa.array(self.tf[some], pa.int64()),
                    "df": pa.array(self.df[some], pa.int64()),
                }
            )


def _sum_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and rows of the terms of a task, added up as far as `HELD_BYTES` go; no term occurs twice in what they hold."""
    held, size = [], 0
    for batch in batches:
        lists = batch.column("terms")
        for first, last in _runs(pc.fill_null(pc.list_value_length(lists), 0), TERMS):
            held.append(_sums(lists.slice(first, last - first)))
            size += held[-1].nbytes
            if size > HELD_BYTES:
                held = [_added(held)]
                size = held[0].nbytes
                if size > HELD_BYTES // 2:
                    yield from held.pop().to_batches()
                    size = 0
    if held:
        yield from _added(held).to_batches()


def _sums(lists: pa.Array) -> pa.Table:
    """A row per different term, null left out: how often it occurs and in how many rows."""
    terms = pc.list_flatten(lists)
    known = terms.is_valid()
    row = pc.list_parent_indices(lists).to_numpy()[known.to_numpy(zero_copy_only=False)]
    coded = terms.filter(known).dictionary_encode()
    codes, different = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    # Sorting and comparing is much faster than np.unique on numbers that hardly repeat.
    places = np.sort(row * different + codes)
    rows = places[np.diff(places, prepend=-1) != 0] % max(different, 1)
    return pa.table(
        {
            "term": coded.dictionary,
            "tf": pa.array(np.bincount(codes, minlength=different), pa.int64()),
            "df": pa.array(np.bincount(rows, minlength=different), pa.int64()),
        }
    )


def _added(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    sums = pa.concat_tables(tables).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
    return pa.table({"term": sums["term"], "tf": sums["tf_sum"], "df": sums["df_sum"]})


def fit_vocabulary(df: DataFrame, config: TermConfig = TermConfig(), text: str | None = None) -> DataFrame:
    """Rows (index, term, tf, df, idf): the most frequent terms, numbered in alphabetical order.

    `text` is as for `document_frequency`. Computed once and kept, at most `max_features` rows, because every later step needs it.
    """
    idf = F.log((1 + F.col("documents")) / (1 + F.col("df"))) + 1
    top = document_frequency(df, config, text).orderBy(F.col("tf").desc(), "term").limit(config.max_features)
    numbered = top.select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("index"), "term", "tf", "df", idf.alias("idf")
    )
    return reliable(numbered)


def term_pipeline(vocabulary: DataFrame, weighting: str = "tfidf", output: str = "term_vector") -> PipelineModel:
    """Transformer from `terms` to a sparse vector: normalised TF-IDF weights, or plain counts."""
    if weighting not in ("tfidf", "count"):
        raise ValueError("weighting must be tfidf or count")
    # At most max_features rows.
    fitted = vocabulary.orderBy("index").select("term", "idf").collect()
    if not fitted:
        raise ValueError("the vocabulary is empty")
    counted = output if weighting == "count" else "_term_counts"
    counts = CountVectorizerModel.from_vocabulary([row.term for row in fitted], "terms", counted)
    stages: list = [counts.setMinTF(1.0)]
    if weighting == "tfidf":
        stages += [
            ElementwiseProduct(
                scalingVec=Vectors.dense([row.idf for row in fitted]), inputCol=counted, outputCol="_term_weights"
            ),
            Normalizer(p=2.0, inputCol="_term_weights", outputCol=output),
        ]
    return PipelineModel(stages)


def entries(vector: Column) -> Column:
    """The stored entries of a sparse vector as an array of (index, weight); what is not stored costs nothing."""
    parts = F.unwrap_udt(vector)
    return F.zip_with(
        parts["indices"], parts["values"], lambda index, weight: F.struct(index.alias("index"), weight.alias("weight"))
    )


def term_weights(vectors: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, term, weight) from the sparse `term_vector`."""
    return (
        vectors.select(key, F.inline(entries(F.col("term_vector"))))
        .filter(F.col("weight") != 0)
        .join(bounded(vocabulary.select("index", "term")), "index")
        .select(key, "term", "weight")
    )
