"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are words and one end per text. The `classes` most frequent tokens are classes
of their own, all others share one, inside which a word has its smoothed share of the
counts; so the probabilities of all words, a word never seen included, add up to one.

A class is predicted from the two tokens before it: their vectors, turned by one matrix
per distance, add up to a prediction, and its product with the vector of a class plus
a bias is the class's logarithmic weight. What the corpus says about this is how often
each class follows each pair of classes: counts over all training texts, gathered by
grouped aggregation. Tasks draw samples from their share of these counts, tell them
from noise, and their parameters are averaged after every round.

The normaliser of every pair of classes comes from batched matrix products and is kept
in a table of fixed size, so a token is scored by a few look-ups. Words that are not
among the `remembered` most frequent ones get their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import as_bytes, kept, slices

# No word holds white space, so this stands for the end of a text.
END = b"\n"
LOG10 = math.log(10)


@dataclass(frozen=True)
class LmConfig:
    """Sizes are fixed numbers, whatever the corpus: none of them leaves out a text, a word or a count."""

    classes: int = 512
    remembered: int = 200_000
    dimension: int = 24
    noise: int = 128
    batch: int = 2048
    rounds: int = 4
    samples_per_count: float = 2.0
    counts_per_task: int = 200_000
    rate: float = 0.2
    decay: float = 0.5
    seed: int = 42


@dataclass(frozen=True)
class Corpus:
    """Counts of the training tokens: the whole table, its sums and its most frequent words."""

    words: DataFrame
    tokens: int
    distinct: int
    frequent: dict[bytes, int]
    counts: np.ndarray


@dataclass(frozen=True)
class Model:
    """`vectors` of context words, `turns` per distance, `targets` and `bias` of classes, `normaliser` per pair."""

    vectors: np.ndarray
    turns: np.ndarray
    targets: np.ndarray
    bias: np.ndarray
    normaliser: np.ndarray


def held_out(key: Column) -> Column:
    """Whether a row is kept out of training; a null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(texts: DataFrame, config: LmConfig) -> Corpus:
    """Exact counts of all tokens of `text` (bytes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, "text"):
                for text in batch.column("text").to_pylist():
                    seen.update(text.lower().split())
                seen[END] += batch.num_rows
                if len(seen) > config.remembered:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    words = texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = kept(words, "lm-words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    # The end is always remembered, as the first; then all words that occur so often that no more than allowed do.
    end, room, least = F.col("word") == F.lit(END), config.remembered - 1, None
    for row in words.filter(~end).groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        room -= row["words"]
        if room < 0:
            break
        least = row["n"]
    often = words.filter(end | (F.lit(False) if least is None else F.col("n") >= least)).toArrow()
    order = sorted(
        zip(often.column("n").to_pylist(), often.column("word").to_pylist()), key=lambda x: (x[1] != END, -x[0], x[1])
    )
    return Corpus(words, tokens, distinct, {word: place for place, (_, word) in enumerate(order)}, np.array([n for n, _ in order], np.int64))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})


def _classes(places: np.ndarray, ends: np.ndarray, config: LmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every token and of the two before it; the end stands before every text."""
    rare = config.classes
    own = np.where((places < 0) | (places >= rare), rare, places)
    first = np.zeros(len(own), bool)
    first[np.concatenate([[0], ends[:-1] + 1])] = True
    second = np.zeros(len(own), bool)
    second[1:] = first[:-1]
    end = own[ends[0]]
    before = np.where(first, end, np.roll(own, 1))
    return own, before, np.where(first | second, end, np.roll(own, 2))


def _places(texts: list[bytes], frequent: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, place of every token among the frequent words (-1: none), and where texts end."""
    words = [text.lower().split() for text in texts]
    get, end = frequent.get, frequent.get(END, -1)
    places = np.array([place for text in words for place in (*[get(word, -1) for word in text], end)], np.int64)
    return words, places, np.cumsum([len(text) + 1 for text in words]) - 1


def train(texts: DataFrame, corpus: Corpus, config: LmConfig) -> Model:
    """Noise-contrastive training on the counts of classes after pairs of classes, over all texts."""
    spark = texts.sparkSession
    width, d = config.classes + 1, config.dimension
    frequent = spark.sparkContext.broadcast({word: place for word, place in corpus.frequent.items() if place < config.classes})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 24):
                _, places, ends = _places(batch.column("text").to_pylist(), frequent.value)
                own, before, earlier = _classes(places, ends, config)
                codes, counts = np.unique((earlier * width + before) * width + own, return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": pa.array(codes), "n": pa.array(counts)})

    codes = texts.select("text").mapInArrow(follow, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    codes = kept(codes, "lm-codes")
    tasks = -(-codes.count() // config.counts_per_task) or 1
    share = np.zeros(width)
    share[: min(config.classes, len(corpus.counts))] = corpus.counts[: config.classes]
    share[-1] = corpus.tokens - share.sum()
    share = (share + 0.5) / (share + 0.5).sum()

    draw = np.random.default_rng(config.seed)
    state = [
        draw.normal(0, 0.1, (width, d)),
        np.stack([np.eye(d) * 0.5, np.eye(d) * 0.25]),
        np.zeros((width, d)),
        np.log(share),
    ]
    shapes = [part.shape for part in state]
    for number in range(config.rounds):
        flat = np.concatenate([part.ravel() for part in state])
        learned = codes.repartition(tasks).mapInArrow(_learn(flat, shapes, share, number, config), "weight double, state binary")
        sums = learned.repartition(16).mapInArrow(_sum_states, "weight double, state binary").collect()
        weight = sum(row["weight"] for row in sums)
        if weight:
            flat = sum(np.frombuffer(row["state"]) for row in sums) / weight
        state = [part.reshape(shape) for part, shape in zip(np.split(flat, np.cumsum([math.prod(s) for s in shapes])[:-1]), shapes)]
    vectors, turns, targets, bias = (part.astype(np.float32) for part in state)

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = vectors @ turns[0], vectors @ turns[1]
        for batch in batches:
            for earlier in batch.column("id").to_pylist():
                logits = (near + far[earlier]) @ targets.T + bias
                top = logits.max(axis=1, keepdims=True)
                sums = top[:, 0] + np.log(np.exp(logits - top).sum(axis=1))
                yield pa.RecordBatch.from_pydict({"id": pa.array([earlier]), "sums": pa.array([sums.astype(np.float32).tobytes()], pa.binary())})

    normaliser = np.zeros((width, width), np.float32)
    for row in spark.range(0, width, 1, 16).mapInArrow(normalise, "id long, sums binary").collect():
        normaliser[row["id"]] = np.frombuffer(row["sums"], np.float32)
    return Model(vectors, turns, targets, bias, normaliser)


def _learn(flat: np.ndarray, shapes: list, share: np.ndarray, number: int, config: LmConfig):
    width = config.classes + 1

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not sum(len(codes) for codes, _ in tables):
            return
        codes, counts = (np.concatenate(column) for column in zip(*tables))
        order = np.argsort(codes)
        codes, upto = codes[order], np.cumsum(counts[order])
        parts = np.split(flat.copy(), np.cumsum([math.prod(s) for s in shapes])[:-1])
        vectors, turns, targets, bias = (part.reshape(shape) for part, shape in zip(parts, shapes))
        squares = [np.full(shape, 1e-4) for shape in shapes]
        draw = np.random.default_rng([config.seed, number, int(codes[0]), len(codes)])
        noise_from = np.cumsum(share)
        penalty = np.log(config.noise * share)
        rate = config.rate * config.decay**number
        for _ in range(max(1, round(len(codes) * config.samples_per_count / config.batch))):
            picked = codes[np.searchsorted(upto, draw.integers(0, upto[-1], config.batch), "right")]
            own, before, earlier = picked % width, picked // width % width, picked // width // width
            noise = np.minimum(np.searchsorted(noise_from, draw.random(config.noise)), width - 1)
            near, far = vectors[before], vectors[earlier]
            predicted = near @ turns[0] + far @ turns[1]
            real = (predicted * targets[own]).sum(axis=1) + bias[own] - penalty[own]
            fake = predicted @ targets[noise].T + bias[noise] - penalty[noise]
            # Gradients of the log-likelihood of telling data from noise.
            up, down = 1 / (1 + np.exp(real)), -1 / (1 + np.exp(-fake))
            to_predicted = up[:, None] * targets[own] + down @ targets[noise]
            steps = [np.zeros(shape) for shape in shapes]
            np.add.at(steps[2], own, up[:, None] * predicted)
            np.add.at(steps[2], noise, down.T @ predicted)
            np.add.at(steps[3], own, up)
            np.add.at(steps[3], noise, down.sum(axis=0))
            steps[1][0], steps[1][1] = near.T @ to_predicted, far.T @ to_predicted
            np.add.at(steps[0], before, to_predicted @ turns[0].T)
            np.add.at(steps[0], earlier, to_predicted @ turns[1].T)
            for part, square, step in zip((vectors, turns, targets, bias), squares, steps):
                step /= config.batch
                square += step**2
                part += rate * step / np.sqrt(square)
        weight = float(upto[-1])
        state = np.concatenate([part.ravel() for part in (vectors, turns, targets, bias)]) * weight
        yield pa.RecordBatch.from_pydict({"weight": pa.array([weight]), "state": pa.array([state.tobytes()], pa.binary())})

    return learn


def _sum_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, state = 0.0, None
    for batch in batches:
        for row in batch.to_pylist():
            weight += row["weight"]
            part = np.frombuffer(row["state"])
            state = part.copy() if state is None else state + part
    if state is not None:
        yield pa.RecordBatch.from_pydict({"weight": pa.array([weight]), "state": pa.array([state.tobytes()], pa.binary())})


def score_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", out: Column | None = None, config: LmConfig = LmConfig()
) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `out` says which rows are kept out of training (default `held_out` of the key).
    Scores are base-10 logarithms of the probability of the whole text: `base_score`
    under smoothed word counts, `score` under the model. Null and empty texts are one
    end. Words never seen in training have a probability under both. Repeated rows
    are counted and scored each. An empty table, or one without training rows, is
    scored as if nothing had been seen.
    """
    out = held_out(F.col(key)) if out is None else out
    rows = docs.select(F.col(key).cast("long").alias("id"), out.alias("out"), as_bytes(text).alias("text"))
    training = rows.filter("NOT out")
    corpus = count_words(training, config)
    model = train(training, corpus, config)
    return _scored(rows, corpus, model, config).withColumnRenamed("id", key)


def _scored(rows: DataFrame, corpus: Corpus, model: Model, config: LmConfig) -> DataFrame:
    spark = rows.sparkSession
    width = config.classes + 1
    frequent = spark.sparkContext.broadcast(corpus.frequent)
    parts = spark.sparkContext.broadcast(model)
    logs = np.log10(corpus.counts + 1.0)
    classed = int(corpus.counts[: config.classes].sum())
    rest = math.log10(corpus.tokens - classed + corpus.distinct - min(config.classes, len(corpus.counts)) + 1)
    whole = math.log10(corpus.tokens + corpus.distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lm = frequent.value, parts.value
        near, far = lm.vectors @ lm.turns[0], lm.vectors @ lm.turns[1]
        row = TaskContext.get().partitionId() << 33
        for batch_of_all in batches:
            for batch in slices(batch_of_all, "text"):
                words, places, ends = _places(batch.column("text").to_pylist(), known)
                own, before, earlier = _classes(places, ends, config)
                under = np.empty(len(own))
                for at in range(0, len(own), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    predicted = near[before[part]] + far[earlier[part]]
                    logits = (predicted * lm.targets[own[part]]).sum(axis=1) + lm.bias[own[part]]
                    under[part] = logits - lm.normaliser[earlier[part], before[part]]
                under /= LOG10
                # A word outside the classes also has its share of the common class; unknown counts follow by join.
                weight = np.where(places >= 0, logs[places] if len(logs) else 0.0, 0.0)
                under += np.where(own == width - 1, weight - rest, 0.0)
                starts = np.concatenate([[0], ends[:-1] + 1])
                tokens = ends - starts + 1
                here = np.arange(row, row + len(tokens))
                row += len(tokens)
                nothing = pa.nulls(len(tokens), pa.binary())
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(here),
                        "id": batch.column("id"),
                        "out": batch.column("out"),
                        "n_tokens": pa.array(tokens),
                        "n_known": pa.array(np.add.reduceat((places >= 0).astype(np.int64), starts)),
                        "base": pa.array(np.add.reduceat(weight, starts) - tokens * whole),
                        "model": pa.array(np.add.reduceat(under, starts)),
                        "word": nothing,
                    }
                )
                of, unseen, times = [], [], []
                for number, text in enumerate(words):
                    for word, n in Counter([w for w in text if w not in known]).items():
                        of.append(here[number])
                        unseen.append(word)
                        times.append(n)
                empty = len(of)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(of, pa.int64()),
                        "id": pa.nulls(empty, pa.int64()),
                        "out": pa.nulls(empty, pa.bool_()),
                        "n_tokens": pa.array(times, pa.int64()),
                        "n_known": pa.nulls(empty, pa.int64()),
                        "base": pa.nulls(empty, pa.float64()),
                        "model": pa.nulls(empty, pa.float64()),
                        "word": pa.array(unseen, pa.binary()),
                    }
                )

    schema = "row long, id long, out boolean, n_tokens long, n_known long, base double, model double, word binary"
    scored = kept(rows.mapInArrow(score, schema), "lm-scored")
    rare = scored.filter("word IS NOT NULL").select("row", "word", F.col("n_tokens").alias("times"))
    counted = rare.join(corpus.words, "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more")
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.filter("word IS NULL").join(counted, "row", "left").select(
        "id",
        F.col("out").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
