"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior per page:

- the text: letter trigrams, hashed to a fixed number of slots, under a multinomial
  model of every language, against the hypothesis that all slots are equally likely
  (no language);
- the language the markup declares, with the reliability that the texts show;
- the suffix of the address and the host: a prior for the host that is smoothed by
  that of its domain, this by that of its suffix, this by that of all pages. The
  counts behind it are sums of posteriors of the texts, by grouped aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.llm.common import as_bytes, joined, kept, slices

SLOTS = 1 << 16
UNDETERMINED = "und"
# A-Z in lower case; digits, ASCII punctuation and control characters are blanks.
LETTERS = bytes(ord(chr(c).lower()) if chr(c).isalpha() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
HIDDEN = regex.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w{1,10};")


@dataclass(frozen=True)
class Fusion:
    """Weights of the evidence.

    `sharpness`: a trigram shares its letters with two others, so a text counts for a
    third of its trigrams. `smoothing`: rows that the level above is worth in the
    prior of a host. `declared_weight`: pages of doubt about declared languages.
    `reject_below`: least posterior of an accepted language.
    """

    sharpness: float = 1 / 3
    smoothing: float = 8.0
    declared_weight: float = 4.0
    slot_smoothing: float = 0.5
    reject_below: float = 0.5


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities, slot by language; the last column is `UNDETERMINED`."""

    languages: tuple[str, ...]
    weights: np.ndarray


def plain_text(html: str) -> str:
    """Visible text of a page: markup, scripts, styles, comments and character references become blanks."""
    return HIDDEN.sub(" ", html)


def declared_language(html: Column) -> Column:
    """Primary tag of the lang attribute of the first html element, lower case; null without one."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def host_levels(url: Column) -> Column:
    """host, domain (last two labels) and suffix (last label) of an address; null parts are empty."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.struct(
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )


def _slots(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every trigram of texts that lie one after the other, and how many each text has."""
    codes = data.astype(np.uint32)
    grams = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    return (grams * np.uint32(2654435761)) >> np.uint32(16), np.maximum(np.diff(starts) - 2, 0)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.array([b" ".join(x.translate(LETTERS).split()).join((b" ", b" ")) for x in batch.column("text").to_pylist()], pa.binary())
    return joined(texts)


def train(labelled: DataFrame, text: str = "text", language: str = "lang", fusion: Fusion = Fusion()) -> TextModel:
    """The text model of all labelled rows; one sum per language and slot leaves the executors.

    Rows without a language are left out, so is the label `und`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, starts = _texts(part)
                slots, _ = _slots(data, starts)
                for row, name in enumerate(part.column("lang").to_pylist()):
                    own = slots[starts[row] : max(starts[row], starts[row + 1] - 2)]
                    total = totals.setdefault(name, np.zeros(SLOTS, np.int64))
                    total += np.bincount(own, minlength=SLOTS) if len(own) > 2000 else 0
                    if len(own) <= 2000:
                        np.add.at(total, own, 1)
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * len(used)), "slot": pa.array(used.astype(np.int32)), "n": pa.array(total[used])}
            )

    rows = labelled.select(as_bytes(text).alias("text"), F.lower(F.trim(F.col(language))).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~F.col("lang").isin("", UNDETERMINED))
    sums = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").to_numpy(zero_copy_only=False).astype(object)
    languages = tuple(sorted(set(names.tolist())))
    counts = np.zeros((SLOTS, len(languages)))
    place = {name: number for number, name in enumerate(languages)}
    counts[sums.column("slot").to_numpy(), [place[name] for name in names]] = sums.column("n").to_numpy()
    counts += fusion.slot_smoothing
    weights = np.log(counts / counts.sum(axis=0))
    return TextModel(languages, np.column_stack([weights, np.full(SLOTS, -math.log(SLOTS))]).astype(np.float32))


def text_posteriors(pages: DataFrame, model: TextModel, html: bool, fusion: Fusion = Fusion()) -> DataFrame:
    """Adds `evidence`: log-likelihood of the text under every language and under none, and drops `text`.

    A text without a trigram of letters gives no evidence for any language and counts as undetermined.
    """
    names = [name for name in pages.columns if name != "text"]
    weights, width = model.weights, model.weights.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                if html:
                    seen = [plain_text(x.decode("utf-8", "replace")).encode() for x in part.column("text").to_pylist()]
                    part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(seen, pa.binary()))
                data, starts = _texts(part)
                slots, counts = _slots(data, starts)
                totals = np.zeros((part.num_rows, width))
                for row in range(part.num_rows):
                    totals[row] = weights[slots[starts[row] : starts[row] + counts[row]]].sum(axis=0, dtype=float)
                totals *= fusion.sharpness
                totals[counts == 0] = [*[-1e9] * (width - 1), 0.0]
                flat = pa.array(totals.ravel())
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width)
                columns = {name: part.column(name) for name in names}
                yield pa.RecordBatch.from_pydict({**columns, "evidence": pa.ListArray.from_arrays(offsets, flat)})

    schema = pages.select(*names).withColumn("evidence", F.array(F.lit(0.0))).schema
    return pages.mapInArrow(score, schema)


def _normalised(logs: Column) -> Column:
    """Probabilities of an array of log weights."""
    top = F.array_max(logs)
    shifted = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def _sums(weights: Column, width: int) -> Column:
    return F.array(*[F.sum(weights[place]) for place in range(width)])


def _blend(own: Column, above: Column, smoothing: float) -> Column:
    """Counts of a level, filled up with `smoothing` rows of the level above, as probabilities."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda x, y: (x + smoothing * y) / (total + smoothing))


def identify(rows: DataFrame, model: TextModel, html: bool = False, fusion: Fusion = Fusion()) -> DataFrame:
    """Posterior language per row: id, language, probability, accepted, text_language, declared, host.

    Input: id, text (or markup), declared (language tag or null), place (see
    `host_levels`). A row is rejected (`accepted` false, language `und`) if no
    language explains its text better than chance or none reaches `reject_below`:
    null and empty texts, digits and punctuation only, random letters. A null or
    unknown declaration and an empty host are evidence like any other value, no
    favour to any language. Repeated rows are answered alike. An empty table or an
    empty model gives no rows or only rejected ones.
    """
    languages, width = model.languages, len(model.languages) + 1
    scored = rows.select("id", as_bytes("text").alias("text"), "declared", "place")
    evidence = kept(text_posteriors(scored, model, html, fusion), "langid-evidence").withColumn("declared", F.coalesce("declared", F.lit("")))
    # Only what the texts say feeds the priors, so that no evidence is used twice.
    beliefs = evidence.select("declared", "place", _normalised(F.col("evidence")).alias("belief"))
    hosts = kept(beliefs.groupBy("place").agg(_sums(F.col("belief"), width).alias("host_n")), "langid-hosts")
    domains = hosts.groupBy("place.domain", "place.suffix").agg(_sums(F.col("host_n"), width).alias("domain_n"))
    suffixes = domains.groupBy("suffix").agg(_sums(F.col("domain_n"), width).alias("suffix_n"))
    everything = suffixes.agg(_sums(F.col("suffix_n"), width).alias("n")).head()
    total = np.array([x or 0.0 for x in everything["n"]]) + 1.0
    base = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    suffix_prior = suffixes.select("suffix", _blend(F.col("suffix_n"), base, fusion.smoothing).alias("suffix_p"))
    domain_prior = domains.join(suffix_prior, "suffix").select(
        "domain", "suffix", _blend(F.col("domain_n"), F.col("suffix_p"), fusion.smoothing).alias("domain_p")
    )
    host_prior = hosts.select("place", "host_n", "place.domain", "place.suffix").join(domain_prior, ["domain", "suffix"])
    priors = kept(
        host_prior.select("place", _blend(F.col("host_n"), F.col("domain_p"), fusion.smoothing).alias("prior")), "langid-priors"
    )
    # P(declared | language) from the same beliefs: a row per declared tag, the columns scaled to their sums.
    tags = beliefs.groupBy("declared").agg(_sums(F.col("belief"), width).alias("tag_n"))
    doubt, kinds = fusion.declared_weight, width + 1
    said = kept(
        tags.select(
            "declared",
            F.array(
                *[F.log((F.col("tag_n")[i] + doubt / kinds) / F.lit(float(total[i] + doubt))) for i in range(width)]
            ).alias("said"),
        ),
        "langid-declared",
    )
    fused = evidence.join(priors, "place").join(said, "declared")
    logs = F.zip_with(
        F.zip_with("evidence", "prior", lambda x, p: x + F.log(p)), F.col("said"), lambda x, s: x + s
    )
    names = F.array(*[F.lit(name) for name in (*languages, UNDETERMINED)])
    posterior = _normalised(logs)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    text_best = F.array_position("evidence", F.array_max("evidence")).cast("int")
    chosen = (
        fused.withColumn("posterior", posterior)
        .withColumn("best", F.element_at(names, best))
        .withColumn("probability", F.array_max("posterior"))
        .withColumn("text_language", F.element_at(names, text_best))
    )
    accepted = (
        (F.col("best") != UNDETERMINED) & (F.col("text_language") != UNDETERMINED) & (F.col("probability") >= fusion.reject_below)
    )
    return chosen.withColumn("accepted", accepted).select(
        "id",
        F.when(F.col("accepted"), F.col("best")).otherwise(F.lit(UNDETERMINED)).alias("language"),
        F.round("probability", 6).alias("probability"),
        "accepted",
        "text_language",
        F.nullif("declared", F.lit("")).alias("declared"),
        F.col("place.host").alias("host"),
    )
