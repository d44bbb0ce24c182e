"""The registered queries of the operators for training data and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.llm import langid
from docsluice.llm.chat import against_other_replies, preference_pairs
from docsluice.llm.decontaminate import decontaminate, items_digest
from docsluice.llm.exact_dedup import exact_dedup
from docsluice.llm.lm import score_texts
from docsluice.llm.mixing import mix_sources
from docsluice.llm.packing import pack
from docsluice.llm.prefix_trie import ordered_turns, prefix_trie, with_borrowed_heads
from docsluice.llm.simhash import CLOSE, near_duplicates
from docsluice.llm.spelling import spelling_groups, word_counts
from docsluice.llm.suffix_dedup import remove_repeats
from docsluice.llm.topk import top_k, usable
from docsluice.llm.urls import Rule, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def crc32_sql(codes: str) -> str:
    """The unsigned CRC-32 of a list of bytes; `crc_table`, the CTE of CRC_TABLE, stands in FROM."""
    step = "lambda c, b: xor(crc_table.t[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce({codes}, {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


CRC_TABLE = """
    crc_table AS MATERIALIZED (
      SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, i)
        ORDER BY i) AS t
      FROM range(0, 256) r(i))"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page; the text model comes from all labelled documents."""
    model = langid.train(_table(spark, folder, "documents"))
    pages = _table(spark, folder, "pages").select(
        F.col("page_id").alias("id"),
        F.col("html").alias("text"),
        langid.declared_language(F.col("html")).alias("declared"),
        langid.host_levels(F.col("url")).alias("place"),
    )
    return langid.identify(pages, model, html=True).withColumnRenamed("id", "page_id")


@_query(
    "op2_top_k",
    """
    WITH usable AS (
      SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
      FROM embeddings
      WHERE len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 5
    """,
)
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest rows by integer inner product of every vector whose id is divisible by 50."""
    rows = _table(spark, folder, "embeddings").filter(usable(F.col("embedding")))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return top_k(whole, F.col("vec_id") % 50 == 0, k=5)


@_query("op3_pack")
def op3_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, every sequence in the proportions of the sources."""
    pieces = pack(_table(spark, folder, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"
    )


@_query(
    "op4_exact_dedup",
    f"""
    WITH texts AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM texts WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays in its place."""
    return exact_dedup(_table(spark, folder, "documents"))


@_query("op5_simhash_dedup")
def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint of 3-word shingles and its component."""
    return near_duplicates(_table(spark, folder, "documents"), scheme=CLOSE)


RULES = [
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
]


@_query("op6_url_filter")
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page address judged by the rules, else by the trees."""
    return judge_urls(_table(spark, folder, "pages"), RULES)


@_query(
    "op7_mix_sources",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        sha256('42-' || CAST(doc_id AS VARCHAR)) AS place
      FROM documents),
    totals AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
      FROM sized GROUP BY source),
    bounds AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS bound FROM totals),
    levels AS (
      SELECT *,
        CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(bound) OVER earlier, 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open_weight,
        row_number() OVER o AS step
      FROM bounds
      WINDOW o AS (ORDER BY bound / weight, source NULLS LAST),
        earlier AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (
      SELECT coalesce(
        arg_min(rest / open_weight, step) FILTER (WHERE bound > rest / open_weight * weight),
        max(rest / open_weight)) AS level
      FROM levels),
    quotas AS (
      SELECT source, source_size, least(bound, level * weight) AS target,
        CAST(floor(least(bound, level * weight)) AS BIGINT) AS quota
      FROM bounds, level),
    placed AS (
      SELECT s.*, q.source_size, q.target,
        CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes,
        CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest,
        sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source)
    SELECT doc_id, size, source_size, target,
      CAST(size * (passes + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM placed
    """,
)
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in a mix whose sources weigh 5, 2, 1 in turn, each at most three times its size."""
    chosen, sources = mix_sources(_table(spark, folder, "documents"), F.array("source"))
    own = chosen.select("doc_id", "size", "taken", F.col("pattern")[0].alias("own"))
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    return own.join(sources.withColumn("own", named), "own").select("doc_id", "size", "source_size", "target", "taken")


@_query("op8_remove_repeats")
def op8_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the strings of 200 bytes that start anywhere else as well."""
    found = remove_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.to_json("spans").alias("removed"))


@_query("op9_lm_score")
def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by the word counts and by the model of the documents that are not held out."""
    return score_texts(_table(spark, folder, "documents"))


@_query(
    "op10_preference_pairs",
    r"""
    WITH own AS (
      SELECT DISTINCT conv_id AS pair_id, coalesce(turn, -9223372036854775808) AS turn,
        coalesce(role, 'user') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
    ends AS (SELECT pair_id, max(turn) AS ends_at FROM own WHERE role = 'assistant' GROUP BY pair_id),
    replies AS (
      SELECT pair_id, ends_at, min(text) AS reply FROM own JOIN ends USING (pair_id)
      WHERE role = 'assistant' AND turn = ends_at GROUP BY ALL),
    sides AS (
      SELECT pair_id, turn, role, text, TRUE AS c, FALSE AS r FROM own JOIN ends USING (pair_id) WHERE turn <= ends_at
      UNION ALL
      SELECT pair_id, turn, role, text, FALSE, TRUE FROM own JOIN ends USING (pair_id) WHERE turn < ends_at
      UNION ALL
      SELECT l.pair_id, l.ends_at, 'assistant', o.reply, FALSE, TRUE
      FROM ends l JOIN replies o ON o.pair_id = xor(l.pair_id, 1)),
    lines AS (SELECT pair_id, turn, role, text, bool_or(c) AS c, bool_or(r) AS r FROM sides GROUP BY ALL),
    parting AS (SELECT pair_id, min(turn) AS parts_at FROM lines WHERE c <> r GROUP BY pair_id),
    placed AS (
      SELECT lines.*, coalesce(turn < parts_at, TRUE) AS shared FROM lines LEFT JOIN parting USING (pair_id)),
    parts AS (
      SELECT *, 'prompt' AS part FROM placed WHERE shared
      UNION ALL SELECT *, 'chosen' FROM placed WHERE NOT shared AND c
      UNION ALL SELECT *, 'rejected' FROM placed WHERE NOT shared AND r),
    rendered AS (
      SELECT *, '<|im_start|>' || role || chr(10) AS opening,
        '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
      FROM parts)
    SELECT pair_id, part, turn, role, rendered,
      CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(opening) ELSE length(rendered) END AS masked_chars,
      CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(rendered) - length(opening) ELSE 0 END AS trained_chars
    FROM rendered
    """,
)
def op10_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation that has a reply, paired with itself under another conversation's reply."""
    return preference_pairs(*against_other_replies(_table(spark, folder, "conversations")))


@_query(
    "op11_decontaminate",
    r"""
    WITH texts AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
      FROM documents),
    items AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
      FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS string
      FROM (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0)),
    met AS (
      SELECT doc_id, n, pos, item_id
      FROM (
        SELECT doc_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS string,
          unnest(range(1, len(w) - n + 2)) AS pos
        FROM texts, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
      JOIN windows USING (n, string)),
    hits AS (
      SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM met) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM met) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the words that stand in windows of 10 words of the benchmark."""
    found = decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), texts=False)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@_query(
    "op12_spelling_groups",
    rf"""
    WITH RECURSIVE {CRC_TABLE.strip()},
    runs AS (
      SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents)
      GROUP BY ALL),
    hashed AS (
      SELECT run, n, {crc32_sql("flatten([CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')])")} AS h
      FROM runs, crc_table),
    words AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    shorter AS (
      SELECT word, n, unnest(range(1, length(word) + 1)) AS place,
        unnest([left(word, i - 1) || substr(word, i + 1) FOR i IN range(1, length(word) + 1)]) AS rest
      FROM words),
    pairs AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
      UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
      UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
    near AS (SELECT word, count(*) AS n_near, min({{'n': -other_n, 'other': other}}) AS best FROM pairs GROUP BY word),
    formed AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * w.n THEN best.other END AS form,
        CASE WHEN -best.n >= 2 * w.n THEN -best.n END AS form_n
      FROM words w LEFT JOIN near ON near.word = w.word),
    paths AS (
      SELECT word, word AS root, form AS next FROM formed
      UNION ALL SELECT p.word, f.word, f.form FROM paths p JOIN formed f ON f.word = p.next)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM paths WHERE next IS NULL) USING (word)
    """,
)
def op12_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word of the documents with its near words' most frequent form and the root of its forms."""
    return spelling_groups(word_counts(_table(spark, folder, "documents")))


@_query(
    "op13_prefix_trie",
    rf"""
    WITH {CRC_TABLE.strip()},
    own AS (
      SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) - 1 AS place, id, words
      FROM (
        SELECT conv_id AS c, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (
      SELECT c, c - c % 20 AS base, {crc32_sql("[ord(x) FOR x IN string_split(CAST(c AS VARCHAR), '')]")} % 4 AS h
      FROM (SELECT DISTINCT c FROM own), crc_table),
    rebuilt AS (
      SELECT convs.c, 0 AS part, place, id, words FROM convs JOIN own ON own.c = base AND place < h
      UNION ALL SELECT convs.c, 1, place, id, words FROM convs JOIN own ON own.c = convs.c AND place >= h),
    whole AS (
      SELECT convs.c, coalesce(list(id ORDER BY part, place) FILTER (WHERE id IS NOT NULL), []) AS ids,
        list(words ORDER BY part, place) AS words
      FROM convs LEFT JOIN rebuilt ON rebuilt.c = convs.c GROUP BY convs.c),
    prefixes AS (SELECT c, ids, words, len(ids) AS n, unnest(range(0, len(ids) + 1)) AS depth FROM whole),
    members AS (
      SELECT c, n, depth, array_to_string(ids[1:depth], '') AS path, array_to_string(ids[1:depth - 1], '') AS parent,
        CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words
      FROM prefixes),
    nodes AS (
      SELECT path, depth, any_value(parent) AS parent, any_value(words) AS words, min(c) AS conv_id, count(*) AS n_convs, max(n) AS longest,
        coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth), '') AS ends
      FROM members GROUP BY path, depth),
    children AS (SELECT parent AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    subtrees AS (
      SELECT m.path, m.depth, CAST(sum(CAST(b.longest = b.depth AS INT)) AS BIGINT) AS n_leaves,
        CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
      FROM nodes b JOIN members m ON m.c = b.conv_id AND m.depth <= b.depth GROUP BY ALL)
    SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
      sha256(x.ends) AS ends_sha256
    FROM nodes x LEFT JOIN children USING (path, depth) JOIN subtrees USING (path, depth)
      LEFT JOIN nodes p ON p.path = x.parent AND p.depth = x.depth - 1
    """,
)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every prefix of the conversations that were rebuilt with borrowed first turns."""
    turns, convs = with_borrowed_heads(ordered_turns(_table(spark, folder, "conversations")))
    return prefix_trie(turns, convs).drop("turn_id")
