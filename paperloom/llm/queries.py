"""Queries of the training-data operators, with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lines, neardup, packing, pieces, quality, repeats, runs, tokens, trie, urls, vectors
from .common import materialize, table

#: Fixed values, as SQL: the ASCII white space, and host and path of a URL.
SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_HOST = """translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
SQL_PATH = """regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"""


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality", "text_quality", "meta_quality", "keep")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (
    SELECT rid, doc_id, i, parts[i] AS line,
        translate(trim(parts[i], {SQL_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT rid, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM doc)),
often AS (SELECT key FROM line WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (FROM often)) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (FROM often)), '')) AS kept_sha256
FROM line GROUP BY rid, doc_id
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.default_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = f"""
WITH part AS (SELECT page_id, {SQL_HOST} AS host, {SQL_PATH} AS path FROM pages),
fits AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM part)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '(^|[^0-9A-Za-z])({"|".join(urls.BLOCKED_WORDS)})($|[^0-9A-Za-z])') THEN 'block'
    ELSE 'allow' END AS verdict
FROM fits
"""

def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


#: Vectors that take part, as SQL.
SQL_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
OP3_SQL = f"""
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {SQL_FINITE}),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


OP4_SQL = f"""
WITH RECURSIVE unit AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE {SQL_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT x AS vec_id, (SELECT count(*) FROM link WHERE link.x = reach.x) AS n_links, min(y) AS component_id, min(y) = x AS kept
FROM reach GROUP BY x
"""

def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), declared="lang", host="source")
    return found.select("doc_id", F.col("lang").alias("declared"), "language", "language_probability", "text_language", "keep")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = language.page_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = language.identify(pages, declared="declared", host="host", suffix="suffix")
    return found.select("page_id", "declared", "suffix", "language", "language_probability", "text_language", "keep")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_offsets(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.code_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def replanted(docs: DataFrame) -> DataFrame:
    """The contract's input: of every tenth document, by the checksum of its id, the words from one on become periodic."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))  # a null id: as it is
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("words")
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % period).cast("int")))
    marked = docs.withColumn("words", F.when(h % 10 == 0, words))
    return marked.withColumn("text", F.when(F.size("words") > 0, F.array_join(again, " ")).otherwise(F.col("text"))).drop("words")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(replanted(table(spark, sf_dir, "documents").select("doc_id", "text")), shortest=12)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("length"), r.start.alias("start"), r.period.alias("period")))), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.withColumns({"longest": longest, "lines": F.array_join(lines, "")})
    length, period = -F.col("longest.length"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def shared_beginnings(sequences: DataFrame) -> DataFrame:
    """The contract's input: each conversation begins with the first turns of the first of its five."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    others = sequences.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    met = sequences.join(others, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left").withColumn("h", h)
    nothing = F.slice("turns", 1, 0)
    return met.select("conv_id", F.concat(F.coalesce(F.slice("base_turns", 1, F.col("h")), nothing), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(shared_beginnings(materialize(trie.turn_sequences(table(spark, sf_dir, "conversations")), "turn-sequences")))


OP13_SQL = """
WITH turned AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT range AS v, list_reduce(list_prepend(range::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS crc FROM range(256)),
crcs AS (SELECT list(crc ORDER BY v) AS t FROM bits),
conv AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
        xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turned), crcs),
rebuilt AS (
    SELECT c.conv_id, t.i, 0 AS own, t.role, t.text FROM conv c JOIN turned t ON t.conv_id = c.base AND t.i <= c.h
    UNION ALL SELECT c.conv_id, t.i, 1, t.role, t.text FROM conv c JOIN turned t ON t.conv_id = c.conv_id AND t.i > c.h),
step AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, sha256(length(role) || ':' || role || text) AS turn, strlen(text) AS size FROM rebuilt),
prefix AS (
    SELECT conv_id, depth, size, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, count(*) OVER (PARTITION BY conv_id) AS long FROM step
    UNION ALL SELECT conv_id, 0, 0, '', (SELECT count(*) FROM step s WHERE s.conv_id = conv.conv_id) FROM conv),
link AS (SELECT conv_id, depth, node, size, long, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM prefix),
node AS (
    SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) * (count(*) - 1) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE long = depth), '')) AS ends_sha256
    FROM link GROUP BY node, depth),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
flat AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids USING (node, depth)),
below AS (
    SELECT top.node, top.depth, sum(low.saved) AS saved_tokens, count(*) FILTER (WHERE low.n_children = 0) AS n_leaves
    FROM flat low JOIN link me ON me.conv_id = low.conv_id AND me.depth <= low.depth JOIN node top ON top.node = me.node AND top.depth = me.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM flat f JOIN below b USING (node, depth) LEFT JOIN node p ON p.node = f.parent AND p.depth = f.depth - 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "pages_language_id": pages_language_id,
    "op7_token_store": op7_token_store,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_packing": op9_packing,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_trie": op13_conversation_trie,
}
SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op3_exact_top_k": OP3_SQL,
    "op4_embedding_near_dedup": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op13_conversation_trie": OP13_SQL,
}
