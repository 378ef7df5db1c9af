"""The registered queries of the training-data operators, and SQL where it can express one.

Each query applies its operator, with production parameters, to its whole table; the digest columns are derived
from the operator's own result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, jaccard_join, lexical_search, line_dedup, lm_scoring, mixing, prefix_trie, secret_ledger, sentencepiece_scan, token_files, toxicity, vector_graph


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix weighted 5, 2, 1 of 150% of all words takes of each document."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one canonical JSON array, with linked tool calls."""
    return chat.format_chat(read(spark, sf_dir, "conversations"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to a compressed file set and read back from it."""
    return token_files.token_digest(read(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    scored = toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return vector_graph.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to SentencePiece ids and decoded from them."""
    return sentencepiece_scan.encode_digest(read(spark, sf_dir, "documents"), model_path=tokenizer_path("piece_bpe_32k.model"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are linked at a Jaccard similarity of 0.85."""
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), words=4, percent=85)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between the good documents and all documents."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(read(spark, sf_dir, "documents"), good)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier line within one edit."""
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of all conversations, many of which start as another one does."""
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"), every=20, heads=4)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for each benchmark item."""
    return lexical_search.ranked_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_ledger.secret_digest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_chat, op3_token_files, op4_toxicity, op5_neighbours, op6_fingerprints, op7_sentencepiece, op8_jaccard_join, op9_lm_scoring, op10_line_dedup, op11_prefix_trie, op12_lexical_search, op13_secret_scan)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The test conversations hold plain messages; tool calls are tested on fixtures.
CHAT_SQL = """
SELECT conv_id, count(*) AS n_messages, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_orphans, CAST(0 AS BIGINT) AS n_invalid,
  '[' || string_agg('{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN role IS NULL THEN '' ELSE ',' END END || CASE WHEN role IS NULL THEN '' ELSE '"role":' || CAST(to_json(role) AS VARCHAR) END || '}', ',' ORDER BY turn NULLS LAST, role, text) || ']' AS chat
FROM conversations GROUP BY conv_id
"""

JACCARD_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, '{_UPPER}', '{_LOWER}'), ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.t = b.t AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least ON doc_id = x
"""


#: crc32 is folded bit by bit over the digits of an id.
TRIE_SQL = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) FOR x IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS turns FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), nodes AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt) GROUP BY ALL
), linked AS (
  SELECT a.*, b.conv_id AS parent_conv_id, CASE WHEN a.depth = 0 THEN 0 ELSE (a.n_convs - 1) * len(regexp_extract_all(a.path[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth - 1 AND b.path = a.path[1:a.depth - 1]
), kids AS (
  SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids k USING (depth, conv_id)
), above AS (
  SELECT path[1:top] AS path, top AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(0, depth + 1)) AS top FROM counted) GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM counted JOIN above USING (depth, path)
"""

SEARCH_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
), docs AS (
  SELECT doc_id, t, len(t) AS n FROM words WHERE len(t) > 0
), totals AS (
  SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l FROM docs
), tfs AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term) CROSS JOIN totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) CROSS JOIN totals GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": CHAT_SQL, "op8_jaccard_join": JACCARD_SQL, "op11_prefix_trie": TRIE_SQL, "op12_lexical_search": SEARCH_SQL}
