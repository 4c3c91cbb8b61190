"""The registered queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import linejoin, media, mixing, packing, paragraphs, preference, quality, simhash, topk, warc
from .common import table


def tokenizer_ranks() -> str:
    """The rank file of the vocabulary that byte_bpe_50k.json holds."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_ranks())


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents")).drop("row_hash")


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.stale_reply_pairs(table(spark, sf_dir, "conversations"))
    return preference.format_preferences(turns).withColumnRenamed("pair_id", "conv_id")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linejoin.line_classes(table(spark, sf_dir, "documents"), shortest=linejoin.SHORTEST).drop("row_hash")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_media": op3_media,
    "op4_mixing": op4_mixing,
    "op5_paragraphs": op5_paragraphs,
    "op6_preference": op6_preference,
    "op7_lines": op7_lines,
    "op8_topk": op8_topk,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
}

ORACLES = {
    "op6_preference": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), o AS (
  SELECT *, row_number() OVER w AS i,
         last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
         count(CASE WHEN role = 'assistant' THEN 1 END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT conv_id, i, role, text AS a, CASE WHEN role = 'assistant' AND later = 0 THEN coalesce(earlier, '') ELSE text END AS b FROM o
), c AS (
  SELECT conv_id, coalesce(min(CASE WHEN a <> b THEN i END) - 1, count(*)) AS n FROM p GROUP BY conv_id
), r AS (
  SELECT p.*, c.n,
         coalesce(sum(CASE WHEN i > n THEN length(role) + length(a) + 24 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sa,
         coalesce(sum(CASE WHEN i > n THEN length(role) + length(b) + 24 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb
  FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id WINDOW w AS (PARTITION BY p.conv_id ORDER BY i)
), s AS (
  SELECT conv_id, i, n, role,
         '<|im_start|>' || role || chr(10) || a || '<|im_end|>' || chr(10) AS ra,
         '<|im_start|>' || role || chr(10) || b || '<|im_end|>' || chr(10) AS rb,
         CAST(sa + 13 + length(role) AS BIGINT)::VARCHAR || ':' || CAST(sa + 23 + length(role) + length(a) AS BIGINT)::VARCHAR AS ma,
         CAST(sb + 13 + length(role) AS BIGINT)::VARCHAR || ':' || CAST(sb + 23 + length(role) + length(b) AS BIGINT)::VARCHAR AS mb
  FROM r
)
SELECT conv_id, CAST(any_value(n) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(ra, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
       coalesce(string_agg(ra, '' ORDER BY i) FILTER (i > n), '') AS chosen,
       coalesce(string_agg(ma, ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(rb, '' ORDER BY i) FILTER (i > n), '') AS rejected,
       coalesce(string_agg(mb, ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY conv_id
""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) END AS k FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN k IS NULL OR k = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k IS NULL OR k = page_id THEN NULL ELSE k END AS refers_to
FROM g
""",
}
