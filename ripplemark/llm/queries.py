"""The corpus operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, media, mixing, packing, sharding, simhash, topk, toxicity, warc
from .shared import WORD_COUNT_SQL, read, scratch_path


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_rows(read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all rows to every row whose id is divisible by 100."""
    vectors = read(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, queries=vectors.where("vec_id % 100 = 0"))
    return found.withColumn("distance", F.round("distance", 6))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the layouts that their shapes suggest, and back to canonical turns."""
    records = chat.conversation_records(read(spark, sf_dir, "conversations"))
    return chat.format_chats(records, "conv_id").select("conv_id", "layout", F.inline("turns"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a PNG in a binary column, read back and hashed."""
    return media.describe_images(media.vector_images(read(spark, sf_dir, "embeddings")), "vec_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files in the shared folder and read back, digests verified."""
    pages = read(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write_warc(pages.select(F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")).alias("record_id"), "url", F.encode("html", "UTF-8").alias("payload")), path)
    number = F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    return warc.read_warc(spark, path).select(number.alias("page_id"), "url", "status", F.decode("payload", "UTF-8").alias("html"))


_WEIGHTS_SQL = " ".join(f"WHEN '{s}' THEN {w!r}::DOUBLE" for s, w in mixing.WEIGHTS.items())


def _md5_unit(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_IDENTITY_SQL = "coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, text, {WORD_COUNT_SQL.format('text')} AS size,
                  {_md5_unit(f"'{mixing.SEED}'", _IDENTITY_SQL)} AS u FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size, CASE source {_WEIGHTS_SQL} ELSE {mixing.DEFAULT_WEIGHT!r}::DOUBLE END AS weight
      FROM d GROUP BY source),
r AS (SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM s) * (SELECT sum(size) FROM s) * {mixing.EPOCHS!r}::DOUBLE / size
      ELSE 0.0::DOUBLE END AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r WHERE rate > 0),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
c AS (SELECT source, list(cdf) AS cdf FROM p GROUP BY source),
n AS (SELECT d.*, len(list_filter(c.cdf, lambda x: x <= d.u)) AS times FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, text, copy, substr(md5(concat_ws(':', '{mixing.SEED}', 'order', {_IDENTITY_SQL}, copy::VARCHAR)), 1, 16) AS shuffle_key
FROM (SELECT doc_id, source, text, unnest(range(0, times))::INTEGER AS copy FROM n)
"""

OP2_SQL = f"""
SELECT vec_id, neighbor_id, rank::INTEGER AS rank, round(d, 6) AS distance FROM (
    SELECT a.vec_id, b.vec_id AS neighbor_id, d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id, LATERAL (SELECT list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d)
    WHERE a.vec_id % 100 = 0)
WHERE rank <= {topk.K}
"""

OP5_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS turn FROM conversations),
s AS (SELECT conv_id, string_agg(coalesce(role, '?'), ',' ORDER BY turn) AS roles, bool_and(coalesce(text, '') <> '') AS filled FROM t GROUP BY conv_id),
l AS (SELECT conv_id, CASE
        WHEN roles = 'user,assistant' THEN CASE coalesce(conv_id, 0) % 3 WHEN 0 THEN 'prompt_response' WHEN 1 THEN 'prompt_completion' ELSE 'question_answer' END
        WHEN roles = 'system,user,assistant' AND filled THEN 'instruction' WHEN roles = 'assistant' THEN 'text'
        WHEN regexp_matches(roles, '^(user|assistant)(,(user|assistant))*$') THEN CASE coalesce(conv_id, 0) % 2 WHEN 0 THEN 'from_value' ELSE 'turns' END
        WHEN filled AND coalesce(conv_id, 0) % 2 = 0 THEN 'message_parts' ELSE 'messages' END AS layout FROM s)
SELECT t.conv_id, t.turn::INTEGER AS turn, t.role, t.text, l.layout FROM t JOIN l ON t.conv_id IS NOT DISTINCT FROM l.conv_id
"""

OP10_SQL = "SELECT page_id, url, 'ok' AS status, html FROM pages"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_topk": op2_topk,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_media": op6_media,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op2_topk": OP2_SQL, "op5_chat": OP5_SQL, "op10_warc": OP10_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
