"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, logbilinear, mixing, pii, sharding, simhash, topk, urlfilter
from .common import id_crc, load


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(7)) == 2
    model, counts = logbilinear.fit(docs.filter(~held))
    out = logbilinear.score(docs, model, counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the benchmark found in a document."""
    found = decontaminate.find_passages(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    one = found.select("doc_id", F.explode("found").alias("f"))
    return one.select("doc_id", "f.item_id", F.col("f.start").alias("start_char"), F.col("f.end").alias("end_char"), "f.edits")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents go into the shards; sizes and checksums are those of the texts that arrive there."""
    out = sharding.shards(load(spark, sf_dir, "documents"), weight=sharding.size_of(F.col("text")))
    size, crc = sharding.size_of(F.col("text")), F.crc32(F.coalesce("text", F.lit("")))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    model = langid.fit(docs.filter(~held))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(load(spark, sf_dir, "conversations"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(load(spark, sf_dir, "pages").select("page_id", "url"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_lm_scoring, op2_pii, op3_decontaminate, op4_sharding, op5_near_duplicates, op6_language, op7_mixing, op8_chat, op9_topk, op10_url_filter)
    return {f.__name__: f for f in (*own, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat": OP8, "op9_topk": OP9}


OP8 = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), s AS (
    SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), r AS (
    SELECT t.*, s.speaker,
        CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user ' || role || '|>' END || chr(10) || text || '<|end|>' || chr(10) AS segment
    FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), n AS (
    SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS end_char
    FROM r WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, turn, position,
    CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user' END AS chat_role,
    CASE WHEN role <> 'system' AND role <> speaker THEN role END AS name,
    text AS content, segment, CAST(end_char - length(segment) AS BIGINT) AS start_char, end_char, role = speaker AS trained
FROM n
"""

OP9 = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.row <> c.row AND q.vec_id % 20 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
