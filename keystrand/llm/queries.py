"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, chat, decontaminate, langid, media, pii, quality, sentencepiece, tokenstore, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: what both turns of the extra conversation -7 say: the template's own control strings
HARD_TEXT = "\\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(HARD_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    rows = chat.canonical_rows(read(spark, sf_dir, "conversations")).unionByName(extra)
    return chat.digest(chat.format_turns(rows))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= 2).alias("contaminated"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.training_order(read(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(read(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_chat, op3_warc, op4_decontaminate, op5_langid, op6_pii, op7_training_order, op8_media, op9_near_duplicates, op10_sentencepiece)}


_ESCAPED = "replace(replace(replace(replace({0}, '\\', '\\b'), '<turn>', '\\lturn>'), '</turn>', '\\l/turn>'), '### ', '\\h## ')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    hard = HARD_TEXT.replace("'", "''")
    return {
        "op2_chat": f"""
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '{hard}' UNION ALL SELECT -7, 1, 'assistant', '{hard}')
            SELECT conv_id, count(*)::BIGINT AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(15 + length(replace({_ESCAPED.format("role")}, chr(10), '\\n')) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id""",
        "op3_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
            h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS head FROM p),
            v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INT, 5))::INT) AS five FROM h)
            SELECT page_id, payload_bytes,
                array_to_string(list_transform(five, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
                CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
            FROM v""",
        "op4_decontaminate": f"""
            WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
            items AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
            d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            s AS (SELECT DISTINCT n FROM items),
            win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
            hit AS (SELECT doc_id, win.n, i, item_id FROM win JOIN items ON win.n = items.n AND win.k = items.k),
            places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
            found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
                sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
            FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)""",
    }
