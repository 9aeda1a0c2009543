"""The corpus operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, lm, quality, secret_scan, simhash, spans, toxicity, warc

#: Where the ranks lie; a parameter of the operator, not a file of this repository.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_bk(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spans.removed(docs, spans.repeated_spans(docs))


def op3_recurrent_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.held_out_scores(table(spark, folder, "documents"))


def op4_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find(table(spark, folder, "documents"), secret_scan.train())


def op5_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, folder, "documents"))


def op6_bm25_wand(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_toxicity_fm(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages"))


def op9_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_documents(table(spark, folder, "documents"))


def op10_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_bk, op2_sentence_spans, op3_recurrent_lm, op4_secret_forest, op5_language_codes, op6_bm25_wand, op7_toxicity_fm, op8_warc, op9_compression_bands, op10_bpe_tree)}


#: A digit of base32 is five bits; five hex digits hold four.
_OP8 = """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), first AS (SELECT hex, min(page_id) AS first_id FROM own GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM own JOIN first USING (hex)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": _OP8}
