"""The queries of this subpackage: each applies one operator to its whole table and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cistern.llm import (
    bpe, counts, extract, leaks, manifest, near, quality, shards, substring, tokenids, toxicity, warc, whitening,
)

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.transcode(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_copies(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_file_rows(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.fit(docs, labels.where(remainder != 1))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (remainder == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, groups=("lang",))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", "char_distance", "word_distance")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded_rows(table(spark, sf_dir, "documents"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_rows(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_rows(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_near_copies": op3_near_copies,
    "op4_token_files": op4_token_files,
    "op5_leaks": op5_leaks,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_extract": op9_extract,
    "op10_shards": op10_shards,
    "op11_substrings": op11_substrings,
    "op12_manifest": op12_manifest,
    "op13_whitening": op13_whitening,
}
# The digest in base 32: five bits of the SHA-1 for each letter, from two hex digits.
CHECKS: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT page_id, url, strlen(html) AS payload_bytes,
                array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    ((CAST('0x' || substr(h, CAST(i * 5 // 4 + 1 AS INT), 2) AS INT) >> CAST(3 - i * 5 % 4 AS INT)) & 31) + 1, 1)), '') AS payload_digest,
                min(page_id) OVER (PARTITION BY html) AS first_id
            FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first_id <> page_id THEN first_id END AS refers_to, url
        FROM d
    """,
    "op11_substrings": substring.check_sql(),
    "op12_manifest": manifest.check_sql(),
}
