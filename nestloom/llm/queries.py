"""Queries of the corpus operators over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_text, langid, media, mixing, near_dedup, token_count, token_files, vocab, warc
from .common import table

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"
END_ID, TOKEN_LIMIT = 2, 4096


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where all kinds of evidence exist."""
    labelled = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), "text")
    return langid.identify_pages(table(spark, sf_dir, "pages"), labelled)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocab.path(BYTE_BPE))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_texts(table(spark, sf_dir, "documents")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocab.path(WORD_BPE), END_ID)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocab.path(PIECE_BPE), TOKEN_LIMIT)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 aims at: size and target of each source."""
    found = mixing.source_targets(table(spark, sf_dir, "documents"))
    return found.select("source", "source_size", F.round("target", 3).alias("target"))


_OPERATORS = (op1_language_id, language_id_pages, op2_byte_bpe, op3_media_columns, op4_token_files, op5_html_text, op6_source_mixing, mixing_targets, op7_minhash_dedup, op8_nearest_neighbours, op9_warc, op10_token_counts)
#: Least common share of the targets: the largest that any number of sources, capped in the order of cap to weight, leaves.
_TARGETS = r"""WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
c AS (SELECT *, sum(most) OVER before AS used, sum(weight) OVER () - sum(weight) OVER before + weight AS rest, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w WINDOW before AS (ORDER BY most / weight, source ROWS UNBOUNDED PRECEDING))
SELECT source, source_size, round(least(most, weight * max((total - used + most) / rest) OVER ()), 3) AS target FROM c"""
_ARCHIVE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT *, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last FROM p),
k AS (SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) AS again FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM k"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"mixing_targets": _TARGETS, "op9_warc": _ARCHIVE}
