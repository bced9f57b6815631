"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, language_id, license_scan, mixing, pii, piece_fst, quality, simhash, suffix_dedup
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs), ["doc_id"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints_and_components(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("bucket")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.encoded(table(spark, sf_dir, "documents"), ["doc_id"], piece_fst.model_bytes())


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_groups(table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.draw(docs))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_mix_sources": op4_mix_sources,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_piece_codec": op7_piece_codec,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
}

ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op8_embedding_dedup": embedding_dedup.ORACLE,
    "op5_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
""",
}
