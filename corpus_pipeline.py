"""The corpus pipeline: documents through quality, dedup, mixing and tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read back as the next stage's docs. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flockwatch.llm import exact_dedup, mixing, piece_fst, quality, simhash
from flockwatch.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):  # columns of any name pass through
        prefix = f"_{prefix}"
    scored = quality.score(docs, quality.train(docs), docs.columns, prefix)
    return scored.where(f"{prefix}kept").select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return piece_fst.encoded(docs, ["doc_id", "lang", "source"], piece_fst.model_bytes())


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The classifier is trained on the rows themselves, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
