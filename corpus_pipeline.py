"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and all that the one before it kept; all
but the last return the columns of ``documents``. ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from histoloom.llm import mixing, packing, quality, shared, simhash, tokens, toxicity
from histoloom.llm.queries import table
from histoloom.ship import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    ship(spark)
    return quality.without_bad(docs, threshold=0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 on five-word shingles)."""
    ship(spark)
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of 150 % takes them."""
    ship(spark)
    return mixing.mixed_copies(docs, share=1.5, most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs, tokens.default_path(), end_id=1, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near-dedup", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the learned stages; tests/llm/test_twins.py holds each stage
#: against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return docs
