"""The operators of this subpackage, applied to the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from histoloom.llm import chat, idfiles, licenses, media, mixing, packing, prefixhash, quality, simhash, tokens, toxicity
from histoloom.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return idfiles.through_files(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, label model and hashed scorer on all documents."""
    return quality.classify(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in all documents that quotes a license template."""
    return licenses.find(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic packing of all documents into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=1, capacity=2048)


def op5_prefixhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and of the next."""
    return prefixhash.compare(table(spark, sf_dir, "documents"))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference records from all conversations."""
    return chat.preferences(chat.answers_to_compare(chat.conversations(table(spark, sf_dir, "conversations"))))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as PNG images, read back, with digests and hashes."""
    return media.through_media(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their groups within 2 bits."""
    return simhash.groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_idfiles": op1_idfiles,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_packing": op4_packing,
    "op5_prefixhash": op5_prefixhash,
    "op6_preferences": op6_preferences,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op6_preferences": chat.SQL}
