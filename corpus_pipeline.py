"""Five stages over ``documents``: quality, near-duplicates, repeated passages, personal data, packing.

Each stage takes what the one before it kept, as a table on disk. All but the last return the
columns of ``documents``, with their types; the last returns the packed pieces.

Cases: a null text counts as empty and stays null; empty texts are judged, deduplicated and packed
like others (all texts without words are near-duplicates of each other, so one of them stays); very
long texts are taken whole; repeated rows are near-duplicates, and rows that share the ``doc_id`` that
stays stay with it; a null ``doc_id`` is carried and removes no passage; columns beside those of
``documents`` are carried whatever their names, ``n_chars`` follows a changed text; an empty table gives
no pieces. A stage's intermediate tables, and the table it read, are deleted once its result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridfront.llm import packing, pii, quality, simhash, substring
from gridfront.llm.common import cut, release, scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least ``doc_id``."""
    return simhash.keep_first(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one before them has."""
    return substring.remove(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that training reads."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)


STAGES = [("quality classifier", good), ("near-dedup", single), ("substring dedup", unrepeated), ("personal data", private), ("packing", packed)]

#: SQL cannot express the trained stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch():
            rows = stage(spark, docs, sf_dir)
            docs = cut(rows, f"stage-{name.replace(' ', '-')}", kept=True)
        release(before)
    return docs
