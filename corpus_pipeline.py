"""A corpus pipeline: documents in, packed training sequences out.

Five stages, each an operator of ``shoalwater.llm`` applied to all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalwater.llm import common, exact_dedup, language, mixing, near_dedup, packing, tokens


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null, empty and letterless texts go."""
    return language.keepers(docs, language.model_path())


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal without white space."""
    return exact_dedup.keepers(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keepers(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target sizes: a row for each time that a document is taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    return packing.pack_documents(docs, tokens.vocabulary_path())


STAGES = [
    ("language", tell_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language ID, tokenizing and MinHash have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and reread as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.pin(stage(spark, docs, sf_dir), name)
    return docs
