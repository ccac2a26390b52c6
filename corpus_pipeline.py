"""A corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept; what it returns is written as a table and read again as the next
one's documents, so a lost executor never costs more than the stage at hand. All stages but the last return the columns
of documents. Null and empty texts have no language and go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skymill.llm import langid, packing, quality, queries, secrets, simhash
from skymill.llm.common import read_table, stage_table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (operator 6); the network learns from the documents that arrive."""
    return langid.keep_known(docs, langid.fit(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their host's record reject (operator 10)."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id (operator 8)."""
    return simhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with live secrets replaced in their texts (operator 3)."""
    return secrets.redact_live(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences (operator 4)."""
    return packing.pack_documents(docs, queries.word_model(queries.WORD_MODEL), end_id=2, with_ids=False)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The network of the first stage cannot be written as SQL; tests compare the stages with brute force.
ORACLE_SQL = None
