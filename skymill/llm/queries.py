"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import cache
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, langid, matching, packing, pii, quality, records, secrets, simhash, toxicity
from .common import read_table
from .oracles import ORACLE_SQL

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


@cache
def byte_model(path: str) -> bytes:
    return bpe.serialize_model(bpe.load_ranks(path))


@cache
def word_model(path: str) -> str:
    return Path(path).read_text()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), byte_model(RANKS), public_tokenizers.PATTERN)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.record_files(read_table(spark, sf_dir, "documents"), word_model(WORD_MODEL), end_id=1)
    return records.read_records(manifest, with_ids=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), word_model(WORD_MODEL), end_id=2, with_ids=False)


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_personal_data(read_table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(read_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", F.round("host_rate", 6).alias("host_rate"),
        F.coalesce("rejected", F.lit(False)).alias("host_rejected"), F.coalesce("suspect", F.lit(False)).alias("host_suspect"),
    )


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_matched_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = matching.pack_documents(read_table(spark, sf_dir, "documents"), word_model(WORD_MODEL), end_id=1, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_token_records, op3_secret_ownership, op4_packing, op5_toxicity, op6_language_id, op7_personal_data, op8_simhash, op9_embedding_neighbours, op10_host_quality, op11_divergence_audit, op12_matched_packing)}
__all__ = ["ORACLE_SQL", "QUERIES"]
