"""A corpus pipeline of five stages: from raw documents to training tokens in training order.

Every stage takes documents with any further columns, reads texts of any length
whole and gives no rows for an empty table; repeated rows count as copies. Null
and empty texts fail the quality rules, so later stages see none in ``run``; a
stage that is given some keeps them (near_dedup, secret_scans), never takes them
(source_mix) or gives them no tokens (byte_bpe). Null sources are one source,
and rows without an id are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.shared import materialize
from quarry.llm import bpe, mixing, neardup, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of document and host; the same columns."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of the least id; the same columns."""
    return neardup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with every secret masked; the same columns, n_chars set anew."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order; the same columns."""
    return mixing.apply(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the digests of ids and decoded bytes of each document."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]
#: SQL can't express the near-duplicate stage; tests compare near duplicates, masks and token ids with brute force, stage by stage, and check properties of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; each stage's rows are stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
