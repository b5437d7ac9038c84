"""The corpus pipeline: documents in, token ids out, each stage one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecskein.llm import bpe, mixing, quality_rules, secrets, simhash
from vecskein.llm.common import materialize, release
from vecskein.llm.queries import vocabulary_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by calibrated probabilities."""
    return mixing.sample(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document that is left."""
    return bpe.encode(docs, vocabulary_path())


STAGES = [
    ("quality rules", keep_quality),
    ("near copies", drop_near_copies),
    ("secret scan", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_tokens),
]

#: Compression ratios and BPE have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is written and read again; the one before it is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        release(before)
        before = docs
    return docs
