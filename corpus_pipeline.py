"""Cleaning pipeline over ``documents``: toxic documents go, one document of each
near-duplicate group stays, documents that leak benchmark items go, secrets are
masked, and what is left is encoded into piece ids.

Every stage works on all rows that the one before it kept; what each does with
null, empty and repeated rows is stated in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicscope.llm import decontaminate, minhash, piece_codec, secret_scan, toxicity
from topicscope.llm._bytes import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates share 0.8 of their five-word shingles (op9 itself takes four)."""
    return minhash.kept_documents(docs, shingle=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become their kind in brackets; ``n_chars`` follows the new text."""
    out = secret_scan.redacted(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("pieces", encode),
]

# trained models and Viterbi paths are beyond SQL; tests/llm compare each stage
# with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read back."""
    docs = _table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
