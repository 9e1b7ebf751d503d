"""From raw documents to token ids: quality rules, near-duplicate removal, decontamination, surrogates, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The first four return the
columns of documents; the last returns doc_id, ids, n_tokens and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import decontamination, pieces, pii, quality, simhash
from ruleweave.llm.common import saved, table


def _packed(docs: DataFrame) -> DataFrame:
    """doc, a struct of all columns, beside the text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").cast("string").alias("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated isolation forest."""
    model = quality.calibrate(docs, table(spark, sf_dir, "labels"))
    return quality.assess(_packed(docs), model).where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    found = decontamination.contamination(_packed(docs), table(spark, sf_dir, "benchmark"), key="doc")
    n_hit = F.size("hits")
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select("doc.*")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.pseudonymise(docs, pii.run_key(spark), count=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    return pieces.encode(docs.select("doc_id", F.col("text").cast("string").alias("text")))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii_surrogates", surrogates),
    ("sentencepiece_encoding", encode),
]

#: The isolation forest and the encoder are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
