"""A training corpus from raw documents, in five stages; each works on all rows that the one before kept.

Toxic documents go, of each group of near duplicates one stays, documents that hold benchmark items go, secrets
are masked, and what is left is encoded.  SQL cannot express the classifier, the masks or the encoding, so
ORACLE_SQL is None and the tests hold each stage against a plain version.

All stages but the last return the columns of documents as they were, whatever others there are.  Null and empty
texts are clean and go through all of them; texts of any length are read whole; rows that repeat are treated alike;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontamination, ngram_join, secret_scan, sentencepiece_codec, toxicity
from siltstone.llm.shared import Scratch


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model does not reject; with no toxic label all of them."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least doc_id, with every row that repeats it; without words or id, each stays."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null and wordless items match nothing."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew."""
    return secret_scan.mask_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of all documents."""
    return sentencepiece_codec.encoded(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("secrets", secrets_masked),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document that the stages keep."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
