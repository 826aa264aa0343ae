"""A corpus pipeline: each stage works on all that its predecessor kept, written as Parquet between stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noema.llm import decontaminate, langid, minhash, pieces, pii
from noema.llm.staging import Staging, prepare

#: Five words and a similarity of 0.8 or more. At 0.8 one of 24 bands of 4 is shared with probability 1 - 3e-6, and
#: fewer than 0.6 of 96 coordinates agree with probability 3e-6.
NEAR = minhash.Settings(percent=80, agreement=0.6)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; rejected ones go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_representatives(docs, NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, and token ids of every document with the digests of ids and decoded text."""
    prepare(spark)
    made = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)
    return made.drop("text", "decoded")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_personal_data", without_personal_data),
    ("encoded", encoded),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; each result is written and read again before the next one."""
    stage = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        before, docs = docs, stage.save(apply(spark, docs, sf_dir), name)
        stage.drop(before)
    return docs
