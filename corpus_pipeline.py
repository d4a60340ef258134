"""Corpus pipeline: five stages, each one of the corpus operators.

    language_id     documents in no known language go
    exact_dedup     of equal texts the largest id stays
    simhash_dedup   of texts within two bits one document stays
    decontaminate   documents that hold a benchmark passage go
    packing         the rest is packed into sequences of 2048 tokens

Every stage's rows are written as Parquet in the shared folder and read again,
so a later stage starts from files and a lost executor costs no earlier work.
The folders stay, for inspection or a restart from the last finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlens.llm import decontam, exactdedup, langid, packing, simhash
from cartlens.runtime import scratch_folder
from cartlens.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the ones that are not held out."""
    return langid.keep_known(docs, langid.learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exactdedup.drop_exact_copies(docs, keep="max")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id."""
    return simhash.drop_near_copies(docs, shingle_words=3, radius=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, window=2048)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

#: SQL cannot express fingerprints, alignment or retrieval; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES, 1):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
