"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next.

Quality classifier, near-duplicate join, removal of repeated passages, benchmark decontamination, and byte-level BPE. Each takes
``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. They keep the ways of their operators with null, empty, repeated and very
long texts: a null or empty text is scored by the classifier's bias, is no near duplicate, and passes the other stages as it is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.llm import bpe, decontaminate, jaccard, quality, repeats
from riskmart.llm.components import store
from riskmart.llm.ship import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores 0.7 or more."""
    ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.75 of 5-word shingles, the document with the smallest id."""
    ship(spark)
    return jaccard.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 200 bytes are cut out; ``n_chars`` follows the text."""
    ship(spark)
    cut = repeats.remove_repeats(docs, keep="first")
    if "n_chars" not in docs.columns:
        return cut
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: number, digest, and digest of the text that they decode to."""
    ship(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(bpe.encode(docs, ranks), ranks)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("decontamination", decontaminated),
    ("token_ids", token_ids),
]

#: A trained classifier has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every result but the last is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
