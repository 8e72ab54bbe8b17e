"""Corpus preparation: five stages, each over all that the one before kept.

Quality and toxicity models learn from the labelled documents of the stage's own input, outside the held-out fold.
Every stage but the last returns the columns of ``documents``; the last returns packed pieces with their token ids.

Defined results: rows with null texts go through every stage by the rules of its operator (a null text is scored like
an empty one, has fingerprint zero, holds no benchmark passage and packs as its end id); rows with null ids are scored
like others and are never learnt from; repeated rows are one near-duplicate group, of which one row stays, the first of
those with the least id; a very long text is read whole by every stage, by the rules of its operator; columns beyond
those of ``documents`` travel along unchanged under any name until packing, which does not read them; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacelab.llm import decontam, packing, quality, simhash, toxicity
from spacelab.llm.common import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field finds good enough."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram classifier does not find toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id."""
    return simhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    pieces = packing.packed(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("simhash", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The random field, the classifier and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
