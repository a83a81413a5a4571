"""A corpus pipeline of five stages: civil, good, distinct, without repeats, packed.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and but for the last returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cooforge.llm.classify import fit_quality, fit_toxicity, keep_civil, keep_good
from cooforge.llm.common import shared_folder, table
from cooforge.llm.near import keep_one
from cooforge.llm.packing import pack_documents
from cooforge.llm.spans import dedup_documents

#: Null or empty tables give empty results; a document with a null text stays
#: until the last stage, where it is one end token.
#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_civil(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
