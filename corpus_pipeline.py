"""Corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

Toxic documents and those that the quality rules reject go, one document of each near-duplicate group stays, documents of
unwanted domains are thinned towards the target weights, and the rest is encoded. All stages but the last return the
columns of `documents`. Every stage runs over all rows that its predecessor kept.

The mix caps rates at 1: no document is repeated, and documents of the leading (clean) domain aren't thinned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, quality, simhash, toxicity
from lodestone.llm.common import stored, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), max_rate=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality", keep_quality),
    ("near-duplicates", remove_near_duplicates),
    ("mixing", mix),
    ("encoding", encode),
]

#: Toxicity, fingerprints, rates and tokens have no SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
