"""A training corpus from raw documents: each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm import decontaminate, langid, mixing, sharding, simhash
from vicinal.runtime import ensure_importable, materialise, release, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that has 30 % of them, go; mixed texts of two or three languages stay."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays; null and repeated ids are treated like any others."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or edited, go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard of near-equal bytes."""
    return sharding.with_shard(docs)


STAGES = [
    ("language id", identify_language),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Language models, alignments and balanced sampling have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; of their files only the last stage's are left when this returns.

    Empty tables give no rows; null texts go at the first stage, as they have no letters. Columns beside
    those of documents are kept.
    """
    ensure_importable(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch():
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), outlive=True)
        if last is not None:
            release(last)
        last = docs
    return docs
