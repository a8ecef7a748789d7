"""Vector tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as x_id, x_vec."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("x_id"), F.col("embedding").alias("x_vec"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100, as q_id, q_vec."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
