"""Seeded synthetic vectors. Values depend on (seed, id, dimension) alone, so partitioning doesn't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.blocks import gather


def _uniform(digest: Column, first: int) -> Column:
    """In (0, 1), from 13 hexadecimal digits of a digest."""
    return (F.conv(F.substring(digest, first, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def _normal(seed: int, i: Column, j: Column) -> Column:
    """Standard normal by the Box-Muller transform, from the MD5 of `seed|i|j`: any engine can draw the same."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string"), j.cast("string")).cast("binary"))
    return F.sqrt(F.lit(-2.0) * F.log(_uniform(digest, 1))) * F.cos(F.lit(6.283185307179586) * _uniform(digest, 14))


def _vector(seed: int, i: Column, d: int, scale: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: (_normal(seed, i, j) * F.lit(scale)).cast("float"))


def vector_sql(seed: int, i: str, d: int, scale: float = 1.0) -> str:
    """The same vector as a DuckDB expression over the id expression i."""
    part = lambda at: f"((cast('0x' || substr(md5('{seed}|' || {i} || '|' || j), {at}, 13) as bigint) + 0.5e0) / 4503599627370496e0)"
    return f"list_transform(generate_series(0, {d - 1}), lambda j: cast(sqrt(-2e0 * ln({part(1)})) * cos(6.283185307179586e0 * {part(14)}) * {scale!r}e0 as float))"


def gaussian(spark: SparkSession, rows: int, d: int, seed: int = 42, id_name: str = "x_id", vec_name: str = "x_vec") -> DataFrame:
    """rows vectors of d independent N(0, 1) float32 components, ids 0 to rows - 1."""
    return spark.range(rows).select(F.col("id").alias(id_name), _vector(seed, F.col("id"), d).alias(vec_name))


def queries(spark: SparkSession, n: int, d: int, seed: int = 43, mode: str = "gaussian", cluster_size: int = 16, cluster_noise: float = 0.05) -> DataFrame:
    """n query vectors: independent, or in clusters of cluster_size around Gaussian centers with scaled noise."""
    if mode == "gaussian":
        return gaussian(spark, n, d, seed, "q_id", "q_vec")
    if mode != "clustered":
        raise ValueError(f"unknown query mode {mode!r}")
    if cluster_size < 1:
        raise ValueError("cluster_size must be at least 1")
    centers = gaussian(spark, -(-n // cluster_size), d, seed, "group_id", "center")
    noisy = spark.range(n).select(F.col("id").alias("q_id"), F.floor(F.col("id") / cluster_size).alias("group_id"), _vector(seed + 1, F.col("id"), d, cluster_noise).alias("noise"))
    return gather(noisy, centers).select("q_id", "group_id", F.zip_with("center", "noise", lambda a, b: (a + b).cast("float")).alias("q_vec"))
