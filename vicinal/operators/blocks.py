"""Blocking keys of the corpus and of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_assign(X: DataFrame, tile_size: int) -> DataFrame:
    """Each corpus row with its tile, floor(x_id / tile_size)."""
    return X.withColumn("tile", F.floor(F.col("x_id") / tile_size).cast("bigint"))


def query_groups(Q: DataFrame, per_group: int) -> DataFrame:
    """Each query with its group, floor(q_id / per_group)."""
    return Q.withColumn("group_id", F.floor(F.col("q_id") / per_group).cast("bigint"))


def query_prefix(Q: DataFrame, n: int) -> DataFrame:
    """The first n queries by id; ids count from 0."""
    return Q.where(F.col("q_id") < n)


def gather(rows: DataFrame, centers: DataFrame, key: str = "group_id") -> DataFrame:
    """Positional lookup: each row with the center of its key; rows whose center is missing go."""
    return rows.join(centers, key)
