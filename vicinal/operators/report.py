"""Relational steps over benchmark rows: throughput, error propagation, dedup and chart-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.text import variant_rank


def throughput(runs: DataFrame) -> DataFrame:
    """Adds ms_per_query and queries_per_second to rows of n queries in query_ms milliseconds."""
    return runs.withColumns({"ms_per_query": F.col("query_ms") / F.col("n"), "queries_per_second": F.try_divide(F.col("n"), F.col("query_ms") * F.lit(1e-3))})


def mean_std(trials: DataFrame, keys: list[str], value: str = "query_ms") -> DataFrame:
    """Count, mean and population standard deviation of value per key."""
    return trials.groupBy(*keys).agg(F.count(value).alias("trials"), F.avg(value).alias(f"mean_{value}"), F.stddev_pop(value).alias(f"std_{value}"))


def qps_error(stats: DataFrame) -> DataFrame:
    """First-order error of queries per second from the mean and spread of the milliseconds; null at mean 0."""
    n, mean, std = F.col("n"), F.col("mean_query_ms"), F.col("std_query_ms")
    return stats.withColumns({"mean_queries_per_second": F.try_divide(n, mean * F.lit(1e-3)), "std_queries_per_second": F.try_divide(n * std, mean * mean * F.lit(1e-3))})


def param_grid(ks: DataFrame, ns: DataFrame) -> DataFrame:
    """All (k, n) settings of a sweep; both sides are a handful of parameters."""
    return ks.crossJoin(F.broadcast(ns))


def recall_filter(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Rows of at least that recall; a missing recall counts as 0."""
    return rows.where(F.coalesce("recall", F.lit(0.0)) >= least)


def dedup(rows: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """One row per key: that of the first (or last) file by src, then position."""
    order: list[Column] = [F.col("src").desc(), F.col("pos").desc()] if last else [F.col("src"), F.col("pos")]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def union_results(*frames: DataFrame) -> DataFrame:
    """Bag union of result files; columns that a file lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def axis_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column over two sources."""
    return a.select(column).union(b.select(column)).distinct().orderBy(column)


def series(rows: DataFrame, x: str, **equal) -> DataFrame:
    """Rows equal to the given values, ascending by x."""
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return rows.orderBy(x)


def ordered_variants(rows: DataFrame) -> DataFrame:
    """Distinct variants in chart order with their 1-based place. A handful of names, so one ordering task is enough."""
    names = rows.select("variant").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(*variant_rank("variant"))))


def compare(base: DataFrame, tiled: DataFrame) -> DataFrame:
    """Base and tiled rows paired by (k, n); a side that is missing is null."""
    a = base.select("k", "n", F.col("ms").alias("base_ms"))
    b = tiled.select("k", "n", F.col("ms").alias("tiled_ms"))
    return a.join(b, ["k", "n"], "full_outer")


def panels(rows: DataFrame, ks: list[int]) -> DataFrame:
    """Rows of the chosen k values."""
    return rows.where(F.col("k").isin(ks))

