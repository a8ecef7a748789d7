"""Sweeps, block choices and charts as queries: everything of them that doesn't depend on the clock."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import fmean, pstdev

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.knn import corpus_blocks, query_block, screened
from vicinal.plans import charts
from vicinal.plans.sweep import sweep
from vicinal.runtime import scratch_path
from vicinal.sources import reports, svg
from vicinal.sources.vectors import corpus

ROW = "variant string, distribution string, m bigint, d int, n bigint, k int, trials int, reps int, recall double, strategy string, block int, tile_size int, n_tiles int, consistent boolean"
FAILURE = "variant string, n bigint, k int, error string"


def _consistent(r: dict) -> bool:
    """Times were taken, and every figure of the row follows from them."""
    ms, n = r["trial_query_ms"], r["n"]
    mean, spread = fmean(ms), pstdev(ms)
    want = {"query_ms": mean, "mean_query_ms": mean, "std_query_ms": spread, "ms_per_query": mean / n, "queries_per_second": 1000 * n / mean}
    want |= {"mean_queries_per_second": 1000 * n / mean, "std_queries_per_second": 1000 * n * spread / mean**2}
    return len(ms) == r["trials"] and min(ms) > 0 and all(math.isclose(r[c], v, rel_tol=1e-9, abs_tol=1e-9) for c, v in want.items())


def _run(spark: SparkSession, sf_dir: str, variants: list[str], ks: list[int], ns: list[int], **options) -> tuple[list[dict], list[dict]]:
    X = corpus(spark, sf_dir)
    Q = X.select(F.col("x_id").alias("q_id"), F.col("x_vec").alias("q_vec"))
    return sweep(X, Q, variants, ks, ns, warmup=0, reps=1, measure_recall=True, distribution="embeddings", **options)


def study(variants: list[str], ks: list[int], ns: list[int], **options) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of a sweep over the corpus, with its own first vectors as queries."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _ = _run(spark, sf_dir, variants, ks, ns, **options)
        names = [c.split()[0] for c in ROW.split(", ")]
        return spark.createDataFrame([tuple((r | {"consistent": _consistent(r)}).get(c) for c in names) for r in rows], ROW)

    return run


def failures(variants: list[str], ks: list[int], ns: list[int], **options) -> Callable[[SparkSession, str], DataFrame]:
    """What a sweep with impossible settings records while it goes on."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, failed = _run(spark, sf_dir, variants, ks, ns, skip_failures=True, **options)
        return spark.createDataFrame([(f["variant"], f["n"], f["k"], f["error"]) for f in failed], FAILURE)

    return run


def study_sql(variants: list[str], ks: list[int], ns: list[int], trials: int = 1, tile_size: int | None = None) -> str:
    """The same rows in SQL, which times nothing."""
    values = lambda xs: ", ".join(f"({x!r})" for x in xs)
    tile = "null" if tile_size is None else f"case when variant = 'tiled' then {tile_size} end"
    return f"""select variant, 'embeddings' distribution, m, d, cast(n as bigint) n, cast(k as integer) k, cast({trials} as integer) trials, cast(1 as integer) reps, 1e0 recall,
 case when variant = 'heap' or variant like 'q%' or n * m > 100000 then 'arrow' else 'sql' end strategy,
 cast(least(case when variant like 'q%' then cast(substr(variant, 2) as bigint) else n end, 256) as integer) block,
 cast({tile} as integer) tile_size, cast(ceil(m / {tile}) as integer) n_tiles, true consistent
 from (values {values(variants)}) a(variant), (values {values(ks)}) b(k), (values {values(ns)}) c(n),
 (select count(*) m, cast(max(len(embedding)) as integer) d from embeddings)"""


def block_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block sizes of a search by dimension, k and corpus size."""
    rows = [(m, d, k, query_block(d, k), corpus_blocks(m, d), screened(1000, k)) for m in (1000, 10**6, 10**9) for d in (8, 64, 128, 4096) for k in (1, 10, 64, 2048)]
    return spark.createDataFrame(rows, "m bigint, d int, k int, query_block bigint, corpus_blocks bigint, screened int")


BLOCK_SQL = """select m, d, k, cast(least(33554432 // (4 * d + 16), 8388608 // k) as bigint) query_block, (m * (4 * d + 16) + 67108863) // 67108864 corpus_blocks, least(k, 256) screened
 from (values (1000::bigint), (1000000), (1000000000)) a(m), (values (8), (64), (128), (4096)) b(d), (values (1), (10), (64), (2048)) c(k)"""


def chart_points(rows: DataFrame) -> DataFrame:
    """line, x, y of every point of a k sweep's chart, read back from the SVG document in the shared folder."""
    spark = rows.sparkSession
    path = scratch_path(spark, "chart")
    text = svg.chart(charts.k_sweep(rows), "k sweep", "queries", "queries per second", log_x=True)
    reports.store_text(spark, path, text)
    point = r"<title>(.*): (\S+), (\S+)</title>"
    titles = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(point), F.lit(0))).alias("t"))
    part = lambda i: F.regexp_extract("t", point, i)
    return titles.select(part(1).alias("line"), part(2).cast("double").alias("x"), part(3).cast("double").alias("y"))
