"""Every registered query of the search engine with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.text import csv_ints
from vicinal.operators import blocks, report
from vicinal.operators.knn import knn, knn_wide, merge_partials, pairwise, partials
from vicinal.plans import studies
from vicinal.plans.variants import run_variant
from vicinal.runtime import scratch_path
from vicinal.sources import generate, reports
from vicinal.sources.vectors import corpus, query_set

Query = Callable[[SparkSession, str], DataFrame]

#: (src, pos, variant, n, k, ms, recall) of made-up benchmark rows, the same in both engines.
BENCH = """(values
 (0, 0, 'baseline', 1000, 1, 10.0e0, 1.0e0), (0, 1, 'q2', 1000, 1, 8.0e0, 1.0e0), (0, 2, 'q16', 1000, 1, 5.0e0, null),
 (1, 0, 'baseline', 1000, 1, 20.0e0, 1.0e0), (1, 1, 'q4', 2000, 2, 6.0e0, 0.5e0), (1, 2, 'heap', 2000, 2, 9.0e0, 0.95e0),
 (1, 3, 'tiled', 2000, 2, 7.0e0, 1.0e0)) as bench(src, pos, variant, n, k, ms, recall)"""

PAIRS = """select a.vec_id q_id, b.vec_id x_id,
 list_reduce(list_transform(generate_series(1, 64), lambda i: (a.embedding[i] - b.embedding[i]) * (a.embedding[i] - b.embedding[i])), lambda u, v: u + v) dist
 from embeddings a, embeddings b where a.vec_id % 100 = 0"""


def _knn_sql(k: int) -> str:
    return f"select q_id, rank, x_id, dist from (select *, cast(row_number() over (partition by q_id order by dist, x_id) as integer) rank from ({PAIRS})) where rank <= {k}"


def _bench(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from {BENCH}")


def _search(k: int, variant: str = "baseline", **options) -> Query:
    return lambda s, d: run_variant(variant, query_set(s, d), corpus(s, d), k, **options)


def _over_bench(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(_bench(s))


def _tiny_corpus(s: SparkSession, d: str) -> DataFrame:
    return s.sql("select cast(x_id as bigint) x_id, cast(array(a, b) as array<float>) x_vec from (values (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 3, 4), (4, 0, 0)) as t(x_id, a, b)")


def _tiny_query(s: SparkSession) -> DataFrame:
    return s.sql("select cast(0 as bigint) q_id, cast(array(0, 0) as array<float>) q_vec")


def _throughput(df: DataFrame) -> DataFrame:
    return report.throughput(df.withColumnRenamed("ms", "query_ms")).select("src", "pos", "ms_per_query", "queries_per_second")


def _qps(df: DataFrame) -> DataFrame:
    return report.qps_error(report.mean_std(df.withColumnRenamed("ms", "query_ms"), ["variant", "n", "k"])).select("variant", "n", "k", "mean_queries_per_second", "std_queries_per_second")


def _cluster_gather(s: SparkSession, d: str) -> DataFrame:
    rows = blocks.query_groups(corpus(s, d).select(F.col("x_id").alias("q_id")), 16)
    centers = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("group_id"), F.col("label").alias("center_label"))
    return blocks.gather(rows, centers).select("q_id", "group_id", "center_label")


#: Settings of the registered sweeps: variants, k, n and options.
SWEEPS: dict[str, tuple[list[str], list[int], list[int], dict]] = {
    "sweep_n": (["baseline"], [10], [2, 8, 400], {}),
    "sweep_tiled": (["tiled"], [1, 10], [4], {"tile_size": 125}),
    "sweep_variants": (["baseline", "heap", "q2", "q16", "tiled"], [3], [5], {"tile_size": 50}),
    "sweep_repeat": (["baseline", "q4"], [2], [3, 6], {"trials": 2}),
}


def _chart(df: DataFrame) -> DataFrame:
    return studies.chart_points(report.throughput(df.withColumnRenamed("ms", "query_ms")))


def _stored(read: Callable[[SparkSession, list[str]], DataFrame]) -> Query:
    """A reader over two reports that are written first: the rows of each src as a JSON document, and one failure."""

    def run(s: SparkSession, d: str) -> DataFrame:
        folder, rows = scratch_path(s, "reports"), _bench(s).orderBy("src", "pos").collect()
        for src in (0, 1):
            own = [{c: r[c] for c in ("variant", "n", "k", "ms", "recall")} for r in rows if r.src == src]
            reports.store_report(s, f"{folder}/{src}", {"m": 1000 + src, "d": 8}, own, [{"variant": "q2", "n": 5, "k": src, "error": "ValueError: no"}])
        return read(s, [f"{folder}/0", f"{folder}/1"])

    return run


QUERIES: dict[str, Query] = {
    **{f"knn_k{k}": _search(k) for k in (1, 2, 4, 8, 10, 16, 32, 64)},
    "knn_with_dists": lambda s, d: knn_wide(query_set(s, d), corpus(s, d), 10),
    "knn_heap_k10": _search(10, "heap"),
    "knn_qbatch2": _search(10, "q2"),
    **{f"knn_qgroup{n}": _search(10, f"q{n}") for n in (4, 8, 16, 32, 64, 128)},
    "knn_tiled": _search(10, "tiled", tile_size=125, strategy="arrow"),
    "knn_sorted": lambda s, d: knn(query_set(s, d), corpus(s, d), 10, strategy="sql").orderBy("q_id", "rank"),
    "knn_merge_partials": lambda s, d: merge_partials(partials(query_set(s, d), corpus(s, d), 10, tile_size=50), 10),
    "knn_k_gt_m": lambda s, d: knn(_tiny_query(s), _tiny_corpus(s, d), 9, pad=True),
    "pairwise_dist": lambda s, d: pairwise(query_set(s, d), corpus(s, d)),
    "scan_corpus": lambda s, d: corpus(s, d).select("x_id", F.size("x_vec").alias("d")),
    "tile_assign": lambda s, d: blocks.tile_assign(corpus(s, d), 125).select("x_id", "tile"),
    "query_groups": lambda s, d: blocks.query_groups(corpus(s, d).withColumnRenamed("x_id", "q_id"), 16).select("q_id", "group_id"),
    "query_prefix": lambda s, d: blocks.query_prefix(corpus(s, d).select(F.col("x_id").alias("q_id")), 100),
    "cluster_gather": _cluster_gather,
    "gen_gaussian": lambda s, d: generate.gaussian(s, 1000, 8),
    "gen_clustered": lambda s, d: generate.queries(s, 1000, 8, mode="clustered"),
    "bench_throughput": _over_bench(_throughput),
    "bench_mean_std": _over_bench(lambda df: report.mean_std(df.withColumnRenamed("ms", "query_ms"), ["variant", "n", "k"])),
    "bench_qps_error": _over_bench(_qps),
    "param_grid": lambda s, d: report.param_grid(s.sql("select k from (values (1), (2), (4), (8), (16), (32), (64)) as t(k)"), s.sql("select n from (values (1000), (2000), (4000), (8000), (16000)) as t(n)")),
    "parse_csv_ints": lambda s, d: s.sql("select '1, 2,,  40 ,800' as text").select(F.explode(csv_ints("text")).alias("value")),
    "recall_filter": _over_bench(report.recall_filter),
    "dedup_first": _over_bench(lambda df: report.dedup(df, ["k", "n"])),
    "dedup_last": _over_bench(lambda df: report.dedup(df, ["variant", "n"], last=True)),
    "union_results": _over_bench(lambda df: report.union_results(df.where("src = 0"), df.where("src = 1").drop("recall"))),
    "axis_union_distinct": _over_bench(lambda df: report.axis_values(df.where("src = 0"), df.where("src = 1"), "n")),
    "series_filter_sort": _over_bench(lambda df: report.series(df, "ms", n=2000, k=2)),
    "variant_order": _over_bench(report.ordered_variants),
    "compare_full_outer": _over_bench(lambda df: report.compare(df.where("src = 0 and variant = 'baseline'"), df.where("variant = 'tiled'"))),
    "panel_filter": _over_bench(lambda df: report.panels(df, [2, 64])),
    "json_results": _stored(lambda s, paths: reports.read_results(s, paths).select("src", "pos", "variant", "n", "k", "ms", "recall")),
    "json_meta": _stored(reports.read_meta),
    "json_failures": _stored(reports.read_failures),
    **{name: studies.study(*lists, **options) for name, (*lists, options) in SWEEPS.items()},
    "sweep_failures": studies.failures(["baseline", "heap", "tiled"], [0, 2], [3]),
    "block_choice": studies.block_choice,
    "chart_points": _over_bench(_chart),
}

_STATS = f"select variant, n, k, count(ms) trials, avg(ms) mean_query_ms, stddev_pop(ms) std_query_ms from {BENCH} group by variant, n, k"

ORACLE: dict[str, str] = {
    **{f"knn_k{k}": _knn_sql(k) for k in (1, 2, 4, 8, 10, 16, 32, 64)},
    "knn_with_dists": f"select q_id, list(x_id order by rank) ids, list(dist order by rank) dists from ({_knn_sql(10)}) group by q_id",
    **{n: _knn_sql(10) for n in ("knn_heap_k10", "knn_qbatch2", "knn_tiled", "knn_sorted", "knn_merge_partials", *(f"knn_qgroup{n}" for n in (4, 8, 16, 32, 64, 128)))},
    "knn_k_gt_m": """with t(x_id, a, b) as (values (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 3, 4), (4, 0, 0)),
 r as (select x_id, cast(a * a + b * b as float) dist, row_number() over (order by a * a + b * b, x_id) rank from t)
 select cast(0 as bigint) q_id, cast(g as integer) rank, cast(coalesce(x_id, -1) as bigint) x_id, dist from range(1, 10) s(g) left join r on rank = g""",
    "pairwise_dist": PAIRS,
    "scan_corpus": "select vec_id x_id, cast(len(embedding) as integer) d from embeddings",
    "tile_assign": "select vec_id x_id, vec_id // 125 tile from embeddings",
    "query_groups": "select vec_id q_id, vec_id // 16 group_id from embeddings",
    "query_prefix": "select vec_id q_id from embeddings where vec_id < 100",
    "cluster_gather": "select a.vec_id q_id, a.vec_id // 16 group_id, b.label center_label from embeddings a join embeddings b on a.vec_id // 16 = b.vec_id",
    "gen_gaussian": f"select i x_id, {generate.vector_sql(42, 'i', 8)} x_vec from range(1000) t(i)",
    "gen_clustered": f"""select q_id, group_id, list_transform(generate_series(1, 8), lambda j: cast(center[j] + noise[j] as float)) q_vec
 from (select i q_id, i // 16 group_id, {generate.vector_sql(43, '(i // 16)', 8)} center, {generate.vector_sql(44, 'i', 8, 0.05)} noise from range(1000) t(i))""",
    "bench_throughput": f"select src, pos, ms / n ms_per_query, n / (ms * 1e-3) queries_per_second from {BENCH}",
    "bench_mean_std": _STATS,
    "bench_qps_error": f"select variant, n, k, n / (mean_query_ms * 1e-3) mean_queries_per_second, n * std_query_ms / (mean_query_ms * mean_query_ms * 1e-3) std_queries_per_second from ({_STATS})",
    "param_grid": "select k, n from (values (1), (2), (4), (8), (16), (32), (64)) a(k), (values (1000), (2000), (4000), (8000), (16000)) b(n)",
    "parse_csv_ints": "select cast(trim(v) as bigint) \"value\" from (select unnest(string_split('1, 2,,  40 ,800', ',')) v) where trim(v) <> ''",
    "recall_filter": f"select * from {BENCH} where coalesce(recall, 0) >= 0.9",
    "dedup_first": f"select * from {BENCH} qualify row_number() over (partition by k, n order by src, pos) = 1",
    "dedup_last": f"select * from {BENCH} qualify row_number() over (partition by variant, n order by src desc, pos desc) = 1",
    "union_results": f"select src, pos, variant, n, k, ms, case when src = 0 then recall end recall from {BENCH}",
    "axis_union_distinct": f"select distinct n from {BENCH} order by n",
    "series_filter_sort": f"select * from {BENCH} where n = 2000 and k = 2 order by ms",
    "variant_order": f"""select variant, cast(row_number() over (order by g, num, variant) as integer) place from (select variant,
 case when variant = 'baseline' then 0 when variant = 'heap' then 1 when regexp_full_match(variant, 'q[0-9]+') then 2 else 3 end g,
 case when regexp_full_match(variant, 'q[0-9]+') then cast(substr(variant, 2) as bigint) else 0 end num from (select distinct variant from {BENCH}))""",
    "compare_full_outer": f"""select coalesce(a.k, b.k) k, coalesce(a.n, b.n) n, a.ms base_ms, b.ms tiled_ms
 from (select * from {BENCH} where src = 0 and variant = 'baseline') a full join (select * from {BENCH} where variant = 'tiled') b on a.k = b.k and a.n = b.n""",
    "panel_filter": f"select * from {BENCH} where k in (2, 64)",
    "json_results": f"select src, pos, variant, cast(n as bigint) n, cast(k as bigint) k, ms, recall from {BENCH}",
    "json_meta": "select cast(1000 as bigint) m, cast(8 as bigint) d",
    "json_failures": "select cast(src as integer) src, 'q2' as variant, cast(5 as bigint) n, cast(src as bigint) k, 'ValueError: no' as error from range(2) t(src)",
    **{name: studies.study_sql(*lists, **options) for name, (*lists, options) in SWEEPS.items()},
    "sweep_failures": "select variant, cast(3 as bigint) n, cast(0 as integer) k, 'ValueError: k must be at least 1' error from (values ('baseline'), ('heap'), ('tiled')) t(variant)",
    "block_choice": studies.BLOCK_SQL,
    "chart_points": f"""select 'k = ' || k line, cast(n as double) x, n / (ms * 1e-3) y from (select * from {BENCH} where coalesce(recall, 0) >= 0.9)
 qualify row_number() over (partition by k, n order by src, pos) = 1""",
}
