"""Timing and sweeps over variants, k and n, yielding report rows.

    python -m vicinal.plans.sweep --variants baseline,tiled --m 20000 --d 8 --k 1,10 --n 100,1000 --out report.json
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.text import parse_variants, whole_numbers
from vicinal.operators import report
from vicinal.operators.blocks import query_prefix
from vicinal.operators.knn import chosen, recall, screened
from vicinal.plans.variants import TILE, VARIANTS, attributes, run_variant
from vicinal.runtime import scratch
from vicinal.sources.generate import gaussian, queries
from vicinal.sources.reports import write_report

RAW = "number int, variant string, m bigint, d int, n bigint, k int, trials int, reps int, trial_query_ms array<double>"


def time_ms(df: DataFrame, warmup: int = 1, reps: int = 3) -> float:
    """Mean milliseconds of a full run into the noop sink after warm-up runs."""
    run = lambda: df.write.format("noop").mode("overwrite").save()
    for _ in range(warmup):
        run()
    t = time.perf_counter()
    for _ in range(reps):
        run()
    return (time.perf_counter() - t) * 1000 / reps


def _plan_columns(variant: str, Q: DataFrame, X: DataFrame, df: DataFrame, m: int, n: int, tile_size: int | None) -> dict:
    """How a row's plan was chosen: strategy, queries screened at a time, tiles, and what the plan consists of."""
    per_step = screened(n, int(variant[1:]) if variant[1:].isdigit() else None)
    row = {"strategy": "arrow" if variant == "heap" or variant[1:].isdigit() else chosen(Q, X), "block": per_step, "plan_attrs": attributes(df)}
    if variant == "tiled":
        row |= {"tile_size": tile_size or TILE, "n_tiles": -(-m // (tile_size or TILE))}
    return row


def measures(spark: SparkSession, rows: list[dict]) -> list[dict]:
    """Raw rows (variant, m, d, n, k, trials, reps, trial_query_ms) with means, deviations and throughput, in order."""
    raw = spark.createDataFrame([(i, *(r[c.split()[0]] for c in RAW.split(", ")[1:])) for i, r in enumerate(rows)], RAW)
    trials = raw.select("number", "n", F.explode("trial_query_ms").alias("query_ms"))
    stats = report.qps_error(report.mean_std(trials, ["number", "n"])).withColumn("query_ms", F.col("mean_query_ms"))
    by_number = {r["number"]: r.asDict() for r in report.throughput(stats).drop("trials", "n").collect()}
    return [r | {k: v for k, v in by_number[i].items() if k != "number"} for i, r in enumerate(rows)]


def sweep(
    X: DataFrame,
    Q: DataFrame,
    variants: list[str],
    ks: list[int],
    ns: list[int],
    trials: int = 1,
    reps: int = 3,
    warmup: int = 1,
    skip_failures: bool = False,
    measure_recall: bool = False,
    tile_size: int | None = None,
    distribution: str = "gaussian",
    **options,
) -> tuple[list[dict], list[dict]]:
    """Report rows and failures for every (variant, n, k): mean and population deviation over trials.

    tile_size goes to the tiled variant; the others choose their own.
    """
    m, results, failures = X.count(), [], []
    d = len(Q.first()["q_vec"])
    for v in variants:
        own = options | ({"tile_size": tile_size} if v == "tiled" and tile_size else {})
        for n in ns:
            for k in ks:
                prefix = query_prefix(Q, n)
                try:
                    with scratch():
                        df = run_variant(v, prefix, X, k, **own)
                        ms = [time_ms(df, warmup, reps) for _ in range(trials)]
                        row = {"variant": v, "distribution": distribution, "m": m, "d": d, "n": n, "k": k, "trials": trials, "reps": reps, "trial_query_ms": ms}
                        row |= _plan_columns(v, prefix, X, df, m, n, tile_size)
                        if measure_recall:
                            row["recall"] = recall(df, run_variant("baseline", prefix, X, k)).agg({"recall": "avg"}).first()[0]
                except Exception as e:
                    if not skip_failures:
                        raise
                    failures.append({"variant": v, "n": n, "k": k, "error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"})
                    continue
                results.append(row)
    return measures(X.sparkSession, results) if results else [], failures


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser()
    p.add_argument("--variants", default="baseline")
    p.add_argument("--m", type=int, default=20_000)
    p.add_argument("--d", type=int, default=8)
    p.add_argument("--k", type=whole_numbers, default=[10])
    p.add_argument("--n", type=whole_numbers, default=[1000])
    p.add_argument("--trials", type=int, default=1)
    p.add_argument("--reps", type=int, default=3)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--mode", default="gaussian", choices=["gaussian", "clustered"])
    p.add_argument("--cluster-size", type=int, default=16)
    p.add_argument("--cluster-noise", type=float, default=0.05)
    p.add_argument("--tile-size", type=int)
    p.add_argument("--recall", action="store_true")
    p.add_argument("--skip-failures", action="store_true")
    p.add_argument("--out")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark, names = SparkSession.builder.getOrCreate(), parse_variants(a.variants, list(VARIANTS))
    X = gaussian(spark, a.m, a.d, a.seed)
    Q = queries(spark, max(a.n), a.d, a.seed + 1, a.mode, a.cluster_size, a.cluster_noise)
    results, failures = sweep(X, Q, names, a.k, a.n, a.trials, a.reps, skip_failures=a.skip_failures, measure_recall=a.recall, tile_size=a.tile_size, distribution=a.mode)
    for r in results:
        print(f"{r['variant']:>10} n={r['n']} k={r['k']} {r['query_ms']:.1f} ms {r['queries_per_second']:.0f} q/s")
    if a.out:
        meta = {"m": a.m, "d": a.d, "seed": a.seed, "trials": a.trials, "reps": a.reps, "skip_failures": a.skip_failures, "query_mode": a.mode}
        meta |= {"cluster_size": a.cluster_size, "cluster_noise": a.cluster_noise, "tile_size": a.tile_size, "n_values": a.n, "k_values": a.k, "variants": names}
        write_report(a.out, meta, results, failures)


if __name__ == "__main__":
    main()
