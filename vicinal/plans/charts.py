"""Charts from report files.

    python -m vicinal.plans.charts ksweep a.json b.json --out k.svg
    python -m vicinal.plans.charts variants old.json new.json --out v.svg
    python -m vicinal.plans.charts compare base.json tiled.json --n 16000 --out c.svg
    python -m vicinal.plans.charts study s.json --n-target 16000 --panel-ks 4,8,32 --out k.svg --out-vs-n n.svg
    python -m vicinal.plans.charts repeat r.json --out r.svg
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.text import variant_rank, whole_numbers
from vicinal.operators import report
from vicinal.sources.reports import read_meta, read_results
from vicinal.sources.svg import Series, write_chart, write_figure


def _series(rows: DataFrame, name: str, x: str, y: str, error: str | None = None) -> Series:
    """Chart points: a report has a few hundred rows, so they are collected."""
    out: Series = {}
    for r in rows.select(name, x, y, *([error] if error else [])).collect():
        out.setdefault(str(r[0]), []).append((float(r[1]), float(r[2]), float(r[3]) if error and r[3] is not None else None))
    return out


def k_sweep(results: DataFrame, least: float = 0.9) -> Series:
    """Queries per second over n, a line for each k. Rows need that recall; the first file wins for each (k, n)."""
    rows = report.recall_filter(results, least)
    if rows.isEmpty():
        raise ValueError(f"no row with a recall of at least {least}")
    return _series(report.dedup(rows, ["k", "n"]).withColumn("line", F.concat(F.lit("k = "), "k")).orderBy("k", "n"), "line", "n", "queries_per_second")


def variants(results: DataFrame) -> Series:
    """Mean queries per second with its error over n, a line for each variant; the last file wins for each (variant, n)."""
    rows = report.dedup(results, ["variant", "n"], last=True)
    return _series(rows.orderBy(*variant_rank("variant"), "n"), "variant", "n", "mean_queries_per_second", "std_queries_per_second")


def panels(results: DataFrame, ks: list[int]) -> dict[str, Series]:
    """For each chosen k a panel: queries per second over n by variant."""
    rows = report.panels(results, ks)
    return {f"k = {k}": _series(report.series(rows, "n", k=k).orderBy(*variant_rank("variant"), "n"), "variant", "n", "queries_per_second") for k in ks}


def over_k(results: DataFrame, n: int) -> Series:
    """Queries per second over k at one n, a line for each variant."""
    return _series(results.where(F.col("n") == n).orderBy(*variant_rank("variant"), "k"), "variant", "k", "queries_per_second")


def repeated(results: DataFrame) -> Series:
    """Mean queries per second with its error over k, a line for each variant."""
    return _series(results.orderBy(*variant_rank("variant"), "k"), "variant", "k", "mean_queries_per_second", "std_queries_per_second")


def compare(base: DataFrame, tiled: DataFrame, n: int) -> Series:
    """Untiled against tiled queries per second over k at one n; a side that lacks a k has no point there."""
    rows = report.compare(*(df.withColumn("ms", F.col("queries_per_second")) for df in (base, tiled))).where(F.col("n") == n).orderBy("k").collect()
    return {name: [(float(r["k"]), float(r[c]), None) for r in rows if r[c] is not None] for name, c in (("baseline", "base_ms"), ("tiled", "tiled_ms"))}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("kind", choices=["ksweep", "variants", "compare", "study", "repeat"])
    p.add_argument("files", nargs="+")
    p.add_argument("--n", "--n-target", type=int, default=16_000)
    p.add_argument("--panel-ks", type=whole_numbers, default=[4, 8, 32])
    p.add_argument("--recall", type=float, default=0.9)
    p.add_argument("--out", required=True)
    p.add_argument("--out-vs-n")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    meta = read_meta(spark, a.files[:1]).first().asDict()
    about = ", ".join(f"{c} = {meta[c]}" for c in ("m", "d", "trials") if meta.get(c) is not None)
    qps = "queries per second"
    if a.kind == "compare":
        write_chart(a.out, compare(*(read_results(spark, [f]) for f in a.files[:2]), a.n), f"tiled and untiled, n = {a.n}, {about}", "k", qps, log_x=True)
    elif a.kind == "ksweep":
        write_chart(a.out, k_sweep(read_results(spark, a.files), a.recall), f"k sweep, {about}", "queries", qps, log_x=True)
    elif a.kind == "variants":
        write_chart(a.out, variants(read_results(spark, a.files)), f"variants, {about}", "queries", qps, log_x=True)
    elif a.kind == "repeat":
        write_chart(a.out, repeated(read_results(spark, a.files)), f"variants over k, {about}", "k", qps, log_x=True)
    else:
        rows = read_results(spark, a.files)
        write_chart(a.out, over_k(rows, a.n), f"variants over k, n = {a.n}, {about}", "k", qps, log_x=True)
        if a.out_vs_n:
            write_figure(a.out_vs_n, panels(rows, a.panel_ks), "queries", qps, log_x=True)


if __name__ == "__main__":
    main()
