"""Benchmark reports as JSON documents {meta, results, failures}."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.report import union_results


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result rows of the reports in order, with src (file number) and pos (place within the file)."""
    one = lambda i, p: spark.read.json(p, multiLine=True).select(F.posexplode("results").alias("pos", "r")).select(F.lit(i).alias("src"), "pos", "r.*")
    return union_results(*(one(i, p) for i, p in enumerate(paths)))


def read_meta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The metadata of the first report."""
    return spark.read.json(paths[0], multiLine=True).select("meta.*")


def read_failures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Failure rows of the reports in order, with src; a report without any gives none."""
    shape = "failures array<struct<variant:string,n:bigint,k:bigint,error:string>>"
    one = lambda i, p: spark.read.schema(shape).json(p, multiLine=True).select(F.lit(i).alias("src"), F.inline("failures"))
    return union_results(*(one(i, p) for i, p in enumerate(paths)))


def dumps(meta: dict, results: list[dict], failures: list[dict] | None = None) -> str:
    """One ASCII document, indented by 2."""
    return json.dumps({"meta": meta, "results": results} | ({"failures": failures} if failures is not None else {}), indent=2)


def write_report(path: str, meta: dict, results: list[dict], failures: list[dict] | None = None) -> None:
    """Writes the report of a sweep: a few rows, on the driver."""
    with open(path, "w", encoding="ascii") as f:
        f.write(dumps(meta, results, failures))


def store_report(spark: SparkSession, path: str, meta: dict, results: list[dict], failures: list[dict] | None = None) -> None:
    """The same document in a folder of any store that Spark writes to."""
    store_text(spark, path, dumps(meta, results, failures))


def store_text(spark: SparkSession, path: str, text: str) -> None:
    """One small document as the only file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path, lineSep="\n")
