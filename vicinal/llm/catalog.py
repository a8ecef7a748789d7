"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import avi, decontaminate, extract, langid, licenses, mixing, pipeline, quality, sharding, simhash, warc
from vicinal.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, with_spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_avi": op1_avi,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_licenses": op6_licenses,
    "op7_html": op7_html,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_simhash_dedup": op10_simhash_dedup,
    "pipeline": pipeline.run,
}

#: What the archives must give back, from the pages alone.
WARC_SQL = f"""select page_id, octet_length(encode(html)) payload_bytes, sha1(html) payload_digest,
 case when page_id < response then 'revisit' else 'response' end record_type, case when page_id < response then response end refers_to
 from (select page_id, html, case when octet_length(encode(html)) >= {warc.REVISIT_FROM} then max(page_id) over (partition by html) end response
 from (select page_id, coalesce(html, '') html from pages))"""

ORACLE: dict[str, str] = {
    "op5_warc": WARC_SQL,
    "op6_licenses": licenses.scan_sql(),
}
