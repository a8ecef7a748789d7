"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vicinal.runtime import ensure_importable, materialise

#: Columns that tell every row apart: a hash of its file's path, and its place in that file.
FILE, ROW = "__vicinal_file", "__vicinal_row"
#: A key that holds more than this share of the rows is hot; there are at most as many hot keys as shares.
SHARES, FEW = 4096, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and bytes (a row that is larger comes alone).

    So what a scan holds is bounded by its own parameters, and the session's settings stay as they are.
    """
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = b.slice(at, part.num_rows // 2)
            yield part
            at += part.num_rows


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows kept from every fit: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def unit_hash(*columns: str) -> Column:
    """A repeatable number in [0, 1) for each row, from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit("unit"), *columns), F.lit(1 << 30)) / float(1 << 30)


def map_batches(df: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """mapInArrow over bounded pieces, whose workers give memory back when a task ends: Spark keeps them for the stages that follow."""
    ensure_importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(pieces(batches, rows, size))
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(run, schema)


def _is_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def identified(docs: DataFrame) -> DataFrame:
    """docs with FILE and ROW, by which its rows can be named and found again however many are alike.

    They come with a scan of Parquet files for nothing. Any other frame is written to the shared folder first.
    """

    def named(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.withColumns({FILE: F.xxhash64(meta["file_path"]), ROW: meta["row_index"]})

    if _is_scan(docs):
        try:
            return named(docs)
        except AnalysisException:  # a scan of files that aren't Parquet
            pass
    return named(materialise(docs, "rows"))


def numbered(light: DataFrame, key: str) -> DataFrame:
    """light, which has FILE and ROW, with nth: the number from 0 of each row among those of equal key (not null).

    No task holds a key's rows: windows span a key's rows of one file, and the files of a key.
    """
    files = Window.partitionBy(key).orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    counts = light.groupBy(key, FILE).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(files), F.lit(0))).drop("n")
    own = light.withColumn("nth", F.row_number().over(Window.partitionBy(key, FILE).orderBy(ROW)) - 1)
    return own.join(counts, [key, FILE]).withColumn("nth", F.col("nth") + F.col("before")).drop("before")


def join_table(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of a table that has one row for each key, also where one key holds a third of the rows.

    `count` is the table's column of a key's rows, `total` their sum. Hot keys, at most SHARES, are broadcast
    and their rows stay where they are; the others meet by a shuffle.
    """
    is_hot = (F.col(count) > FEW) & (F.col(count) * SHARES > total)
    hot, cold = F.broadcast(table.where(is_hot).drop(count)), table.where(~is_hot).drop(count)
    few = rows.join(hot, key)
    return few.unionByName(rows.join(hot, key, "left_anti").join(cold.hint("merge"), key).select(*few.columns))


def utf8(column: str = "text") -> Column:
    """Text as UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def byte_rows(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return batch.column(column).to_pylist()


def record_batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


Batches = Iterator[pa.RecordBatch]
