"""Exact k-nearest-neighbour search as a Spark plan.

One semantics, several physical strategies: for each query the k corpus rows of smallest squared
float32 distance, ordered by (dist, x_id). Infinite distances rank after finite ones, NaN distances
are left out, a query equal to a corpus row matches it at 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions.distance import checked_vector, l2sq
from vicinal.functions.kernel import Running
from vicinal.runtime import ensure_importable, input_bytes, share

#: Most bytes of query vectors that are shipped to every executor; more queries meet the corpus on a grid.
QUERY_BLOCK_BYTES = 32 << 20
#: Bytes of corpus vectors in one cell of that grid.
CELL_BYTES = 64 << 20
#: Pairs from which the Arrow kernel pays for starting Python workers.
ARROW_FROM_PAIRS = 100_000
#: float64 cells of one screening matrix, corpus rows screened at a time, and list entries that a task holds.
CELLS, ROWS_AT_ONCE, HELD = 1 << 21, 8192, 1 << 23
#: A file scan makes no split smaller than this, so a smaller corpus has fewer partitions than there are cores.
LEAST_SPLIT = 4 << 20
PARTIAL = "q_id bigint, tile bigint, x_id bigint, dist float"


def _row_bytes(d: int) -> int:
    return d * 4 + 16


def query_block(d: int, k: int = 1) -> int:
    """Queries that one task holds: as many as their vectors and their lists of k have room for."""
    return max(1, min(QUERY_BLOCK_BYTES // _row_bytes(d), HELD // k))


def corpus_blocks(m: int, d: int) -> int:
    """Blocks of the corpus on a grid, each of about CELL_BYTES."""
    return max(1, -(-m * _row_bytes(d) // CELL_BYTES))


def screened(n: int, query_batch: int | None = None) -> int:
    """Queries of which one screening matrix is made."""
    return min(query_batch or n, max(1, CELLS // ROWS_AT_ONCE))


def _measure(Q: DataFrame) -> tuple[int, int]:
    """Number of queries and their dimension, in one aggregate."""
    row = Q.agg(F.count("*"), F.max(F.array_size("q_vec"))).first()
    return row[0], row[1] or 0


def _ranked(cands: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Top k rows of each key by (dist, x_id); Spark puts a group limit below the shuffle for k up to its threshold."""
    w = Window.partitionBy(*keys).orderBy("dist", "x_id")
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _spread(X: DataFrame) -> DataFrame:
    """X over all cores where it is too small for the scan to be: few rows times all queries are much work."""
    cores = X.sparkSession.sparkContext.defaultParallelism
    return X.repartition(cores, "x_id") if input_bytes(X) < LEAST_SPLIT * cores else X


def _vectors(Q: DataFrame, X: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    return Q.select("q_id", checked_vector("q_vec", d).alias("q_vec")), _spread(X.select("x_id", "x_vec")).select("x_id", checked_vector("x_vec", d).alias("x_vec"))


def _hashed(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("grid"), column), F.lit(parts)).cast("int")


def _on_grid(q: DataFrame, x: DataFrame, q_blocks: int, x_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (qb, xb) where they meet: a query goes to each corpus block, a corpus row to each query block."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return q.withColumn("qb", _hashed("q_id", q_blocks)).withColumn("xb", every(x_blocks)), x.withColumn("xb", _hashed("x_id", x_blocks)).withColumn("qb", every(q_blocks))


def pairwise(Q: DataFrame, X: DataFrame) -> DataFrame:
    """Every (query, corpus row) pair with its distance: the search before its top-k.

    The queries are the stated, size-checked side; beyond QUERY_BLOCK_BYTES both sides meet on a grid of
    cells by equality, so that a task holds one cell's queries and nothing is broadcast.
    """
    n, d = _measure(Q)
    q, x = _vectors(Q, X, d)
    if n <= query_block(d):
        pairs = x.crossJoin(F.broadcast(q))
    else:
        left, right = _on_grid(q, x, -(-n // query_block(d)), corpus_blocks(X.count(), d))
        pairs = left.join(right, ["qb", "xb"])
    return pairs.select("q_id", "x_id", l2sq("q_vec", "x_vec", d).alias("dist"))


def _sql(Q: DataFrame, X: DataFrame, k: int, tile_size: int | None) -> DataFrame:
    cands = pairwise(Q, X)
    if tile_size:
        cands = _ranked(cands.withColumn("tile", F.floor(F.col("x_id") / tile_size)), ["q_id", "tile"], k).drop("rank", "tile")
    # NaN ranks last, so it may be dropped afterwards; a filter on dist before would compute each distance twice
    return _ranked(cands, ["q_id"], k).where(~F.isnan("dist"))


def _matrix(batch: pa.RecordBatch | pa.Table, column: str, d: int) -> np.ndarray:
    vec = batch[column]
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    return np.asarray(vec.flatten()).astype(np.float32, copy=False).reshape(batch.num_rows, d)


def _long(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    return np.asarray(batch[column].to_numpy() if isinstance(batch, pa.Table) else batch[column].to_numpy(zero_copy_only=False), np.int64)


def _search(batches: Iterable[pa.RecordBatch], q_ids: np.ndarray, q: np.ndarray, k: int, tile_size: int | None, query_batch: int | None) -> Iterator[pa.RecordBatch]:
    """Partial lists of all the batches together: k rows a query and tile, given out once, at the end.

    What is held is bounded by HELD list entries; a task that meets more tiles than that gives lists out early.
    """
    best: dict[int, Running] = {}
    step = screened(len(q), query_batch)

    def lists() -> Iterator[pa.RecordBatch]:
        for tile, r in best.items():
            qi, ids, dist = r.lists
            for a in range(0, len(qi), 1 << 16):
                own = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi[own]]), pa.array(np.full(len(qi[own]), tile, np.int64)), pa.array(ids[own]), pa.array(dist[own], pa.float32())], names=["q_id", "tile", "x_id", "dist"])
        best.clear()

    for batch in batches:
        for a in range(0, batch.num_rows if len(q) else 0, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            ids, vecs = _long(part, "x_id"), _matrix(part, "x_vec", q.shape[1])
            tiles = ids // tile_size if tile_size else np.zeros(len(ids), np.int64)
            for tile in np.unique(tiles).tolist():
                own = tiles == tile
                if tile not in best:
                    if len(best) * len(q) * k > HELD:
                        yield from lists()
                    best[tile] = Running(q, k, step)
                best[tile].add(ids[own], vecs[own])
    yield from lists()


def partials(Q: DataFrame, X: DataFrame, k: int, tile_size: int | None = None, query_batch: int | None = None) -> DataFrame:
    """Top k of each query within each task's share of the corpus (and tile): q_id, tile, x_id, dist.

    Queries of up to QUERY_BLOCK_BYTES (and HELD list entries) are shipped to the executors, and the corpus
    is scanned once where it lies. More queries than that never pass the driver: blocks of queries and of
    corpus rows are shuffled to the cells of a grid, each held by one task.
    """
    spark = X.sparkSession
    ensure_importable(spark)
    n, d = _measure(Q)
    if not n:
        return spark.createDataFrame([], PARTIAL)
    q, x = _vectors(Q, X, d)
    per_block = query_block(d, k)
    if n <= per_block:
        table = q.toArrow()  # at most QUERY_BLOCK_BYTES
        sent = share(spark, (_long(table, "q_id"), _matrix(table, "q_vec", d)))
        return x.mapInArrow(lambda batches: _search(batches, *sent.value, k, tile_size, query_batch), PARTIAL)
    left, right = _on_grid(q, x, -(-n // per_block), corpus_blocks(X.count(), d))

    def cell(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = list(_search(rows.to_batches(), _long(queries, "q_id"), _matrix(queries, "q_vec", d), k, tile_size, query_batch))
        return pa.Table.from_batches(found, pa.schema([("q_id", pa.int64()), ("tile", pa.int64()), ("x_id", pa.int64()), ("dist", pa.float32())]))

    return left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInArrow(cell, PARTIAL)


def merge_partials(parts: DataFrame, k: int) -> DataFrame:
    """Second phase: the k best of each query's partial lists; q_id, rank, x_id, dist."""
    return _ranked(parts.where(F.col("x_id").isNotNull() & ~F.isnan("dist")), ["q_id"], k).select("q_id", "rank", "x_id", "dist")


def chosen(Q: DataFrame, X: DataFrame, query_batch: int | None = None) -> str:
    """The strategy that auto takes: sql below ARROW_FROM_PAIRS pairs. Row counts come from file footers."""
    return "arrow" if query_batch or Q.count() * X.count() > ARROW_FROM_PAIRS else "sql"


def knn(
    Q: DataFrame,
    X: DataFrame,
    k: int,
    strategy: str = "auto",
    tile_size: int | None = None,
    query_batch: int | None = None,
    pad: bool = False,
    exclude_self: bool = False,
) -> DataFrame:
    """The k nearest rows of X for each row of Q.

    Q has q_id bigint and q_vec array<float>, X has x_id bigint and x_vec array<float>; other columns
    are ignored. Returns q_id, rank (1..k), x_id, dist. With k above the corpus size there are fewer
    rows, or with pad=True k rows whose surplus has x_id -1 and a null dist. A ragged or null vector is
    an error. Empty Q or X gives no rows (pad: only padding). strategy: sql, arrow, or auto by pairs.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if (tile_size is not None and tile_size < 1) or (query_batch is not None and query_batch < 1):
        raise ValueError("tile_size and query_batch must be at least 1")
    Q, X = Q.select("q_id", "q_vec"), X.select("x_id", "x_vec")
    if strategy == "auto":
        strategy = chosen(Q, X, query_batch)
    if strategy not in ("sql", "arrow"):
        raise ValueError(f"unknown strategy {strategy!r}")
    more = k + 1 if exclude_self else k
    out = merge_partials(partials(Q, X, more, tile_size, query_batch), more) if strategy == "arrow" else _sql(Q, X, more, tile_size).select("q_id", "rank", "x_id", "dist")
    if exclude_self:
        out = _ranked(out.where(F.col("q_id") != F.col("x_id")).drop("rank"), ["q_id"], k).select("q_id", "rank", "x_id", "dist")
    if pad:
        slots = Q.select("q_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
        out = slots.join(out, ["q_id", "rank"], "left").select("q_id", "rank", F.coalesce("x_id", F.lit(-1).cast("bigint")).alias("x_id"), "dist")
    return out


def knn_wide(Q: DataFrame, X: DataFrame, k: int, **options) -> DataFrame:
    """One row per query: q_id, ids array<bigint>, dists array<float>, nearest first."""
    rows = knn(Q, X, k, **options).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x_id", "dist"))).alias("r"))
    return rows.select("q_id", F.col("r.x_id").alias("ids"), F.col("r.dist").alias("dists"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Measured recall per query: share of the exact ids that were found. Extension: q_id, recall."""
    hit = exact.select("q_id", "x_id").join(found.select("q_id", "x_id").distinct().withColumn("hit", F.lit(1)), ["q_id", "x_id"], "left")
    return hit.groupBy("q_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
