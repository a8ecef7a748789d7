"""Extension: a stream of queries against a static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from vicinal.operators.knn import knn


def knn_stream(queries: DataFrame, X: DataFrame, k: int, path: str, **options) -> DataStreamWriter:
    """Writer that appends each micro-batch's neighbours to Parquet at path; the batch id keeps replays apart.

    A batch that is retried overwrites its own folder, so an executor or driver loss leaves no doubles.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        knn(batch, X, k, **options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return queries.writeStream.foreachBatch(each)
