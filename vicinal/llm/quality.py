"""Quality scores: gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import boosting
from vicinal.llm.common import Batches, byte_rows, held_out, map_batches, unit_hash, utf8
from vicinal.runtime import materialise, share

#: Labelled documents that a model is fitted on, at most (expected number; chosen by a hash of the id).
FIT_DOCS = 20_000
GOOD_FROM = 0.3

FEATURES = (
    "log_bytes log_words bytes_per_word distinct_words distinct_pairs repeated_word upper_words lines bytes_per_line distinct_lines "
    "ended_lines upper lower digit blank high period comma exclamation question bar symbol bracket other largest_byte"
).split()


def _classes() -> dict[str, np.ndarray]:
    groups = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": b" \t\n\r\x0b\x0c", "high": range(128, 256), "period": b".", "comma": b",", "exclamation": b"!", "question": b"?", "bar": b"|", "symbol": b"*%&$#@^~+=<>_", "bracket": b"()[]{}\"'"}
    known = {b for g in groups.values() for b in g}
    groups["other"] = [b for b in range(256) if b not in known]
    return {k: np.isin(np.arange(256), list(v)).astype(float) for k, v in groups.items()}


CLASSES = np.stack([_classes()[k] for k in FEATURES[11:-1]], 1)


def statistics(data: bytes) -> list[float]:
    """The FEATURES of a whole text; all shares are 0 for the empty text."""
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    w, k = len(words), len(lines)
    shares = (counts @ CLASSES / max(1, n)).tolist()
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        n / max(1, w),
        len(set(words)) / max(1, w),
        len(set(zip(words, words[1:], strict=False))) / max(1, w - 1),
        sum(map(eq, words, words[1:])) / max(1, w - 1),
        sum(map(bytes.isupper, words)) / max(1, w),
        k / max(1, w),
        n / k,
        len(set(lines)) / k,
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / k,
        *shares,
        float(counts.max()) / max(1, n),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, f array<float>: the statistics of every whole text, null as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.list_(pa.float32()))])

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t) for t in byte_rows(b, "text")], pa.list_(pa.float32()))], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text")), scan, "doc_id bigint, f array<float>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(stats: DataFrame, labels: DataFrame) -> boosting.Forest:
    """Trees from the labelled documents that aren't held out: all of them, or a hash sample of about FIT_DOCS.

    Documents and labels are joined without texts. Labels other than 0 and 1 are left out, and so are ids
    whose labels contradict each other; an id on several rows gives one, so the driver gets at most about
    FIT_DOCS rows. Without labels of both kinds every score is the smoothed share of label 1.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    rate = FIT_DOCS / max(1, known.count())
    chosen = known.where(unit_hash("doc_id") < rate)
    # at most about FIT_DOCS ids: their rows are looked up where they lie, and one is kept before any shuffle
    rows = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("f").alias("f"), F.min("y").alias("y")).toArrow()
    x, y, ids = _matrix(rows["f"]), rows["y"].to_numpy().astype(float), rows["doc_id"].to_numpy()
    order = np.lexsort((*x.T[::-1], y, ids)) if len(ids) else np.zeros(0, int)  # the same trees whatever the order of the rows
    return boosting.fit(x[order], y[order])


def score(stats: DataFrame, forest: boosting.Forest) -> DataFrame:
    """doc_id, score: probability that the label is 1."""
    sent = share(stats.sparkSession, forest)

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.score(_matrix(b.column("f"))))], names=["doc_id", "score"])

    return map_batches(stats, scan, "doc_id bigint, score double", rows=5000)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Only the text enters a score. Rows are independent, so repeated rows and clashing extra columns don't
    matter; a null doc_id is held out; no rows give no rows.
    """
    stats = materialise(measured(docs), "statistics")
    scored = score(stats, fit(stats, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
