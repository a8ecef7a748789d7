"""SimHash fingerprints and near-duplicate components by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import golay
from vicinal.llm.common import FILE, ROW, Batches, byte_rows, identified, join_table, map_batches, utf8
from vicinal.llm.components import connected_components
from vicinal.runtime import materialise, scratch

#: Words of a shingle, and fingerprint bits that a link may differ in. Golay keys hold for up to 2.
SHINGLE, DISTANCE = 3, 2
#: Bytes of one text that are split at a time.
PIECE = 4 << 20
#: Fingerprints of a bucket whose pairs are compared; larger buckets go through one-bit variants, which is exact too.
PAIRS_UP_TO = 16
#: First bit and length of the three segments of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = b" \t\n\r\x0b\x0c"
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
PLACES = (np.arange(8) * 256).astype(np.int64)


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """Lists of words whose shingles together are those of the text; pieces overlap by SHINGLE - 1 words."""
    data, at, carried = data.translate(LOWER), 0, []
    while True:
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] not in SPACES:
            end += 1
        words = carried + data[at:end].split()
        if end >= len(data) or len(words) >= SHINGLE:
            yield words
            carried = words[len(words) - SHINGLE + 1 :]
        else:
            carried = words
        if end >= len(data):
            return
        at = end


def fingerprint(data: bytes) -> int:
    """64-bit fingerprint of a UTF-8 text: bit i is 1 if set in over half of the shingles' hashes."""
    counts, total = np.zeros((8, 256), np.int64), 0
    for part, words in enumerate(_word_lists(data)):
        if len(words) >= SHINGLE:
            shingles = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
        else:
            shingles = [b" ".join(words)] if words and not part else []
        if shingles:
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
            at = h.view(np.uint8).reshape(-1, 8) + PLACES
            counts += np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
            total += len(shingles)
    set_bits = (counts @ BYTE_BITS).ravel() * 2 > total
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and also some long columns. Null and wordless texts have fingerprint zero."""
    names = ("doc_id", *also)
    schema = pa.schema([(n, pa.int64()) for n in (*names, "fp")])

    def scan(batches: Batches) -> Batches:
        for b in batches:
            fps = np.array([fingerprint(t) for t in byte_rows(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fps)], schema=schema)

    own = docs.select(*(F.col(n).cast("bigint").alias(n) for n in names), utf8("text").alias("text"))
    return map_batches(own, scan, ", ".join(f"{n} bigint" for n in (*names, "fp")))


def bucket_keys(fps: DataFrame) -> DataFrame:
    """key, fp: each segment in turn must agree exactly, and the next one in a Golay key.

    Two fingerprints within 2 bits agree on some whole segment, and differ by at most 2 bits on the next:
    so they share a key.
    """
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def scan(batches: Batches) -> Batches:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
            for s, exact in enumerate(parts):
                row, fuzzy = golay.keys(parts[(s + 1) % len(parts)])
                key = (np.int64(s) << 60) | (exact[row] << 12) | fuzzy
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], schema=schema)

    return map_batches(fps.select("fp"), scan, "key bigint, fp bigint", rows=10_000)


def links(fps: DataFrame) -> DataFrame:
    """a, b: edges that connect all distinct fingerprints within DISTANCE bits of one another.

    Small buckets yield their verified pairs. In a larger bucket pairs are not formed: each member goes
    under itself and its 64 one-bit variants; whoever meets under a variant is within 2 bits (a group of
    at most 65), every pair within 2 bits meets under one, and a star joins each group.
    """
    keys = materialise(bucket_keys(fps), "golay")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialise(keys.join(sizes, "key"), "buckets")
    arr = F.col("members")
    pairs = F.flatten(
        F.transform(
            arr,
            lambda x: F.transform(
                F.filter(arr, lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= DISTANCE)),
                lambda y: F.struct(x.alias("a"), y.alias("b")),
            ),
        )
    )
    few = shared.where(F.col("size") <= PAIRS_UP_TO).groupBy("key").agg(F.collect_set("fp").alias("members")).select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    many = shared.where(F.col("size") > PAIRS_UP_TO).select("fp").distinct()
    flips = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    met = many.select("fp", F.explode(flips).alias("variant")).groupBy("variant").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return few.unionByName(stars).distinct()


def _roots(distinct: DataFrame) -> DataFrame:
    """node, root: the least linked fingerprint of every fingerprint that has a link; written out."""
    with scratch():
        return materialise(connected_components(links(distinct)), "roots", outlive=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links).

    Repeated rows and equal texts share a fingerprint. A null doc_id belongs to its component but never
    names it; a component of null ids alone has a null component_id. No rows give no rows. A fingerprint may
    be that of a third of all rows: they are counted before any shuffle and named by a broadcast look-up.
    """
    with scratch():
        fps = materialise(fingerprints(docs), "fingerprints", outlive=True)
        distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
        roots = _roots(distinct).withColumnRenamed("node", "fp")
        rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = rooted.join(roots.select("fp"), "fp", "left_semi").groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
        nodes = distinct.agg(F.count("*"), F.sum("n")).first()
        linked = join_table(roots.join(distinct.select("fp", F.col("n").alias("rows")), "fp"), materialise(named, "named"), "root", "n", nodes[0]).select("fp", "component_id", F.col("rows").alias("n"))
        alone = distinct.join(roots, "fp", "left_anti").select("fp", F.col("least_id").alias("component_id"), "n")
        lookup = materialise(linked.unionByName(alone), "lookup", outlive=True)
    rows = join_table(fps, lookup, "fp", "n", nodes[1] or 0)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents with one row of each component left: that of the least doc_id (null last), then of the least text hash.

    Rows are told apart by where they lie, so null and repeated ids are deduplicated like any others, and
    different texts of one id stay unless their fingerprints link. Only keys of rows are grouped, and texts
    are shuffled once, by distinct keys.
    """
    rows = identified(docs)
    with scratch():
        light = rows.withColumn("__vicinal_hash", F.xxhash64("text"))
        fps = materialise(fingerprints(light, FILE, ROW, "__vicinal_hash"), "fingerprints")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__vicinal_hash", FILE, ROW)).alias("first")
        distinct = materialise(fps.groupBy("fp").agg(first), "distinct")
        rooted = distinct.join(_roots(distinct), F.col("fp") == F.col("node"), "left")
        kept = materialise(rooted.groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first")).select(f"first.{FILE}", f"first.{ROW}"), "kept", outlive=True)
    # by a shuffle at every size: what is kept grows with the documents
    return rows.join(kept.hint("merge"), [FILE, ROW], "left_semi").select(*docs.columns)
