import random

import numpy as np
import xxhash

from tests.compare import SF
from vicinal.llm import golay, simhash
from vicinal.llm.catalog import QUERIES
from vicinal.llm.components import connected_components

DOCS = "doc_id bigint, text string"


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_components(fps):
    """doc_id -> least reachable doc_id, comparing every pair."""
    ids, f = zip(*sorted(fps), strict=True)
    f, root = np.array(f, np.uint64), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 2) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_golay_keys_meet_within_two_bits():
    rng = random.Random(1)
    words = [rng.getrandbits(23) for _ in range(3000)]
    near = [w ^ sum(1 << i for i in rng.sample(range(23), rng.randint(0, 2))) for w in words]
    sets = []
    for side in (words, near):
        row, key = golay.keys(np.array(side, np.int64))
        own = [set() for _ in side]
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            own[r].add(k)
        sets.append(own)
    assert all(a & b for a, b in zip(*sets, strict=True))
    assert {len(s) for s in sets[0]} == {1, 6}


def test_fingerprint(monkeypatch):
    texts = ["", "  \n", "One", "One two", "A b C d", "é À b\tc\x0bd\x0ce", "x " * 500, "a b c d", "no\x1cbreak here now"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t), t
    long = " ".join(random.Random(2).choice("aa bb cc dd ee".split()) for _ in range(900))
    for piece in (1, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", piece)
        for t in [*texts, long]:
            assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op10_simhash_dedup"](spark, SF).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(text)
    fps = {r.doc_id: slow_fingerprint(text[r.doc_id]) for r in got}
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" for r in got)
    assert {r.doc_id: r.component_id for r in got} == slow_components(fps.items())


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 400:  # a crowded neighbourhood and some strangers
        fps.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) if rng.random() < 0.8 else rng.getrandbits(64))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    want = slow_components(list(enumerate(fps)))
    for limit in (1, 3, 16):
        monkeypatch.setattr(simhash, "PAIRS_UP_TO", limit)
        root = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
        groups = {}
        for i, f in signed:
            groups.setdefault(root.get(f, f), set()).add(i)
        assert {min(g): g for g in groups.values()} == {r: {i for i in want if want[i] == r} for r in set(want.values())}


def test_edges(spark):
    rows = [(1, "same text here now"), (2, "same text here now"), (2, "same text here now"), (3, None), (4, ""), (None, "same text here now"), (9, "other words in this one")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (9, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    wide = spark.createDataFrame([(i or 0, t, 1, 2, 3) for i, t in rows], DOCS + ", fingerprint int, component_id int, key int")
    assert simhash.near_duplicates(wide).columns == ["doc_id", "fingerprint", "component_id"]
    kept = simhash.keep_one(wide.where("doc_id > 0"))
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 9]
    nulls = [(None, "same text here now"), (None, "same text here now"), (None, None), (None, ""), (5, "other words in this one"), (5, "a third text stands here"), (5, "other words in this one")]
    kept = simhash.keep_one(spark.createDataFrame(nulls, DOCS)).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept) == [(0, ""), (0, "same "), (5, "a thi"), (5, "other")]
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_fingerprint_is_not_shuffled(spark):
    """A text on half of all rows: the rows are named by broadcast, and no task of a join reads them all."""
    rows = [(i if i % 4 else None, "one and the same text here" if i % 2 else f"text number {i} of {i * i} others") for i in range(20_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(16)
    got = {r.fingerprint: r for r in simhash.near_duplicates(docs).groupBy("fingerprint").agg({"component_id": "max", "*": "count"}).collect()}
    assert max(r["count(1)"] for r in got.values()) >= 10_000 and sum(r["count(1)"] for r in got.values()) == 20_000
    assert got[f"{simhash.fingerprint(b'one and the same text here'):016x}"]["max(component_id)"] == 1
    assert simhash.keep_one(docs).where("text = 'one and the same text here'").count() == 1


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
