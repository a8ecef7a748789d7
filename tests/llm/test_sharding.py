import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from vicinal.llm import sharding as S
from vicinal.llm.catalog import QUERIES


def test_flow_equals_brute_force():
    rng = random.Random(1)
    for _ in range(25):
        supply, cost = [rng.randint(0, 4) for _ in range(2)], [[rng.randint(0, 5) for _ in range(3)] for _ in range(2)]
        demand = [rng.randint(0, 4) for _ in range(3)]
        if sum(supply) > sum(demand):
            with pytest.raises(ValueError):
                S.min_cost_flow(supply, demand, cost)
            continue
        flow = S.min_cost_flow(supply, demand, cost)
        splits = [[x for x in itertools.product(range(s + 1), repeat=3) if sum(x) == s] for s in supply]
        least = min(sum(f * c for row, cs in zip(x, cost, strict=True) for f, c in zip(row, cs, strict=True)) for x in itertools.product(*splits) if all(sum(col) <= d for col, d in zip(zip(*x, strict=True), demand, strict=True)))
        assert sum(f * cost[i][j] for (i, j), f in flow.items()) == least
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(2)] == supply


def test_transfers_move_only_the_excess():
    blocks = {(s, b): 100 for s in range(4) for b in range(10 + 4 * (s == 0))}
    plan = S.plan_transfers(blocks, S.even(4400, 4))
    assert plan.sizes == [1100] * 4 and plan.moved == 300 and plan.affected == {0, 1, 2, 3}
    assert S.plan_transfers({(0, 0): 5, (1, 0): 5}, [5, 5]).moved == 0
    assert S.plan_transfers({}, S.even(0, 3)).sizes == [0, 0, 0]
    grown = S.plan_transfers({(s, b): 10 for s in range(2) for b in range(9)}, S.even(180, 3))
    assert grown.sizes == [60, 60, 60] and grown.moved == 60


def test_transfers_are_near_the_least():
    """Against every assignment of a few blocks: of those as even as the plan's, none moves fewer bytes by more than a block."""
    rng = random.Random(3)
    for _ in range(30):
        blocks = {(rng.randrange(3), b): rng.randint(1, 30) for b in range(7)}
        plan = S.plan_transfers(blocks, S.even(sum(blocks.values()), 3))
        assert plan.moved <= plan.least + 3 * max(blocks.values())
        spread, least = max(plan.sizes) - min(plan.sizes), None
        for homes in itertools.product(range(3), repeat=len(blocks)):
            sizes = [0] * 3
            for (_, b), j in zip(blocks.items(), homes, strict=True):
                sizes[j] += b
            if max(sizes) - min(sizes) <= spread:
                moved = sum(b for (k, b), j in zip(blocks.items(), homes, strict=True) if k[0] != j)
                least = moved if least is None else min(least, moved)
        assert plan.moved <= least + max(blocks.values())


def test_transfers_leave_few_parts():
    blocks = {(s, b): 10 for s in range(4) for b in range(320 + 64 * (s == 0))}
    plan = S.plan_transfers(blocks, S.even(sum(blocks.values()), 4), part=lambda b: b % 16)
    assert plan.sizes == [3360] * 4 and plan.moved == plan.least == 480 and len(plan.parts) <= 2


def test_whole_table(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    sizes, slots = Counter(), {}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.doc_id, r.shard, r.slot) for r in QUERIES["op3_sharding"](spark, SF).collect()} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_edges(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (3, ""), (4, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id bigint, text string, slot int, size int")
    got = S.assign(docs, 3).collect()
    assert len(got) == 5 and sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s, n in Counter(r.shard for r in got).items() for k in range(n))
    assert S.assign(docs.limit(0), 3).count() == 0
    assert S.with_shard(docs, 3).columns == [*docs.columns, "shard"] and S.with_shard(docs, 3).count() == 5


@pytest.mark.parametrize("id_of", [lambda i: 7, lambda i: None, lambda i: i % 2 or None])
def test_repeated_and_null_ids_are_shared_out(spark, id_of):
    """Half the rows alike in id and text, half of that id with texts of their own: shards stay near equal, slots gapless."""
    rows = [(id_of(i), "same text" if i % 2 else f"text {i}", i) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = S.assign(docs).collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    share = sum(sizes.values()) / 24
    assert len(got) == len(rows) and len(sizes) == 24 and max(abs(s - share) for s in sizes.values()) <= 0.02 * share
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed = S.with_shard(docs)
    by = {r.shard: r["size"] for r in placed.groupBy("shard").agg(F.sum(S.document_size()).alias("size")).collect()}
    assert placed.columns == ["doc_id", "text", "shard"] and len(by) == 24 and max(abs(s - share) for s in by.values()) <= 0.02 * share


def test_only_affected_files_are_rewritten(spark):
    """Bytes written anew are near those that move, and all other files stay."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    files, sizes, parts = S.lay_out(docs, 4, 256)
    plan = S.plan_transfers({k: b for k, (b, _) in sizes.items()}, S.even(sum(b for b, _ in sizes.values()), 4), part=S._part(parts))
    rows = S.rewrite(files, plan, S._homes(spark, plan, {k: n for k, (_, n) in sizes.items()}))
    now = {f.rsplit("/", 1)[1] for f in rows.inputFiles()}
    before = {f.rsplit("/", 1)[1] for f in files.inputFiles()}
    assert plan.moved and before <= now and rows.count() == 30_000
    anew = sum(b for (a, blk), (b, _) in sizes.items() if (a, blk % parts) in plan.parts)
    assert anew <= plan.moved + len(plan.parts) * 2 * sum(b for b, _ in sizes.values()) / 4 / parts and anew < 0.2 * sum(b for b, _ in sizes.values())
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == list(range(30_000))
