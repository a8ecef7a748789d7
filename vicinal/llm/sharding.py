"""Resharding as a minimum-cost flow: from old shard sizes and new capacities to block transfers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import FILE, ROW, identified, utf8
from vicinal.runtime import materialise, scratch

#: Shards of the query, and blocks of each old shard: the driver holds one row for each block and no more.
SHARDS, BLOCKS = 24, 1024
#: A block of more than this part of a shard's share is cut by row.
CUT = 64
#: Files of each shard at least, and bytes of one file at most, where documents are laid out.
PARTS, FILE_BYTES = 16, 128 << 20
OLD, BLOCK, BASE, SIZE = "__vicinal_old", "__vicinal_block", "__vicinal_base", "__vicinal_size"
Key = tuple[int, int]  # old shard, block


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Bytes to send from each source to each sink: all supply, no sink over its demand, least total cost.

    Successive shortest paths over the residual network (Bellman-Ford, since residual arcs cost less than
    nothing). Supply must not exceed demand.
    """
    n, m = len(supply), len(demand)
    if sum(supply) > sum(demand):
        raise ValueError("more supply than demand")
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    while any(left):
        dist = [0 if x else None for x in left] + [None] * m
        via: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + cost[i][j] < dist[n + j]):
                        dist[n + j], via[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow.get((i, j)) and dist[n + j] is not None and (dist[i] is None or dist[n + j] - cost[i][j] < dist[i]):
                        dist[i], via[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j] and dist[n + j] is not None), key=lambda j: (dist[n + j], j))
        path, v = [], n + end
        while via[v] is not None:
            path.append((via[v], v))
            v = via[v]
        push = min([left[v], room[end], *(flow[b, a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a, b - n] += push
            else:
                flow[b, a - n] -= push
        left[v] -= push
        room[end] -= push
    return {k: f for k, f in flow.items() if f}


@dataclass
class Plan:
    """Where every block goes."""

    home: dict[Key, int]  # (old shard, block) -> shard
    sizes: list[int]  # bytes of each new shard
    moved: int  # bytes that change shard
    least: int  # bytes that the flow moves: no plan that keeps to the capacities moves fewer
    affected: set[int]  # shards whose files change
    parts: set[Key]  # (old shard, part) that some block leaves


def plan_transfers(blocks: dict[Key, int], capacities: list[int], cost: list[list[int]] | None = None, part: Callable[[int], int] = lambda block: block) -> Plan:
    """Assigns blocks (old shard, number) -> bytes to shards of the given byte capacities, moving the fewest bytes.

    The flow says how many bytes leave which shard for which (staying is free, moving costs 1 a byte
    unless cost says otherwise). Blocks then fill each transfer without passing it: out of as few parts (files)
    of the old shard as will do, the largest first. Blocks are whole, so that shards still miss their
    capacities by up to a block; last, as long as moving one block from the fullest shard to the emptiest
    narrows their gap, it moves, of a part already touched if one fits as well.
    """
    old = sorted({s for s, _ in blocks})
    n = len(capacities)
    cost = cost or [[int(a != b) for b in range(n)] for a in old]
    supply = [sum(b for (s, _), b in blocks.items() if s == a) for a in old]
    flow = min_cost_flow(supply, capacities, cost)
    home: dict[Key, int] = {}
    touched: set[Key] = set()
    own = {a: sorted((k for k in blocks if k[0] == a), key=lambda k: (part(k[1]), -blocks[k], k)) for a in old}
    for i, a in enumerate(old):
        stays = a if a < n else None
        for (f, j), amount in sorted(flow.items()):
            if f != i or j == stays:
                continue
            for k in own[a]:
                if k not in home and blocks[k] <= amount:
                    home[k] = j
                    touched.add((a, part(k[1])))
                    amount -= blocks[k]
        rest = stays if stays is not None else max(range(n), key=lambda j: (flow.get((i, j), 0), -j))
        for k in own[a]:
            home.setdefault(k, rest)
    sizes, held = [0] * n, defaultdict(list)
    for k, j in home.items():
        sizes[j] += blocks[k]
        held[j].append(k)
    over = [s - c for s, c in zip(sizes, capacities, strict=True)]
    while n > 1:
        full, empty = max(range(n), key=lambda j: (over[j], -j)), min(range(n), key=lambda j: (over[j], j))
        gap = over[full] - over[empty]
        fits = [k for k in held[full] if 0 < blocks[k] < gap]
        if not fits:
            break
        # within an eighth of the gap, one that has moved already, or whose part has been touched, does as well
        k = min(fits, key=lambda k: (abs(2 * blocks[k] - gap) * 8 // gap, k[0] == full and (k[0], part(k[1])) not in touched, abs(2 * blocks[k] - gap), k))
        held[full].remove(k)
        held[empty].append(k)
        home[k] = empty
        touched.add((k[0], part(k[1])))
        for j, d in ((full, -blocks[k]), (empty, blocks[k])):
            sizes[j] += d
            over[j] += d
    movers = [(k, j) for k, j in home.items() if k[0] != j]
    least = sum(f for (i, j), f in flow.items() if old[i] != j)
    return Plan(home, sizes, sum(blocks[k] for k, _ in movers), least, {k[0] for k, _ in movers} | {j for _, j in movers}, {(k[0], part(k[1])) for k, _ in movers})


def even(total: int, shards: int) -> list[int]:
    """Capacities that are equal to within one byte."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def document_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def hashed_shard(shards: int = SHARDS, doc_id: str = "doc_id") -> Column:
    """The layout before: shard by a hash of the id. A null id counts as a value of its own."""
    return F.pmod(F.xxhash64(F.lit("shard"), F.col(doc_id)), F.lit(shards)).cast("int")


def hashed_block(blocks: int = BLOCKS) -> Column:
    """By id and text, so that the rows of one id spread over many blocks."""
    return F.pmod(F.xxhash64(F.lit("block"), "doc_id", "text"), F.lit(blocks)).cast("int")


def _sizes(placed: DataFrame) -> dict[Key, tuple[int, int]]:
    """(bytes, rows) of every block; partial sums are made before the shuffle, so a hot block is a few rows."""
    rows = placed.groupBy(OLD, BLOCK).agg(F.sum(SIZE).alias("bytes"), F.count("*").alias("rows")).collect()
    return {(r[OLD], r[BLOCK]): (int(r["bytes"]), int(r["rows"])) for r in rows}


def _placed(docs: DataFrame, shards: int, old: Column, blocks: int) -> tuple[DataFrame, dict[Key, tuple[int, int]]]:
    """docs with OLD, BLOCK and SIZE, and the blocks' (bytes, rows).

    A block above a CUT-th of a shard's share (rows that are alike in id and text, which no hash of them can
    part) is cut into numbered blocks from `blocks` on, by where each row lies. There are at most shards x CUT
    such blocks, of twice as many parts.
    """
    plain = docs.withColumns({OLD: old, BLOCK: hashed_block(blocks), SIZE: document_size()})
    sizes = _sizes(plain.select(OLD, BLOCK, SIZE))
    limit = max(1, sum(b for b, _ in sizes.values()) // (shards * CUT))
    cut = {k: -(-b // limit) for k, (b, n) in sizes.items() if b > limit and n > 1}
    if not cut:
        return plain, sizes
    table = docs.sparkSession.createDataFrame([(*k, n) for k, n in cut.items()], f"{OLD} int, {BLOCK} int, __vicinal_n int")
    rows = identified(docs).withColumns({OLD: old, BLOCK: hashed_block(blocks), SIZE: document_size()}).join(F.broadcast(table), [OLD, BLOCK], "left")
    nth = F.pmod(F.xxhash64(F.lit("cut"), FILE, ROW), F.col("__vicinal_n"))
    own = F.when(F.col("__vicinal_n").isNull(), F.col(BLOCK)).otherwise((F.col(BLOCK) + (1 + nth) * blocks).cast("int"))
    placed = rows.withColumn(BLOCK, own).select(*docs.columns, OLD, BLOCK, SIZE)
    hot = _sizes(placed.where(F.col(BLOCK) >= blocks).select(OLD, BLOCK, SIZE))
    return placed, {k: v for k, v in sizes.items() if k not in cut} | hot


def _homes(spark, plan: Plan, rows: dict[Key, int]) -> DataFrame:
    """The table of blocks: shard, and BASE, the block's first slot in it. At most (old shards x blocks) and the cut ones' rows."""
    base, table = defaultdict(int), []
    for k in sorted(plan.home):
        j = plan.home[k]
        table.append((*k, j, base[j]))
        base[j] += rows[k]
    return F.broadcast(spark.createDataFrame(table, f"{OLD} int, {BLOCK} int, shard int, {BASE} bigint"))


def reshard(docs: DataFrame, shards: int = SHARDS, old: Column | None = None, blocks: int = BLOCKS, capacities: list[int] | None = None) -> tuple[DataFrame, Plan]:
    """docs with shard (a scan and a broadcast join, no shuffle of texts), and the plan.

    old gives each row's present shard (default: by hash of the id), capacities the bytes each new shard
    shall hold (default: equal). Only block sizes reach the driver. No rows give no rows. Null and repeated
    ids are shared out like others, by text and by row.
    """
    placed, sizes = _placed(docs, shards, hashed_shard(shards) if old is None else old, blocks)
    plan = plan_transfers({k: b for k, (b, _) in sizes.items()}, capacities or even(sum(b for b, _ in sizes.values()), shards))
    homes = _homes(docs.sparkSession, plan, {k: n for k, (_, n) in sizes.items()})
    return placed.join(homes, [OLD, BLOCK]).select(*docs.columns, "shard"), plan


def with_shard(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """docs, all columns, with their shard (in place of a column of that name)."""
    return reshard(docs.drop("shard"), shards, **options)[0]


def _part(parts: int) -> Callable[[int], int]:
    return lambda block: block % parts


def _spread(df: DataFrame, key: list[str], pieces: int) -> DataFrame:
    """df shuffled by key and one of some pieces, so that a key of many bytes is written by several tasks."""
    piece = F.pmod(F.xxhash64(F.lit("piece"), BLOCK, "doc_id", "text"), F.lit(pieces))
    return df.withColumn("__vicinal_piece", piece).repartition(*key, "__vicinal_piece").drop("__vicinal_piece")


def lay_out(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> tuple[DataFrame, dict[Key, tuple[int, int]], int]:
    """Writes docs to files by OLD shard and `part` of it: the files, the blocks' (bytes, rows), and parts a shard.

    Every file holds whole blocks or pieces of one part, and about FILE_BYTES at most.
    """
    placed, sizes = _placed(docs, shards, hashed_shard(shards), blocks)
    total = sum(b for b, _ in sizes.values())
    parts = min(blocks, max(PARTS, -(-total // (shards * FILE_BYTES))))
    pieces = -(-total // (shards * parts * FILE_BYTES))
    rows = placed.drop(SIZE).withColumn("part", F.pmod(F.col(BLOCK), F.lit(parts)).cast("int"))
    return materialise(_spread(rows, [OLD, "part"], max(1, pieces)), "shards", outlive=True, by=(OLD, "part")), sizes, parts


def rewrite(files: DataFrame, plan: Plan, homes: DataFrame) -> DataFrame:
    """The documents in their new shards, from files by (OLD, part): shard and BASE beside OLD and BLOCK.

    Only parts that some block leaves are read and written anew, block by block to its home shard; all other
    files stay as they are and belong to the same shard as before.
    """
    touched = defaultdict(list)
    for a, p in sorted(plan.parts):
        touched[a].append(p)
    if not touched:
        return files.join(homes, [OLD, BLOCK])
    affected = F.lit(False)
    for a, ps in touched.items():
        affected = affected | ((F.col(OLD) == a) & F.col("part").isin(ps))
    moved = files.where(affected).join(homes, [OLD, BLOCK]).repartition("shard", OLD, "part")
    moved = materialise(moved, "moved", outlive=True, by=("shard",))
    return files.where(~affected).join(homes, [OLD, BLOCK]).select(*moved.columns).unionByName(moved)


def assign(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every document, law `bytes`.

    The documents are laid out in files of the old shards (a hash of the id), the affected files are
    rewritten, and the answer is read from the files that then make up the new shards. Slots count up block
    by block, so a window spans one block, not one shard. Repeated rows get slots of their own; rows of one
    id, or of null ids, are shared out by text and by row.
    """
    with scratch():
        files, sizes, parts = lay_out(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shards, blocks)
        plan = plan_transfers({k: b for k, (b, _) in sizes.items()}, even(sum(b for b, _ in sizes.values()), shards), part=_part(parts))
        rows = rewrite(files, plan, _homes(docs.sparkSession, plan, {k: n for k, (_, n) in sizes.items()}))
    light = rows.select("doc_id", OLD, BLOCK, BASE, document_size().alias("size"), F.crc32(utf8()).alias("text_crc32"), "shard")
    nth = F.row_number().over(Window.partitionBy(OLD, BLOCK).orderBy("doc_id", "size", "text_crc32"))
    return light.withColumn("slot", F.col(BASE) + nth - 1).drop(OLD, BLOCK, BASE)
