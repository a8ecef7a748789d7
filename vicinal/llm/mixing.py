"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import FILE, ROW, identified, numbered
from vicinal.runtime import ensure_importable, materialise, release

#: Weights of the sources in code-point order, repeating; the mix's share of all words; most times a source is taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Units of one flight block, and units left for the landing problem of a source.
BLOCK, LANDING = 1000, 16
WORD = r"[^\x20\x09-\x0D]+"
UNITS = f"unit bigint, {FILE} bigint, {ROW} bigint, doc_id bigint, source_no int, size bigint, base int, p double"
EPS = 1e-9
#: Sources up to which their table (under 100 bytes each) is broadcast; beyond, Spark chooses the join.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[float], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source: share of all words by weight, at most `most` times each source's words.

    What is above goes to the other sources by weight, until none is above. Where every source is at its
    most, the mix stays below its share.
    """
    left, out = share * sum(sizes), [0.0] * len(sizes)
    weight = sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))  # in this order sources reach their most
    for at, i in enumerate(order):
        if left * weights[i] / weight < most * sizes[i]:
            for j in order[at:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = most * sizes[i]
        left, weight = left - out[i], weight - weights[i]
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, keep: int) -> np.ndarray:
    """Moves fractional inclusion probabilities until at most `keep` are left, in expectation unchanged.

    Three open units have a direction in which neither the expected number nor the expected size changes;
    a random step along it, as long as all stay within 0 and 1, settles one unit or more. Two units of
    equal size move against each other.
    """
    p, open_ = p.astype(float).tolist(), [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    for i, x in enumerate(p):
        if x <= EPS or x >= 1 - EPS:
            p[i] = float(round(x))
    s, draws = size.astype(float).tolist(), iter(rng.random(2 * len(p) + 8).tolist())
    window, rest = open_[:3], open_[3:]
    rest.reverse()
    while len(window) + len(rest) > keep:
        if len(window) == 3:
            i, j, k = window
            u = (s[k] - s[j], s[i] - s[k], s[j] - s[i])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(window) == 2 and s[window[0]] == s[window[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = down = float("inf")
        for i, d in zip(window, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for i, d in zip(window, u, strict=True):
            x = p[i] + step * d
            if x <= EPS or x >= 1 - EPS:
                p[i] = float(round(x))
            else:
                p[i] = x
                left.append(i)
        window = left + [rest.pop() for _ in range(min(len(rest), 3 - len(left)))]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the few open units: of all roundings that whose size, then number, is nearest to what they expect."""
    at = [i for i, x in enumerate(p) if 0 < x < 1]
    if not at:
        return p
    choice = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))[::-1] & 1).astype(float)
    off = np.abs((choice - p[at]) @ size[at].astype(float))
    number = np.abs((choice - p[at]).sum(1))
    best = np.lexsort((number, np.round(off, 6)))[0]
    out = p.copy()
    out[at] = choice[best]
    return out


def _flyer(level: int, last: set[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Flight of one block, and the landing too where it is its source's last."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "doc_id", "size"], kind="stable").reset_index(drop=True)
        k, block = int(pdf["source_no"].iloc[0]), int(pdf["block"].iloc[0])
        rng = np.random.default_rng(zlib.crc32(f"{k}/{block}/{level}".encode()))
        p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy()
        p = flight(p, size, rng, LANDING if k in last else 0)
        pdf["p"] = land(p, size) if k in last else p
        return pdf.drop(columns="block")

    return fly


def _with_source(df: DataFrame, table: DataFrame, sources: int, on: str | Column) -> DataFrame:
    return df.join(F.broadcast(table) if sources <= BROADCAST_SOURCES else table, on)


def sample(units: DataFrame, rows: dict[int, int]) -> DataFrame:
    """Settles every unit's p to 0 or 1. rows: number of units of each source.

    Flights run in blocks of about BLOCK units of one source; each leaves at most two open. Those are
    dealt anew and fly again, so every level is some hundred times smaller, until a source has one block
    and lands. What a task holds is one block, however large the source.
    """
    if not rows:
        return units
    ensure_importable(units.sparkSession)
    done, level, pend = None, 0, units
    while True:
        blocks = {k: max(1, -(-n // BLOCK)) for k, n in rows.items()}
        last = {k for k, b in blocks.items() if b == 1}
        sizes = units.sparkSession.createDataFrame(list(blocks.items()), "source_no int, n_blocks int")
        dealt = _with_source(pend, sizes, len(blocks), "source_no").withColumn("block", F.pmod(F.xxhash64(F.lit(level), "unit"), F.col("n_blocks"))).drop("n_blocks")
        flown = materialise(dealt.select(*units.columns, "block").groupBy("source_no", "block").applyInPandas(_flyer(level, last), UNITS), "flight")
        settled = flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        pend = flown.where("p > 0 and p < 1")
        rows = {r["source_no"]: r["count"] for r in pend.groupBy("source_no").count().collect()}
        if not rows:
            return done
        level += 1


def units_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """FILE, ROW, doc_id, source, size and unit of identified rows.

    The unit is a hash of all columns and of the row's number among rows alike in all of them: so draws
    depend on what the rows hold alone, and rows that are alike may stand for each other.
    """
    key = F.xxhash64(*columns).alias("key")
    light = rows.select(FILE, ROW, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), key)
    light = materialise(light, "light")
    out = materialise(numbered(light, "key").withColumn("unit", F.xxhash64("key", "nth")).drop("key", "nth"), "units")
    release(light)
    return out


def _hashable(docs: DataFrame) -> list[str]:
    """The columns by which rows are alike or not: all but maps, which Spark can't hash."""
    return [f.name for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def _settled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """FILE, ROW, doc_id, size, source_size, target, copies of identified rows."""
    light = units_of(rows, columns)
    stats = light.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    stats = sorted(stats, key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([r["words"] for r in stats], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(stats))])
    known = []
    for i, (r, t) in enumerate(zip(stats, want, strict=True)):
        ratio = t / r["words"] if r["words"] else 0.0
        base = int(ratio + EPS)
        known.append((r["source"], i, int(r["words"]), float(t), base, min(1.0, max(0.0, ratio - base))))
    sources = light.sparkSession.createDataFrame(known, "source string, source_no int, source_size bigint, target double, base int, p double")
    joined = _with_source(light, sources, len(known), light["source"].eqNullSafe(sources["source"]))
    settled = sample(joined.select(*(c.split()[0] for c in UNITS.split(", "))), {i: r["rows"] for i, r in enumerate(stats)})
    if known:
        release(light)
    out = _with_source(settled, sources.select("source_no", "source_size", "target"), len(known), "source_no")
    return out.withColumn("copies", F.col("base") + F.col("p").cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document.

    size counts words (null text: 0), target is the number of words the mix takes from the source. Each
    document is taken floor(target / source_size) times, and once more by a balanced sample with the
    remainder as probability, so that no source misses its target by more than a landing error. A null
    source is a source of its own, ordered last. Repeated rows are units of their own; empty texts take
    part in the count but add no words. No rows give no rows. The draws depend on the rows alone. What the
    driver holds is one row for each source.
    """
    settled = _settled(identified(docs), _hashable(docs))
    return settled.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame) -> DataFrame:
    """Documents as the mix takes them: each as many times as it has copies, with all columns.

    Rows meet their copies by where they lie, so one id, or null ids, on a third of all rows make no hot
    key; texts are shuffled once.
    """
    rows = identified(docs)
    copies = materialise(_settled(rows, _hashable(docs)).where("copies > 0").select(FILE, ROW, F.col("copies").alias("__vicinal_copies")), "copies")
    # by a shuffle at every size: the copies grow with the documents
    taken = rows.join(copies.hint("merge"), [FILE, ROW]).withColumn("__vicinal_copy", F.explode(F.sequence(F.lit(1), F.col("__vicinal_copies"))))
    return taken.select(*docs.columns)
