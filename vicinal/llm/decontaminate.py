"""Benchmark decontamination: word pairs that a leak must share find candidates, Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import Batches, map_batches
from vicinal.runtime import share

MATCH, MISMATCH, GAP = 2, 1, 1
#: Share of the score of a verbatim copy from which a document leaks an item.
LEAK = 0.5
#: Zeros behind each text, so that no pair of words spans two texts.
PAD = 3
#: Bytes of item text in one broadcast block; more items mean more passes over the documents.
BLOCK_BYTES = 4 << 20
#: Cells of one batch of alignments.
CELLS = 1 << 20
#: Postings of seeds that are looked through at a time.
POSTINGS = 1 << 21
#: Characters hashed at a time.
CHARS = 1 << 18
WORD = re.compile(r"\w+")
#: Powers of an odd base modulo 2^64.
POWERS = np.cumprod(np.full(1024, 0xD6E8FEB86659FD93, np.uint64))
LEAKS = "doc_id bigint, item_id bigint, score bigint, similarity double, end_word bigint"


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall((text or "").lower())


@cache
def _word_characters() -> np.ndarray:
    """For each code point whether it belongs to words: the same characters as in WORD."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of words(), and the number of its text: a polynomial in an odd base, then mixed."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(_word_characters()[codes])
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    h = np.add.reduceat(codes[at] * POWERS[place & (len(POWERS) - 1)], first)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29)), np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), at[first], side="right")


@dataclass
class Items:
    """A block of test items with their seeds."""

    ids: list
    vocab: dict[str, int]
    tokens: list[np.ndarray]
    codes: np.ndarray  # sorted distinct seed codes
    first: np.ndarray  # per code: its first posting
    item: np.ndarray  # postings by code: item number
    place: np.ndarray  # and position of the seed in the item
    need: np.ndarray  # per item: seeds that a document must hit to leak it

    def __post_init__(self):
        """Word numbers by sorted 64-bit word hash, behind a sieve on the hash's first 16 bits."""
        h, _ = word_hashes([" ".join(self.vocab)])
        order = np.argsort(h)
        self.hashes, self.numbers = h[order], np.array(list(self.vocab.values()), np.int64)[order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[h >> np.uint64(48)] = True
        self.length = np.array([len(t) for t in self.tokens], np.int64)

    def code(self, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
        """Code of a pair of known words, or of one word."""
        return a * (len(self.vocab) + 1) + b

    def hits(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, code number) of every seed in a token sequence: words, and pairs with at most one word between."""
        where, which = [], []
        at = np.flatnonzero(t)
        for apart in (0, 1, 2):
            if apart:
                own = at[: np.searchsorted(at, len(t) - apart)]
                own = own[t[own + apart] > 0]
                code = self.code(t[own], t[own + apart])
            else:
                own = at[self.alone[t[at]]]
                code = self.code(t[own])
            ok = np.flatnonzero(self.seeds[_slot(code)])
            own, code = own[ok], code[ok]
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            ok = self.codes[k] == code
            where.append(own[ok])
            which.append(k[ok])
        return np.concatenate(where), np.concatenate(which)


def _slot(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(44)


def needed(length: int) -> int:
    """Seeds that every alignment worth a leak holds: pairs of neighbours of the item, matched with at most one word between.

    Of an item of n words let x be replaced or left out within the alignment, o lie outside it, and u foreign words
    be put in. Its score, 2 (n - x - o) - x - u, is at least n, so 3 x + 2 o + u <= n. Of the n - x - o - 1 steps from
    one matched word to the next at most x + u / 2 are no such pairs; n - 1 - (2 x + o + u / 2) >= n / 3 - 1 are.
    Of three words two match, and their seeds are single words. Items of one or two words must occur with all of them.
    """
    return 2 if length == 3 else max(1, -(-length // 3) - 1)


def make_items(ids: list, texts: list[str | None]) -> Items:
    split = [words(t) for t in texts]
    vocab: dict[str, int] = {}
    tokens = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in s], np.int64) for s in split]
    none = np.zeros(0, np.int64)
    need = np.array([needed(len(t)) for t in tokens], np.int64)
    it = Items(ids, vocab, tokens, none, none, none, none, need)
    code, item, place = [none], [none], [none]
    for i, t in enumerate(tokens):
        own = it.code(t) if len(t) in (1, 3) else it.code(t[:-1], t[1:])
        code.append(own)
        item.append(np.full(len(own), i))
        place.append(np.arange(len(own)))
    _index(it, np.concatenate(code), np.concatenate(item), np.concatenate(place))
    return it


def _index(it: Items, code: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
    """Postings of all items. Each item does without the half of its needed seeds that most items share, and needs as many less."""
    _, nth, n = np.unique(code, return_inverse=True, return_counts=True)
    order = np.lexsort((place, -n[nth], item))
    size = np.bincount(item, minlength=len(it.ids))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    order = order[rank >= (it.need // 2)[item[order]]]
    it.need = it.need - it.need // 2
    code, item, place = code[order], item[order], place[order]
    order = np.lexsort((place, item, code))
    it.codes, start = np.unique(code[order], return_index=True)
    it.first = np.append(start, len(code))
    it.item, it.place = item[order], place[order]
    it.seeds = np.zeros(1 << 20, bool)
    it.seeds[_slot(it.codes)] = True
    base = len(it.vocab) + 1
    it.alone = np.zeros(base, bool)
    it.alone[it.codes[it.codes % base == 0] // base] = True


def _encode(texts: list[str | None], it: Items) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts (0: no word of an item), each text followed by PAD zeros, and where each text starts."""
    parts, starts, at, a = [], [], 0, 0
    while a < len(texts):
        b, chars = a, 0
        while b < len(texts) and (b == a or chars + len(texts[b] or "") <= CHARS):
            chars += len(texts[b] or "")
            b += 1
        h, doc = word_hashes(texts[a:b])
        own = np.bincount(doc, minlength=b - a)
        start = np.cumsum(own + PAD) - own - PAD
        t = np.zeros(int(own.sum()) + PAD * (b - a), np.int64)
        k = np.flatnonzero(it.sieve[h >> np.uint64(48)])
        place = np.minimum(np.searchsorted(it.hashes, h[k]), len(it.hashes) - 1)
        same = it.hashes[place] == h[k]
        k, place = k[same], place[same]
        t[k + PAD * doc[k]] = it.numbers[place]
        parts.append(t)
        starts.append(start + at)
        at, a = at + len(t), b
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *parts]), np.concatenate([none, *starts])


def align(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row pair, and the window column after its last matched word.

    Linear gaps make the move along a row a running maximum, so a whole item word is a few array
    operations over all pairs. Padding must match nothing.
    """
    n, w = windows.shape
    slope = GAP * np.arange(w + 1, dtype=np.int32)
    h, best, end = np.zeros((n, w + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        step = np.where(windows == items[:, i : i + 1], MATCH, -MISMATCH).astype(np.int32)
        new = np.maximum(h - GAP, 0)
        new[:, 1:] = np.maximum(new[:, 1:], h[:, :-1] + step)
        h = np.maximum(np.maximum.accumulate(new + slope, axis=1) - slope, 0)
        top = h.argmax(1)
        score = h[np.arange(n), top]
        better = score > best
        best, end = np.where(better, score, best), np.where(better, top, end)
    return best, end


def _windows(it: Items, t: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, first, stop) token windows that hold every alignment worth a leak, for some items at a time.

    Windows of one item don't depend on other items. So where common seeds have very many postings, the
    items are halved until a share has at most POSTINGS of them (or is one item).
    """
    where, code = it.hits(t)
    width = len(it.ids)
    by_item = np.repeat(np.arange(len(it.codes)), np.diff(it.first)) * width + it.item if len(it.codes) else np.zeros(0, np.int64)
    shares = [(0, width)]
    while shares and len(where):
        a, b = shares.pop()
        first = np.searchsorted(by_item, code * width + a)
        n = np.searchsorted(by_item, code * width + b) - first
        if n.sum() > POSTINGS and b - a > 1:
            shares += [((a + b) // 2, b), (a, (a + b) // 2)]
        elif n.any():
            yield _near(it, t, start, where, first, n)


def _near(it: Items, t: np.ndarray, start: np.ndarray, where: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows from n postings, beginning at first, of the seed at each position where."""
    row = np.repeat(np.arange(len(where)), n)
    post = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    pos, item, place = where[row], it.item[post], it.place[post]
    doc = np.searchsorted(start, pos, side="right") - 1
    length = it.length
    # an alignment worth a leak spans at most two item lengths of text: only where enough seeds stand that near is one
    order = np.lexsort((pos, item, doc))
    doc, item, pos, place = doc[order], item[order], pos[order], place[order]
    last = np.arange(len(doc)) + it.need[item] - 1
    ok = last < len(doc)
    last = np.minimum(last, len(doc) - 1)
    ok = np.flatnonzero(ok & (doc[last] == doc) & (item[last] == item) & (pos[last] - pos <= 2 * length[item]))
    doc, item, pos, place = doc[ok], item[ok], pos[ok], place[ok]
    # and it puts in at most as many words as the item has, before or after a seed
    lo, hi = pos - place - length[item], pos + 2 * length[item] - place + 1
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    if not len(doc):
        return (doc, item, lo, hi)
    group = np.cumsum(np.append(False, (np.diff(doc) != 0) | (np.diff(item) != 0))) * (hi.max() - lo.min() + 1)  # groups lie apart
    reach = np.maximum.accumulate(hi + group)
    new = np.append(True, lo[1:] + group[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    a, b = np.minimum.reduceat(lo, begin), np.maximum.reduceat(hi, begin)
    doc, item = doc[begin], item[begin]
    a, b = np.maximum(a, start[doc]), np.minimum(b, np.append(start[1:], len(t))[doc])
    # long stretches become windows of 8 item lengths that overlap by 4, more than any alignment spans
    stride = 4 * np.maximum(length[item], 1)
    pieces = np.maximum(1, -(-(b - a - stride) // stride))
    row = np.repeat(np.arange(len(doc)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a2 = a[row] + nth * stride[row]
    return doc[row], item[row], a2, np.minimum(a2 + 2 * stride[row], b[row])


def find(it: Items, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(text number, item number, score, end word) of the best alignment of every candidate pair: of every leak, and others."""
    t, start = _encode(texts, it)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for windows in _windows(it, t, start):
        _align_all(it, t, start, windows, best)
    return [(d, i, s, e) for (d, i), (s, e) in sorted(best.items())]


def _align_all(it: Items, t: np.ndarray, start: np.ndarray, windows: tuple[np.ndarray, ...], best: dict[tuple[int, int], tuple[int, int]]) -> None:
    """Aligns every window with its item, CELLS at a time, and keeps the best of each (text, item)."""
    doc, item, a, b = windows
    length = it.length
    order = np.lexsort((b - a, length[item])) if len(doc) else []
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * max(b[order[stop]] - a[order[stop]], b[order[at]] - a[order[at]]) <= CELLS:
            stop += 1
        own = order[at:stop]
        w, k = int((b - a)[own].max()), int(length[item[own]].max())
        col = a[own][:, None] + np.arange(w)
        win = np.where(col < b[own][:, None], t[np.minimum(col, len(t) - 1)], 0)
        win[win == 0] = -1
        its = np.full((len(own), k), -2, np.int64)
        for r, i in enumerate(item[own]):
            its[r, : length[i]] = it.tokens[i]
        score, end = align(win, its)
        for d, i, s, e in zip(doc[own].tolist(), item[own].tolist(), score.tolist(), (a[own] + end - start[doc[own]]).tolist(), strict=True):
            if (d, i) not in best or (s, -e) > (best[d, i][0], -best[d, i][1]):
                best[d, i] = (s, e)
        at = stop


def _leaking(it: Items, texts: list[str | None]) -> list[tuple[int, int, int, float, int]]:
    found, a = [], 0
    while a < len(texts):
        b, chars = a + 1, len(texts[a] or "")
        while b < len(texts) and chars + len(texts[b] or "") <= CHARS:
            chars += len(texts[b] or "")
            b += 1
        found += [(a + d, *rest) for d, *rest in find(it, texts[a:b])]
        a = b
    return [(d, i, s, s / (MATCH * len(it.tokens[i])), e) for d, i, s, e in found if s >= LEAK * MATCH * len(it.tokens[i])]


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """Items in blocks of bounded size, each with its seeds."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-(size[0] + 16 * size[1]) // BLOCK_BYTES))
    for k in range(n):
        own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
        own = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(own.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        it = make_items([r[0] for r in rows], [r[1] for r in rows])
        if len(it.codes):
            yield it


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item that it leaks: score and similarity of the best alignment.

    Similarity is the score over that of a verbatim copy; end_word is the word after the alignment.
    Documents are scanned whole where they lie, once for each block of items, without a shuffle. Items or
    documents without words never match; repeated documents each give their rows, repeated items one.
    """
    spark = docs.sparkSession
    out = None
    for it in _blocks(docs, benchmark):
        sent = share(spark, it)

        def scan(batches: Batches, sent=sent) -> Iterator[pa.RecordBatch]:
            it = sent.value
            for b in batches:
                ids, found = b.column("doc_id").to_pylist(), _leaking(it, b.column("text").to_pylist())
                cols = [[ids[f[0]] for f in found], [it.ids[f[1]] for f in found], *([f[j] for f in found] for j in (2, 3, 4))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "similarity", "end_word"])

        part = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), scan, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that leak no item, with all their columns; each batch is filtered in place."""
    for it in _blocks(docs, benchmark):
        sent = share(docs.sparkSession, it)

        def scan(batches: Batches, sent=sent) -> Batches:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in _leaking(sent.value, b.column("text").to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = map_batches(docs, scan, docs.schema)
    return docs
