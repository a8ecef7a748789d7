"""Main text of web pages: a bidirectional LSTM labels every leaf block with the whole page in view."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import Batches, map_batches
from vicinal.llm.decontaminate import word_hashes
from vicinal.llm.html import PATH, Block, blocks
from vicinal.llm.layouts import MARK, labelled_page
from vicinal.runtime import share

#: Sizes of the hashed word vector and each direction's state.
WORDS, HIDDEN = 48, 24
SHAPE = 11
#: Synthetic pages that the labeller is trained on, passes over them, pages of a batch, and step size.
PAGES, EPOCHS, BATCH, STEP = 3000, 6, 50, 0.01
SEED = 7
#: Blocks whose vectors are held at a time, and characters whose words are hashed at a time.
SLICE, CHARS = 1 << 14, 1 << 19
RESULT = "page_id bigint, url string, text string, n_chars bigint"


def _chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(block numbers, texts) of about CHARS characters; a longer text comes in parts."""
    number, held, size = [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), CHARS) if len(t) > CHARS else (0,):
            part = t[a : a + CHARS]
            number.append(i)
            held.append(part)
            size += len(part)
            if size >= CHARS:
                yield np.array(number), held
                number, held, size = [], [], 0
    if held:
        yield np.array(number), held


def path_vectors(some: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed tag paths of some blocks as 0/1 rows, and each block's row."""
    row: dict[int, int] = {}
    at = np.array([row.setdefault(b.bits(), len(row)) for b in some], np.int64)
    packed = b"".join(bits.to_bytes(PATH // 8, "little") for bits in row)
    return np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, PATH // 8), axis=1, bitorder="little").astype(np.float32), at


def positions(page: list[Block]) -> np.ndarray:
    """For each block of a page: its place from 0 to 1, and whether it shares its container with the block before and the one behind."""
    held = [b.container() for b in page]
    same = [False, *(a is b for a, b in zip(held, held[1:], strict=False)), False] if page else [False]
    return np.stack([(np.arange(len(page)) + 0.5) / max(1, len(page)), np.array(same[:-1], float), np.array(same[1:], float)], 1)


def text_vectors(some: list[Block], places: np.ndarray) -> np.ndarray:
    """Hashed-word and shape vectors of some blocks; places: their rows of positions()."""
    n, texts = len(some), [b.text for b in some]
    words, count = np.zeros(n * WORDS), np.zeros(n, np.int64)
    for number, held in _chunks(texts):
        h, doc = word_hashes(held)
        doc = number[doc]
        count += np.bincount(doc, minlength=n)
        sign = np.where(h & np.uint64(1), 1.0, -1.0)
        words += np.bincount(doc * WORDS + (h >> np.uint64(40)).astype(np.int64) % WORDS, sign, n * WORDS)
    words = words.reshape(n, WORDS) / np.sqrt(np.maximum(count, 1))[:, None]
    shape = [
        (math.log1p(len(t)) / 4, math.log1p(c) / 3, b.link / len(t), t[-1:] in ".!?:;…", (t.count(".") + t.count(",")) / (c + 1), sum(map(t.count, "|©·»›")) > 0, t[:1].isupper(), *x, 1.0)
        for b, t, c, x in zip(some, texts, count.tolist(), places.tolist(), strict=True)
    ]
    return np.concatenate([words, np.array(shape, float).reshape(n, SHAPE)], 1).astype(np.float32)


@dataclass
class Labeller:
    """Weights by name: input, recurrent and bias weights of both directions, and of the output."""

    w: dict[str, np.ndarray]

    def __post_init__(self):
        """For labelling, the gates' weights are halved: then one tanh serves gates and candidate."""
        half = np.where(np.arange(4 * HIDDEN) < 3 * HIDDEN, 0.5, 1).astype(np.float32)
        self.fast = {k: v * half if v.shape[-1] == 4 * HIDDEN else v for k, v in self.w.items()}

    def _inputs(self, d: str, paths: tuple[np.ndarray, np.ndarray], rest: np.ndarray) -> np.ndarray:
        return (paths[0] @ self.fast[d + "p"])[paths[1]] + rest @ self.fast[d + "x"] + self.fast[d + "b"]

    def _step(self, d: str, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.tanh(x + h @ self.fast[d + "h"])
        gates = z[:, : 3 * HIDDEN] * 0.5 + 0.5
        c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * z[:, 3 * HIDDEN :]
        return gates[:, 2 * HIDDEN :] * np.tanh(c), c

    def _together(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Several pages of few blocks, all advancing together, longest first."""
        sizes = np.array([len(p) for p in pages], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.float32) for _ in pages]
        flat = [b for p in pages for b in p]
        start = np.cumsum(sizes) - sizes
        paths, rest = path_vectors(flat), text_vectors(flat, np.concatenate([positions(p) for p in pages]))
        order = np.argsort(-sizes, kind="stable")
        size, first = sizes[order], start[order]
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        total = np.zeros(len(flat), np.float32)
        for d in "fb":
            x = self._inputs(d, paths, rest)
            h, c = (np.zeros((len(size), HIDDEN), np.float32) for _ in range(2))
            for t, n in enumerate(active.tolist()):
                at = first[:n] + (t if d == "f" else size[:n] - 1 - t)
                h, c = self._step(d, x[at], h[:n], c[:n])
                total[at] += h @ self.w["o" + d]
        return np.split(_sigmoid(total + self.w["bias"]), np.cumsum(sizes)[:-1])

    def _alone(self, page: list[Block]) -> np.ndarray:
        """A page of very many blocks: in slices, the state carried from one to the next."""
        n = len(page)
        total, places = np.zeros(n, np.float32), positions(page)
        for d in "fb":
            h, c = (np.zeros((1, HIDDEN), np.float32) for _ in range(2))
            for a in range(0, n, SLICE) if d == "f" else range((n - 1) // SLICE * SLICE, -1, -SLICE):
                own = page[a : a + SLICE]
                x = self._inputs(d, path_vectors(own), text_vectors(own, places[a : a + len(own)]))
                states = np.empty((len(own), HIDDEN), np.float32)
                for t in range(len(own)) if d == "f" else range(len(own) - 1, -1, -1):
                    h, c = self._step(d, x[t : t + 1], h, c)
                    states[t] = h
                total[a : a + len(own)] += states @ self.w["o" + d]
        return _sigmoid(total + self.w["bias"])

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each block of each page the probability of being main text. Vectors of at most about SLICE blocks are held."""
        out, a = [], 0
        while a < len(pages):
            b, n = a + 1, len(pages[a])
            while b < len(pages) and n + len(pages[b]) <= SLICE:
                n += len(pages[b])
                b += 1
            out += [self._alone(pages[a])] if n > SLICE else self._together(pages[a:b])
            a = b
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _cell(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: new state and memory, and the gates (input, forget, output, candidate) and tanh of the memory."""
    gates = _sigmoid(z[:, : 3 * HIDDEN])
    i, f, o = np.split(gates, 3, 1)
    g = np.tanh(z[:, 3 * HIDDEN :])
    c = f * c + i * g
    tc = np.tanh(c)
    return o * tc, c, i, f, o, g, tc


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w[d + "p"] = rng.normal(0, 0.1, (PATH, 4 * HIDDEN))
        w[d + "x"] = rng.normal(0, 0.1, (WORDS + SHAPE, 4 * HIDDEN))
        w[d + "h"] = rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[d + "b"] = np.zeros(4 * HIDDEN)
        w[d + "b"][HIDDEN : 2 * HIDDEN] = 1
        w["o" + d] = rng.normal(0, 0.1, HIDDEN)
    w["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def gradients(w: dict[str, np.ndarray], paths: np.ndarray, rest: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss over the blocks of a batch (pages x time, padding masked out) and its gradient, through time."""
    n, T = mask.shape
    logit, kept = np.zeros((n, T), np.float32), {}
    for d in "fb":
        x = paths @ w[d + "p"] + rest @ w[d + "x"] + w[d + "b"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        steps = []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            m = mask[:, t, None]
            before = h, c
            hn, cn, *gates = _cell(x[:, t] + h @ w[d + "h"], c)
            h, c = m * hn, m * cn  # padding holds the zero state, so the backward run starts at each page's end
            logit[:, t] += h @ w["o" + d]
            steps.append((t, before, h, gates))
        kept[d] = steps
    p = _sigmoid(logit + w["bias"])
    count = mask.sum()
    loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / count)
    err = (mask * (p - y) / count).astype(np.float32)
    out = {"bias": np.array([err.sum()])}
    for d in "fb":
        dz_all = np.zeros((n, T, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out["o" + d], out[d + "h"] = np.zeros(HIDDEN, np.float32), np.zeros_like(w[d + "h"])
        for t, (h0, c0), h, (i, f, o, g, tc) in reversed(kept[d]):
            m = mask[:, t, None]
            out["o" + d] += err[:, t] @ h
            dh = m * (dh + err[:, t, None] * w["o" + d])
            dc = m * dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[:, t] = dz
            out[d + "h"] += h0.T @ dz
            dh, dc = dz @ w[d + "h"].T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        out[d + "p"], out[d + "x"], out[d + "b"] = paths.reshape(len(flat), -1).T @ flat, rest.reshape(len(flat), -1).T @ flat, flat.sum(0)
    return loss, out


def training_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks of made-up pages and whether each is main text."""
    out = []
    for k in range(n):
        found = blocks(labelled_page(Random(f"{seed}/{k}")))
        y = np.array([MARK in b.text for b in found], np.float32)
        out.append(([Block(b.text.replace(MARK, "").strip() or ".", b.node, b.link) for b in found], y))
    return out


@cache
def trained(pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller, fitted by Adam on made-up pages of many layouts; the same weights at every call."""
    data = []
    for p, y in training_pages(pages, SEED):
        if p:
            paths, at = path_vectors(p)
            data.append((paths[at], text_vectors(p, positions(p)), y))
    rng = np.random.default_rng(SEED)
    w = initial(rng)
    m, v, step = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2)), None, 0
    m, v = m
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[k][2]) // 8 for k in order], kind="stable")]
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            own = [data[k] for k in batches[b]]
            T = max(len(y) for *_, y in own)
            mask, y = np.zeros((len(own), T), np.float32), np.zeros((len(own), T), np.float32)
            P, R = np.zeros((len(own), T, PATH), np.float32), np.zeros((len(own), T, WORDS + SHAPE), np.float32)
            for i, (paths, rest, label) in enumerate(own):
                n = len(label)
                mask[i, :n], y[i, :n], P[i, :n], R[i, :n] = 1, label, paths, rest
            P *= rng.random((len(own), 1, PATH)) > 0.1  # whole tokens go missing, so that no single one decides
            R[:, :, :WORDS] *= rng.random((len(own), 1, 1)) > 0.3  # and so do the words of some pages
            _, g = gradients(w, P, R, y, mask)
            step += 1
            norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = STEP * (1 - 0.9 * (epoch / max(1, epochs - 1))) * min(1.0, 1.0 / (norm + 1e-9))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Labeller(w)


def main_text(found: list[Block], p: np.ndarray) -> str:
    return "\n".join(b.text for b, x in zip(found, p, strict=True) if x >= 0.5)


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page: the main blocks of the whole page in order, one on each line.

    A null or empty page, and one without main blocks, has an empty text. Rows are independent, so repeated
    rows and clashing extra columns don't matter. Time and memory grow with a page's length, whatever its tags.
    """
    sent = share(pages.sparkSession, labeller or trained())

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(h) for h in b.column("html").to_pylist()]
            texts = [main_text(f, p) for f, p in zip(found, sent.value.label(found), strict=True)]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(own, scan, RESULT, rows=400, size=4 << 20)
