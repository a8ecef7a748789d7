"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 64
#: Least sum of second derivatives in a leaf, and L2 weight on leaf values.
LEAST, L2 = 1.0, 1.0


@dataclass
class Forest:
    """All nodes of all trees, one after the other; a leaf is its own child."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: every row walks every tree a level at a time."""
        node = np.broadcast_to(self.root, (len(x), len(self.root)))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.prior + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosts the log loss of labels 0 and 1. Splits lie between quantiles of each feature."""
    n, width = x.shape if x.ndim == 2 else (0, 0)
    share = (y.sum() + 0.5) / (n + 1.0)
    prior = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def new() -> int:
        k = len(nodes["feature"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", 0.0)):
            nodes[name].append(v)
        return k

    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        cell = binned + np.arange(width) * BINS
        raw = np.full(n, prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(new())
            at, open_ = np.zeros(n, np.int64), [roots[-1]]
            for depth in range(DEPTH + 1):
                k = len(open_)
                live = at >= 0
                if depth < DEPTH:
                    flat = (at[live, None] * (width * BINS) + cell[live]).ravel()
                    G, H = (np.bincount(flat, np.repeat(w[live], width), k * width * BINS).reshape(k, width, BINS) for w in (g, h))
                    GL, HL = G.cumsum(2), H.cumsum(2)
                    GT, HT = GL[:, :1, -1:], HL[:, :1, -1:]
                    gain = GL**2 / (HL + L2) + (GT - GL) ** 2 / (HT - HL + L2) - GT**2 / (HT + L2)
                    gain[(HL < LEAST) | (HT - HL < LEAST)] = -np.inf
                    best = gain.reshape(k, -1).argmax(1)
                    f, b = best // BINS, best % BINS
                    splits = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
                else:
                    splits, f, b = np.zeros(k, bool), np.zeros(k, int), np.zeros(k, int)
                sums = [np.bincount(at[live], w[live], k) for w in (g, h)]
                nxt, to = [], np.full((k, 2), -1)
                for i, node in enumerate(open_):
                    if splits[i] and b[i] < len(edges[f[i]]):
                        nodes["feature"][node], nodes["threshold"][node] = int(f[i]), float(edges[f[i]][b[i]])
                        nodes["left"][node], nodes["right"][node] = new(), new()
                        to[i] = len(nxt), len(nxt) + 1
                        nxt += [nodes["left"][node], nodes["right"][node]]
                    else:
                        nodes["value"][node] = float(-RATE * sums[0][i] / (sums[1][i] + L2))
                where = np.flatnonzero(live)
                side = binned[where, f[at[where]]] > b[at[where]]
                leaf = to[at[where], 0] < 0
                raw[where[leaf]] += np.array(nodes["value"])[np.array(open_)[at[where[leaf]]]]
                at[where] = to[at[where], side.astype(int)]
                open_ = nxt
                if not open_:
                    break
    a = {k: np.array(v) if v else np.zeros(0) for k, v in nodes.items()}
    ints = lambda v: np.array(v, np.int64)
    return Forest(ints(roots), ints(a["feature"]), a["threshold"].astype(float), ints(a["left"]), ints(a["right"]), a["value"].astype(float), prior)
