"""The vectorised top-k kernel behind the Arrow strategy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Components beyond this may overflow float32 when squared; such blocks skip the float64 screen.
SCREEN_LIMIT = 1e18
#: Pairs whose exact distance is computed at a time.
EXACT_AT_ONCE = 1 << 18

Lists = tuple[np.ndarray, np.ndarray, np.ndarray]  # query numbers, corpus ids and distances, by (query, distance, id)


def exact_l2sq(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise squared distance of equally many float32 rows, summed dimension by dimension in float32."""
    acc = np.zeros(len(q), np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(q.shape[1]):
            diff = q[:, j] - x[:, j]
            acc += diff * diff
    return acc


@dataclass
class Rows:
    """Some corpus rows, with what the screen needs of them."""

    ids: np.ndarray
    x: np.ndarray

    def __post_init__(self):
        self.tame = bool(self.x.shape[1]) and np.abs(self.x).max(initial=0) < SCREEN_LIMIT  # false for NaN too
        if self.tame:
            self.wide = self.x.astype(np.float64)
            self.norm = (self.wide * self.wide).sum(1)


def best(qi: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> Lists:
    """The k least of each query by (dist, id), sorted."""
    order = np.lexsort((ids, dist, qi))
    qi, ids, dist = qi[order], ids[order], dist[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[keep], ids[keep], dist[keep]


def nearest(q: np.ndarray, rows: Rows, k: int, bound: np.ndarray | None = None) -> Lists:
    """The k nearest rows for each row of q, ties by lowest id, NaN left out; with a bound only those within it.

    A float64 matrix product screens the pairs: a pair stays if its screened distance is within the
    float32 rounding bound of the k-th screened one (or of the query's bound, if that is less), so no true
    neighbour can be lost. Survivors get the exact float32 distance, and only that ranks.
    """
    m, d = rows.x.shape
    if not len(q) or not m:
        return np.zeros(0, np.int64), rows.ids[:0], np.zeros(0, np.float32)
    if rows.tame and np.abs(q).max(initial=0) < SCREEN_LIMIT and (m > k or bound is not None):
        wide = q.astype(np.float64)
        norm = (wide * wide).sum(1)
        screen = wide @ rows.wide.T
        screen *= -2
        screen += norm[:, None]
        screen += rows.norm
        limit = np.full(len(q), np.inf) if bound is None else bound.astype(np.float64)
        if m > k and not np.isfinite(limit).all():
            limit = np.minimum(limit, np.partition(screen, k - 1, axis=1)[:, k - 1])
        limit = limit + 4 * (d + 3) * 2.0**-24 * np.abs(limit) + 1e-12 * (norm + rows.norm.max()) * (d + 3) + 1e-40
        qi, xi = np.nonzero(screen <= limit[:, None])
    else:
        qi, xi = (a.ravel() for a in np.indices((len(q), m)))
    parts = range(0, len(qi), EXACT_AT_ONCE)
    dist = np.concatenate([np.zeros(0, np.float32), *(exact_l2sq(q[qi[a : a + EXACT_AT_ONCE]], rows.x[xi[a : a + EXACT_AT_ONCE]]) for a in parts)])
    ok = ~np.isnan(dist) if bound is None else dist <= bound[qi]
    return best(qi[ok], rows.ids[xi[ok]], dist[ok], k)


class Running:
    """The k nearest rows so far of each query of a block: one list a query however many rows pass."""

    def __init__(self, q: np.ndarray, k: int, step: int):
        self.q, self.k, self.step = q, k, step
        self.lists: Lists = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.bound = np.full(len(q), np.inf, np.float32)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        rows, found = Rows(ids, x), []
        for a in range(0, len(self.q), self.step):
            qi, xi, dist = nearest(self.q[a : a + self.step], rows, self.k, self.bound[a : a + self.step] if len(self.lists[0]) else None)
            found.append((qi + a, xi, dist))
        qi, ids, dist = self.lists = best(*(np.concatenate(c) for c in zip(self.lists, *found, strict=True)), self.k)
        full = np.searchsorted(qi, np.arange(len(self.q)), side="left") + self.k - 1
        has = full < np.searchsorted(qi, np.arange(len(self.q)), side="right")
        self.bound[has] = dist[full[has]]
