"""Named search variants: one answer, different physical plans.

`heap` is the Arrow strategy as such: its running list of the k nearest takes the place of a heap for each
query. `q2` screens two queries at a time, `q4` to `q128` group queries and cut the corpus into as many tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.knn import knn

TILE = 125_000


def _grouped(per_group: int, Q: DataFrame, X: DataFrame, k: int, tile_size: int | None = None, **options) -> DataFrame:
    """Batches of per_group queries over as many corpus tiles, unless a tile size is given."""
    if tile_size is None:
        top = X.agg(F.max("x_id")).first()[0]
        tile_size = max(1, -(-((top or 0) + 1) // per_group))
    return knn(Q, X, k, strategy="arrow", query_batch=per_group, tile_size=tile_size, **options)


def _tiled(Q: DataFrame, X: DataFrame, k: int, tile_size: int = TILE, **options) -> DataFrame:
    return knn(Q, X, k, tile_size=tile_size, **options)


VARIANTS: dict[str, Callable[..., DataFrame]] = {
    "baseline": knn,
    "heap": partial(knn, strategy="arrow"),
    "q2": partial(knn, strategy="arrow", query_batch=2),
    "tiled": _tiled,
    **{f"q{n}": partial(_grouped, n) for n in (4, 8, 16, 32, 64, 128)},
}


def run_variant(name: str, Q: DataFrame, X: DataFrame, k: int, **options) -> DataFrame:
    """The rows of knn() by the variant of that name."""
    if name not in VARIANTS:
        raise ValueError(f"unknown variant {name!r}; known: {sorted(VARIANTS)}")
    return VARIANTS[name](Q, X, k, **options)


def attributes(df: DataFrame) -> dict[str, int]:
    """What a plan consists of, before it runs: shuffles, broadcasts, Python stages and code-generated spans."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    full = df._jdf.queryExecution().executedPlan().toString()
    return {
        "shuffles": full.count("Exchange hashpartitioning") + full.count("Exchange RoundRobin"),
        "broadcasts": full.count("BroadcastExchange"),
        "python_stages": plan.count("MapInArrow") + plan.count("FlatMapCoGroupsInArrow"),
        "window_limits": plan.count("WindowGroupLimit"),
    }
