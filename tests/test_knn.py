import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vicinal.functions import distance
from vicinal.functions.kernel import Rows, Running, nearest
from vicinal.operators import knn as K
from vicinal.operators.knn import knn, knn_wide, pairwise, recall
from vicinal.plans.variants import VARIANTS, run_variant
from vicinal.sources.generate import gaussian, queries

T = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 4.0]), (4, [0.0, 0.0])]
XS, QS = "x_id bigint, x_vec array<float>", "q_id bigint, q_vec array<float>"
BOTH = pytest.mark.parametrize("strategy", ["sql", "arrow"])


def run(spark, q, x, k, **o):
    df = knn(spark.createDataFrame(q, QS), spark.createDataFrame(x, XS), k, **o)
    return [(r.x_id, r.dist) for r in df.orderBy("q_id", "rank").collect()]


@BOTH
def test_ties_order_and_no_root(spark, strategy):
    full = [(0, 0.0), (4, 0.0), (1, 1.0), (2, 1.0), (3, 25.0)]
    for k in (1, 3, 4, 5, 9):
        assert run(spark, [(0, [0.0, 0.0])], T, k, strategy=strategy) == full[:k]
    assert run(spark, [(0, [0.0, 0.0])], T, 7, strategy=strategy, pad=True) == [*full, (-1, None), (-1, None)]
    assert run(spark, [(0, [3.0, 4.0])], T, 1, strategy=strategy) == [(3, 0.0)]
    assert run(spark, [(0, [0.0, 0.0])], T, 2, strategy=strategy, exclude_self=True) == [(4, 0.0), (1, 1.0)]


@BOTH
def test_empty_and_single(spark, strategy):
    assert run(spark, [], T, 3, strategy=strategy) == []
    assert run(spark, [(0, [0.0, 0.0])], [], 3, strategy=strategy) == []
    assert run(spark, [(0, [2.0])], [(7, [5.0])], 1, strategy=strategy) == [(7, 9.0)]


@BOTH
def test_nan_and_infinite(spark, strategy):
    nan, big = float("nan"), 3e38
    assert run(spark, [(0, [0.0, 0.0])], [(1, [nan, 0.0]), (2, [1.0, 0.0])], 2, strategy=strategy) == [(2, 1.0)]
    assert run(spark, [(0, [big, 0.0])], [(1, [-big, 0.0])], 1, strategy=strategy) == [(1, float("inf"))]


@BOTH
def test_bad_vectors_fail(spark, strategy):
    for bad in ([1.0], [1.0, None], None):
        with pytest.raises(Exception, match="non-null elements"):
            run(spark, [(0, [0.0, 0.0])], [*T, (9, bad)], 3, strategy=strategy)


def test_bad_arguments(spark):
    for o in ({"k": 0}, {"k": 1, "strategy": "x"}, {"k": 1, "tile_size": 0}):
        with pytest.raises(ValueError):
            run(spark, [(0, [0.0, 0.0])], T, **o)
    with pytest.raises(ValueError):
        run_variant("nope", None, None, 1)
    with pytest.raises(ValueError):
        queries(spark, 5, 2, mode="x")


def test_variants_agree(spark):
    X, Q = gaussian(spark, 301, 5).cache(), queries(spark, 21, 5, mode="clustered", cluster_size=4).cache()
    want = [tuple(r) for r in knn(Q, X, 10, strategy="sql").orderBy("q_id", "rank").collect()]
    for name in VARIANTS:
        assert [tuple(r) for r in run_variant(name, Q, X, 10).orderBy("q_id", "rank").collect()] == want, name
    for o in ({"tile_size": 1}, {"tile_size": 7}, {"tile_size": 9999}, {"query_batch": 1}, {"query_batch": 16}):
        assert [tuple(r) for r in knn(Q, X.repartition(5), 10, strategy="arrow", **o).orderBy("q_id", "rank").collect()] == want, o
    wide = knn_wide(Q, X, 10).orderBy("q_id").collect()
    assert wide[0].ids == [r[2] for r in want[:10]]
    assert {r.recall for r in recall(knn(Q, X, 10), knn(Q, X, 10)).collect()} == {1.0}


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 40), st.integers(1, 7), st.booleans())
def test_kernel_equals_brute_force(seed, k, m, d, coarse):
    rng = np.random.default_rng(seed)
    make = lambda n: (rng.integers(-2, 3, (n, d)) if coarse else rng.standard_normal((n, d))).astype(np.float32)
    q, x, ids = make(4), make(m), rng.permutation(m).astype(np.int64)
    one = nearest(q, Rows(ids, x), k)
    run = Running(q, k, 3)
    for a in range(0, m, 7):
        run.add(ids[a : a + 7], x[a : a + 7])
    assert all((u == v).all() for u, v in zip(one, run.lists, strict=True))
    qi, xi, dist = one
    for a in range(4):
        acc = np.zeros(m, np.float32)
        for j in range(d):
            acc += (q[a, j] - x[:, j]) * (q[a, j] - x[:, j])
        order = np.lexsort((ids, acc))[:k]
        assert xi[qi == a].tolist() == ids[order].tolist()
        assert dist[qi == a].tolist() == acc[order].tolist()


def test_grid_equals_broadcast(spark, monkeypatch):
    """Queries beyond the block bound meet the corpus on a grid, in both strategies, without a driver's collect."""
    X, Q = gaussian(spark, 301, 5), queries(spark, 40, 5)
    want = {s: sorted(map(tuple, knn(Q, X, 4, strategy=s).collect())) for s in ("sql", "arrow")}
    pairs = sorted(map(tuple, pairwise(Q, X).collect()))
    monkeypatch.setattr(K, "QUERY_BLOCK_BYTES", 400)
    monkeypatch.setattr(K, "CELL_BYTES", 4000)
    for s, rows in want.items():
        assert sorted(map(tuple, knn(Q, X, 4, strategy=s).collect())) == rows
    assert sorted(map(tuple, pairwise(Q, X).collect())) == pairs
    assert "CartesianProduct" not in pairwise(Q, X)._jdf.queryExecution().toString()
    monkeypatch.setattr(K, "HELD", 50)
    assert sorted(map(tuple, knn(Q, X, 4, strategy="arrow", tile_size=3).collect())) == want["arrow"]


@pytest.mark.parametrize("d", [1, distance.WRITTEN_OUT, distance.WRITTEN_OUT + 1])
def test_both_forms_of_the_distance_equal_the_kernel(spark, d):
    X, Q = gaussian(spark, 50, d), queries(spark, 7, d)
    got = {s: [tuple(r) for r in knn(Q, X, 9, strategy=s).orderBy("q_id", "rank").collect()] for s in ("sql", "arrow")}
    assert got["sql"] == got["arrow"] and len(got["sql"]) == 63
