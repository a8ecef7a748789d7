import os

import pytest

from vicinal.runtime import materialise, release, scratch, share, shared_dir


def held(spark):
    root = shared_dir(spark).removeprefix("file://") + "/vicinal"
    return sorted(os.listdir(root)) if os.path.exists(root) else []


def test_scopes_delete_what_they_hold(spark):
    before = held(spark)
    with scratch():
        kept = []
        with scratch():
            materialise(spark.range(3), "inner")
            empty = materialise(spark.range(0), "empty")
            kept.append(materialise(spark.range(5), "kept", outlive=True))
            sent = share(spark, {"a": 1})
            assert sent.value == {"a": 1}
        assert [f for f in held(spark) if f not in before] == [f for f in held(spark) if f.startswith("kept")] and kept[0].count() == 5
        with pytest.raises(Exception, match="."):
            spark.range(1).rdd.map(lambda _: sent.value).collect()
        assert empty is not None
    assert held(spark) == before
    out = materialise(spark.range(2), "lasting")
    assert out.count() == 2 and len(held(spark)) == len(before) + 1
    release(out)
    release(out)
    assert held(spark) == before


def test_no_own_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_dir(Session).startswith("file://")


def test_searches_leave_settings_alone(spark):
    from vicinal.plans.catalog import QUERIES

    before = dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.sessionState().conf().getAllConfs()))
    for name in ("knn_k64", "knn_qgroup16", "pairwise_dist"):
        QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.sessionState().conf().getAllConfs())) == before


def test_queries_that_write_release_their_files(spark):
    from vicinal.plans.catalog import QUERIES

    before = held(spark)
    with scratch():
        for name in ("json_results", "json_failures", "chart_points", "sweep_failures"):
            assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert len(held(spark)) >= len(before) + 3
    assert held(spark) == before
