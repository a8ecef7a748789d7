import json

import pytest

from vicinal.functions.text import csv_ints, parse_variants, whole_numbers
from vicinal.plans import sweep as sweeps
from vicinal.plans.sweep import sweep
from vicinal.plans.variants import VARIANTS
from vicinal.sources import reports
from vicinal.sources.generate import gaussian, queries
from vicinal.streaming.knn_stream import knn_stream


def test_sweep_report_round_trip(spark, tmp_path):
    X, Q = gaussian(spark, 60, 3), queries(spark, 6, 3)
    rows, failed = sweep(X, Q, ["baseline", "heap"], [2], [4], trials=2, reps=1, measure_recall=True)
    assert len(rows) == 2 and not failed and {r["recall"] for r in rows} == {1.0}
    rows, failed = sweep(X, Q, ["heap"], [0], [4], skip_failures=True)
    assert not rows and failed[0]["k"] == 0 and failed[0]["error"].startswith("ValueError: ")
    rows, _ = sweep(X, Q, ["tiled", "q4"], [2], [5], trials=2, reps=1, tile_size=7, distribution="clustered")
    assert rows[0]["tile_size"] == 7 and rows[0]["n_tiles"] == 9 and "tile_size" not in rows[1] and rows[1]["block"] == 4
    assert rows[1]["strategy"] == "arrow" and rows[1]["plan_attrs"]["python_stages"] == 1 and rows[0]["distribution"] == "clustered"
    ms = rows[0]["trial_query_ms"]
    assert rows[0]["mean_query_ms"] == pytest.approx(sum(ms) / 2) and rows[0]["std_query_ms"] == pytest.approx(abs(ms[0] - ms[1]) / 2)
    assert rows[0]["queries_per_second"] == pytest.approx(5000 / rows[0]["query_ms"]) and rows[0]["ms_per_query"] == pytest.approx(rows[0]["query_ms"] / 5)
    sweeps.main(["--m", "50", "--d", "2", "--k", "1,2", "--n", "4", "--reps", "1", "--mode", "clustered", "--cluster-size", "2", "--cluster-noise", "0.5", "--tile-size", "9", "--variants", "tiled", "--recall", "--out", f"{tmp_path}/s.json"])
    saved = json.load(open(f"{tmp_path}/s.json"))
    assert saved["meta"]["k_values"] == [1, 2] and saved["meta"]["cluster_noise"] == 0.5 and [r["n_tiles"] for r in saved["results"]] == [6, 6]
    with pytest.raises(SystemExit):
        sweeps.main(["--k", ","])
    for i in (0, 1):
        reports.write_report(f"{tmp_path}/{i}.json", {"m": i}, [{"variant": "q2", "n": i}], [])
    assert json.load(open(f"{tmp_path}/1.json"))["meta"] == {"m": 1}
    got = reports.read_results(spark, [f"{tmp_path}/0.json", f"{tmp_path}/1.json"]).orderBy("src").collect()
    assert [(r.src, r.pos, r.n) for r in got] == [(0, 0, 0), (1, 0, 1)]
    assert reports.read_meta(spark, [f"{tmp_path}/0.json"]).first().m == 0


def test_parsing(spark):
    assert parse_variants(" q2, ,baseline", list(VARIANTS)) == ["q2", "baseline"]
    for bad in ("nope", " , "):
        with pytest.raises(ValueError):
            parse_variants(bad, list(VARIANTS))
    assert whole_numbers(" 1,,20") == [1, 20]
    for bad in ("1,x", ","):
        with pytest.raises(ValueError):
            whole_numbers(bad)
        with pytest.raises(Exception, match="whole numbers"):
            spark.createDataFrame([(bad,)], "t string").select(csv_ints("t")).collect()


def test_stream(spark, tmp_path):
    X, Q = gaussian(spark, 40, 3), queries(spark, 9, 3)
    Q.write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema(Q.schema).parquet(f"{tmp_path}/q")
    for c in "ab":  # the second run knows nothing of the first: it replays the batch
        w = knn_stream(stream, X, 2, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/{c}").trigger(availableNow=True).start()
        w.awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 18
