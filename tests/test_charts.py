from xml.etree import ElementTree

import pytest

from vicinal.plans import charts
from vicinal.sources import reports
from vicinal.sources.svg import chart, write_chart


def test_charts_from_reports(spark, tmp_path):
    row = lambda v, k, n, q, r=1.0: {"variant": v, "k": k, "n": n, "queries_per_second": q, "mean_queries_per_second": q, "std_queries_per_second": q / 10, "recall": r}
    reports.write_report(f"{tmp_path}/a.json", {"m": 5}, [row("baseline", 1, 1000, 10.0), row("q16", 1, 2000, 20.0), row("q4", 2, 2000, 7.0, 0.5)])
    reports.write_report(f"{tmp_path}/b.json", {"m": 6}, [row("baseline", 1, 1000, 99.0), row("q4", 2, 2000, 8.0)])
    both = reports.read_results(spark, [f"{tmp_path}/a.json", f"{tmp_path}/b.json"])
    assert charts.k_sweep(both) == {"k = 1": [(1000.0, 10.0, None), (2000.0, 20.0, None)], "k = 2": [(2000.0, 8.0, None)]}
    assert list(charts.variants(both)) == ["baseline", "q4", "q16"] and charts.variants(both)["baseline"] == [(1000.0, 99.0, 9.9)]
    assert list(charts.panels(both, [2])["k = 2"]) == ["q4"]
    assert charts.over_k(both.where("src = 1"), 2000) == {"q4": [(2.0, 8.0, None)]}
    assert charts.repeated(both.where("src = 0"))["q16"] == [(1.0, 20.0, 2.0)]
    one, two = (reports.read_results(spark, [f"{tmp_path}/{x}.json"]) for x in "ab")
    assert charts.compare(one.where("k = 1"), two.where("k = 1"), 2000) == {"baseline": [(1.0, 20.0, None)], "tiled": []}
    with pytest.raises(ValueError):
        charts.k_sweep(both.where("recall < 0.9"))
    write_chart(f"{tmp_path}/v.svg", charts.variants(both), "a < b", "n", "q/s", log_x=True)
    svg = ElementTree.parse(f"{tmp_path}/v.svg").getroot()
    assert sum(e.tag.endswith("polyline") for e in svg.iter()) == 3
    assert ElementTree.fromstring(chart({}, "none", "x", "y")) is not None
    charts.main(["study", f"{tmp_path}/a.json", "--n-target", "2000", "--panel-ks", "1,2", "--out", f"{tmp_path}/k.svg", "--out-vs-n", f"{tmp_path}/n.svg"])
    panels = ElementTree.parse(f"{tmp_path}/n.svg").getroot()
    assert sum(e.tag.endswith("}g") for e in panels.iter()) == 2 and "m = 5" in open(f"{tmp_path}/k.svg").read()
    for kind in ("repeat", "ksweep", "variants"):
        charts.main([kind, f"{tmp_path}/a.json", "--out", f"{tmp_path}/{kind}.svg"])
        assert "polyline" in open(f"{tmp_path}/{kind}.svg").read()
