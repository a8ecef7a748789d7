import os
from collections import Counter

import pytest

import corpus_pipeline
from tests.compare import SF
from tests.llm.test_decontaminate import all_leaks
from tests.llm.test_langid import slow_languages
from tests.llm.test_mixing import slow_targets
from tests.llm.test_simhash import slow_components, slow_fingerprint
from vicinal.llm import decontaminate, mixing, simhash
from vicinal.llm.catalog import QUERIES
from vicinal.runtime import materialise, scratch, shared_dir


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), "test")
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == before.columns
    before, after = seen["simhash near-dedup"]
    one = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(one) and len(one) < before.count()
    before, after = seen["benchmark decontamination"]
    bad = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    before, after = seen["sharding"]
    assert after.columns == [*before.columns, "shard"] and after.count() == before.count()
    assert seen["language id"][1].count() >= 0.99 * seen["language id"][0].count()
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_whole_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage computed anew in plain Python, on a table that holds copies, leaks and texts without letters."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    first = docs.orderBy("doc_id").first()
    more = [(9000, first.text, None, "web", 1), (9001, (first.text or "") + " ", None, None, 1), (9002, "12 34", None, "web", 5), (9003, None, "en", "web", 0)]
    more += [(9004, f"{prose(1)} {items[0][1]} {prose(2)}", "en", "web", 1)]
    folder = str(tmp_path)
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    spoken = slow_languages(rows)
    kept = {r.doc_id: r for r in rows if spoken[r.doc_id][0] != "und" and spoken[r.doc_id][1] >= 0.3}
    of = slow_components([(i, slow_fingerprint(r.text)) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if of[i] == i}
    bad = {d for d, *_ in all_leaks([(i, r.text) for i, r in kept.items()], items)}
    assert 9004 in bad and not {9000, 9001, 9002, 9003} & set(kept)
    kept = {i: r for i, r in kept.items() if i not in bad}
    words = {i: len(r.text.split()) for i, r in kept.items()}
    names = sorted({r.source for r in kept.values()}, key=lambda x: (x is None, x or ""))
    sizes = [sum(words[i] for i, r in kept.items() if r.source == s) for s in names]
    want = dict(zip(names, slow_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    got = corpus_pipeline.run(spark, folder).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(kept) and all(tuple(r)[:-1] == tuple(kept[r.doc_id]) for r in got)
    for s, size in zip(names, sizes, strict=True):
        own, base = [i for i, r in kept.items() if r.source == s], int(want[s] / size + 1e-9)
        assert all(copies[i] in (base, base + 1) for i in own)
        assert abs(sum(copies[i] * words[i] for i in own) - want[s]) <= max(words[i] for i in own)
    held = Counter()
    for r in got:
        held[r.shard] += len(r.text.encode()) + 8
    largest = max(len(r.text.encode()) + 8 for r in got)
    assert max(held.values()) - min(held[k] for k in range(24)) <= largest


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder, rows, extra=""):
    docs = spark.createDataFrame(rows, DOCS + extra)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "which of the seven rivers flows north through the old town"), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def prose(k, lang="en"):
    """Texts that differ in most words."""
    words = {"en": "the river and a house of stone with many old trees near this quiet road", "de": "der Fluss und ein Haus aus Stein mit vielen alten Bäumen an dieser ruhigen Straße"}[lang].split()
    return " ".join(f"{words[(k * 7 + i) % len(words)]} {'abcdefghij'[(k // 10 ** (i % 5)) % 10] * 3}{words[(k + i * i) % len(words)]}" for i in range(30))


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """A third of the rows under one id, a third under null ids, copies among both; helper names taken by users' columns."""
    rows = [(i, prose(i), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(7, prose(1000 + i % 40, "de"), "de", "s0", 1) for i in range(200)]
    rows += [(None, prose(2000 + i % 40), None, None, None) for i in range(200)]
    rows += [(900, None, "en", "s1", 0), (901, "", "en", "s1", 0), (902, "12 34 !", None, "s1", 0)]
    rows += [(903, prose(3000) + " which of the seven rivers flows north through the old town " + prose(3001), "en", "s2", 1)]
    folder = tables(spark, str(tmp_path), [(*r, 5, 6, 7, 8, "x") for r in rows], ", shard int, size int, copies int, fp bigint, unit string")
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r.text for r in got}
    distinct = {r[1] for r in rows[:600]}
    assert kept <= distinct and len(kept) >= 0.3 * len(distinct)
    assert {r.unit for r in got} == {"x"} and {r["size"] for r in got} == {6} and set(r.shard for r in got) <= set(range(24))
    assert any(r.doc_id is None for r in got) and max(Counter(r.text for r in got).values()) <= 2
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = materialise(stages["language id"](spark, docs, folder), "t")
    assert lang.count() == 601 and lang.columns == docs.columns  # null, empty and letterless texts go
    near = materialise(stages["simhash near-dedup"](spark, lang, folder), "t")
    fps = {simhash.fingerprint(t.encode()) for t in {r.text for r in lang.collect()}}
    assert near.columns == docs.columns and near.count() <= len(fps) and {r.text for r in near.where("doc_id is null").collect()}
    clean = materialise(stages["benchmark decontamination"](spark, near, folder), "t")
    assert near.where("doc_id = 903").count() == 1 and clean.count() == near.count() - 1 and not clean.where("doc_id = 903").count()
    mixed = materialise(stages["mixing"](spark, clean, folder), "t")
    want = Counter()
    for r in mixing.mix(clean).collect():
        want[r.doc_id, r["size"]] += r.copies
    assert Counter((r.doc_id, len(r.text.split())) for r in mixed.collect()) == +want


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, str(tmp_path), [])).count() == 0


def test_no_language_known(spark, tmp_path):
    """Without any language to learn, texts with letters stay."""
    rows = [(i, prose(i), None, "s", 1) for i in range(30)] + [(99, "1 2 3", None, "s", 1)]
    got = corpus_pipeline.run(spark, tables(spark, str(tmp_path), rows)).collect()
    assert {r.doc_id for r in got} <= set(range(30)) and len({r.doc_id for r in got}) >= 15


def settings(spark):
    conf = spark._jsparkSession.sessionState().conf().getAllConfs()
    return dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(conf))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_leave_no_files_and_no_settings(spark, name):
    root = shared_dir(spark).removeprefix("file://") + "/vicinal"
    before, files = settings(spark), set(os.listdir(root)) if os.path.exists(root) else set()
    with scratch():
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert settings(spark) == before and (set(os.listdir(root)) if os.path.exists(root) else set()) <= files
