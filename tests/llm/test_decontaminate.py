import random

import numpy as np

from tests.compare import SF
from vicinal.llm import decontaminate as D
from vicinal.llm.catalog import QUERIES


def slow_align(window, item):
    """Smith-Waterman, cell by cell."""
    h, best = [[0] * (len(item) + 1) for _ in range(len(window) + 1)], 0
    for i, a in enumerate(window, 1):
        for j, b in enumerate(item, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if a == b else -D.MISMATCH), h[i - 1][j] - D.GAP, h[i][j - 1] - D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_cell_by_cell():
    rng = np.random.default_rng(1)
    w, it = rng.integers(1, 5, (40, 17)), rng.integers(1, 5, (40, 9))
    score, end = D.align(w, it)
    assert score.tolist() == [slow_align(a.tolist(), b.tolist()) for a, b in zip(w, it, strict=True)]
    assert [slow_align(a[:e].tolist(), b.tolist()) for a, b, e in zip(w, it, end, strict=True)] == score.tolist()


def test_word_hashes_follow_words():
    texts = ["The cat, the_cat 12 é.", None, "", "x" * 3000, "a\n\nb", "Straße STRASSE"]
    h, doc = D.word_hashes(texts)
    flat = [(i, w) for i, t in enumerate(texts) for w in D.words(t)]
    assert doc.tolist() == [i for i, _ in flat]
    assert len({w for _, w in flat}) == len(set(h.tolist())) == len(set(zip(h.tolist(), (w for _, w in flat), strict=True)))


def test_whole_table_equals_brute_force(spark):
    """Every document against every item: all leaks by full alignment, prefiltered only by shared words."""
    docs = {r.doc_id: D.words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: D.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {}
    for i, item in items.items():
        need = D.LEAK * D.MATCH * len(item)
        for d, w in docs.items():
            if D.MATCH * len(set(w) & set(item)) * 4 < need:  # each word of an item stands in it at most a few times
                continue
            pad = np.full((1, len(w)), -1)
            ids = {x: n for n, x in enumerate(item)}
            pad[0] = [ids.get(x, -1) for x in w]
            score = int(D.align(pad, np.array([[ids[x] for x in item]]))[0][0])
            if score >= need:
                want[d, i] = score
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    assert got == want and len(want) > 10


def test_edited_copies_common_items_and_edges(spark, monkeypatch):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(40)]
    edited = [w if k % 6 else "other" for k, w in enumerate(item)]
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    rows = [(1, f"{filler(50)} {' '.join(edited)} {filler(9)}"), (2, filler(80)), (3, None), (4, ""), (5, "Yes."), (6, " ".join(item) + "! " + filler(3)), (6, " ".join(item))]
    rows += [(100 + k, " ".join(item)) for k in range(60)] + [(999, (filler(700) + " ") * 20 + " ".join(item) + " " + filler(400))]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id bigint, text string, score int, item_id double")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "yes"), (9, None), (None, ""), (10, "no no")], "item_id bigint, text string")
    found = sorted((r.doc_id, r.item_id, round(r.similarity, 2)) for r in D.leaks(docs, bench).collect())
    assert found[0][:2] == (1, 7) and 0.5 < found[0][2] < 1
    assert found[1:] == [(5, 8, 1.0), (6, 7, 1.0), (6, 7, 1.0), *((100 + k, 7, 1.0) for k in range(60)), (999, 7, 1.0)]
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 2)) for r in D.leaks(docs, bench).collect()) == found
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.leaks(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == docs.count()


def all_leaks(rows, items):
    """Every document against every item by full alignment."""
    want = set()
    for d, text in rows:
        for i, item in items:
            ids = {w: n for n, w in enumerate(D.words(item))}
            window = np.array([[ids.get(w, -1) for w in D.words(text)]])
            score = int(D.align(window, np.array([[ids[w] for w in D.words(item)]]))[0][0])
            if score >= D.LEAK * D.MATCH * len(D.words(item)):
                want.add((d, i, score))
    return want


def test_edited_copies_alone_in_groups_and_beside_a_verbatim_one(spark):
    rng = random.Random(7)
    items = [(k, " ".join(f"i{k}w{n}" if n % 3 else f"c{n // 3}" for n in range(31 + k))) for k in range(8)]
    filler = lambda n: " ".join(rng.choice([f"f{rng.randrange(300)}", f"c{rng.randrange(12)}"]) for _ in range(n))
    every = lambda t, n, edit: " ".join(edit(w) if k % n == n - 1 else w for k, w in enumerate(t.split()))
    swap, put = (lambda w: f"x{rng.randrange(99)}"), (lambda w: f"{w} x{rng.randrange(99)}")
    copies = [(0, 4, swap, 1), (1, 5, swap, 1), (2, 4, swap, 200), (3, 5, swap, 200), (4, 4, swap, 1), (5, 3, swap, 1), (6, 1, put, 1), (7, 2, lambda w: "", 1), (7, 3, lambda w: "", 1)]
    texts = [f"{filler(20)} {every(items[i][1], n, edit)} {filler(20)}" for i, n, edit, times in copies for _ in range(times)]
    texts += [items[4][1], *(filler(200) for _ in range(20))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in D.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == all_leaks(rows, items) and {i for _, i, _ in got} == set(range(8)) and len(got) >= 407


def test_no_leak_is_lost_whatever_the_edits():
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(n))) for k, n in enumerate([3, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20])]
    it = D.make_items([i for i, _ in items], [t for _, t in items])
    rows = []
    for d in range(600):
        out = []
        share = rng.random() * 0.5
        for w in rng.choice(items)[1].split():
            edit = rng.random() / share if share else 9
            out += [w] if edit > 1 else [["x"], [], [w, "x"], [w, "x", "y"]][rng.randrange(4)]
        rows.append((d, " ".join([f"w{rng.randrange(60)}" for _ in range(rng.randrange(9))] + out)))
    got = {(d, i, s) for d, i, s, _, _ in D._leaking(it, [t for _, t in rows])}
    assert got == all_leaks(rows, items) and len(got) > 300
