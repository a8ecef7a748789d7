import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from tests.compare import SF
from vicinal.llm import langid
from vicinal.llm.catalog import QUERIES


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op9_language_id"](spark, SF).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 300
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.98


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 6, 1, 5])
    e = rng.normal(0, 3, (sizes.sum(), 3)).astype(np.float32)
    path, at = langid.viterbi(e, sizes, 2.0), 0
    for n in sizes:
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(e[at + i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(path[at : at + n]) == best
        at += n


def small(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in [("the cat and the dog went home with them", "en"), ("der hund und die katze gehen nach hause", "de"), ("кошка и собака идут домой вместе", "ru")]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_spans_scripts_and_edges(spark):
    model = langid.fit(small(spark))
    assert model.langs == ["de", "en", "ru"]
    rows = [
        (1, "the dog and the cat went home und die katze und der hund gehen nach hause", "zz"),
        (2, "домой", None),
        (3, None, "en"),
        (4, "", "en"),
        (5, "12 34 !!", "en"),
        (None, "the cat", "en"),
        (7, "the cat " * 30000, "en"),
        (7, "the cat " * 30000, "en"),
    ]
    got = langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string, score string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert [(s.lang, s.n_words) for s in by[1].spans] == [("en", 7), ("de", 9)]
    assert by[2].lang_pred == "ru" and by[2].score == 1.0
    for i in (3, 4, 5):
        assert (by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, [])
    assert by[None].lang_pred == "en" and [r.lang_pred for r in got if r.doc_id == 7] == ["en", "en"] and len(got) == 8


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert langid.identify(empty).count() == 0
    none = spark.createDataFrame([(1, "the cat", None)], "doc_id bigint, text string, lang string")
    assert langid.identify(none).first().lang_pred == "und"


def test_filter_keeps_clean_documents_and_columns(spark):
    docs = small(spark).withColumn("lang_pred", langid.F.lit(1)).unionByName(spark.createDataFrame([(999, "12 !!", None, 1), (None, "the cat", None, 1)], "doc_id bigint, text string, lang string, lang_pred int"))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 121


def plain_words(text):
    """Words as lists of characters: a letter, then letters and marks."""
    out, inside = [], False
    for c in text.lower():
        if c.isalpha() or (inside and langid.category(c)[0] == "M"):
            if not inside:
                out.append([])
            out[-1].append(c)
            inside = True
        else:
            inside = False
    return out


def plain_buckets(word):
    codes = [0, *map(ord, word), 0]
    return [((((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F + c) * 0x165667B19E3779F9) % 2**64) >> 48 for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


def plain_script(word):
    return next((1 if first == 0x1E00 else i for i, (first, last) in reversed(list(enumerate(langid.SCRIPTS, 1))) if first <= ord(word[0]) <= last), 0)


def slow_label(words, langs, log_p, allowed):
    """lang_pred and score of one text, a word and a language at a time."""
    V, back = None, []
    for w in words:
        e = [sum(log_p[b][k] for b in plain_buckets(w)) for k in range(len(langs))]
        e = [max(x - max(e), -langid.WORD_LIMIT) - (0 if allowed[plain_script(w)][k] else langid.WRONG_SCRIPT) for k, x in enumerate(e)]
        if V is None:
            V = e
            continue
        top = V.index(max(V))
        back.append([k if V[k] >= V[top] - langid.SWITCH else top for k in range(len(langs))])
        V = [max(V[k], V[top] - langid.SWITCH) + x for k, x in enumerate(e)]
    if V is None:
        return "und", 0.0
    path = [V.index(max(V))]
    for row in reversed(back):
        path.append(row[path[-1]])
    letters = [0] * len(langs)
    for k, w in zip(reversed(path), words, strict=True):
        letters[k] += len(w)
    best = letters.index(max(letters))
    return langs[best], letters[best] / sum(letters)


def slow_languages(docs):
    """doc_id -> lang_pred and score, learned and scored without numpy."""
    known = [r for r in docs if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    langs = sorted({r.lang for r in known})
    assert 0 < len(known) <= langid.FIT_DOCS_PER_LANGUAGE
    grams, scripts = Counter(), Counter()
    for r in known:
        for w in plain_words(r.text or ""):
            grams.update((b, r.lang) for b in plain_buckets(w))
            scripts[plain_script(w), r.lang] += len(w)
    total = {x: sum(n for (_, y), n in grams.items() if y == x) for x in langs}
    letters = {x: sum(n for (_, y), n in scripts.items() if y == x) for x in langs}
    unseen = [math.log(0.2 / (total[x] + 0.2 * 65536)) for x in langs]
    log_p = defaultdict(lambda: unseen)
    for b in {b for b, _ in grams}:
        log_p[b] = [math.log((grams[b, x] + 0.2) / (total[x] + 0.2 * 65536)) for x in langs]
    allowed = {s: [scripts[s, x] >= langid.SCRIPT_SHARE * max(1, letters[x]) for x in langs] for s in range(len(langid.SCRIPTS) + 1)}
    allowed = {s: a if any(a) else [True] * len(langs) for s, a in allowed.items()}
    return {r.doc_id: slow_label(plain_words(r.text or ""), langs, log_p, allowed) for r in docs}


def test_whole_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = slow_languages(spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, sf).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {i: lang for i, (lang, _) in want.items()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and abs(r.score - want[i][1]) <= 1e-9 for i, r in got.items())
