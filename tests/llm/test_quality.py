import math
import re
import zlib
from collections import Counter

import numpy as np

from tests.compare import SF
from vicinal.llm import boosting, quality
from vicinal.llm.catalog import QUERIES


def slow_score(f, row):
    total = f.prior
    for k in f.root:
        while f.left[k] != k:
            k = f.left[k] if row[f.feature[k]] <= f.threshold[k] else f.right[k]
        total += f.value[k]
    return 1 / (1 + np.exp(-total))


def test_traversal_equals_walking_each_tree_and_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = boosting.fit(x[:400], y[:400], 20)
    s = f.score(x)
    assert np.allclose(s, [slow_score(f, r) for r in x])
    assert ((s[400:] > 0.5) == y[400:]).mean() > 0.9
    for bad in (boosting.fit(x[:0], y[:0]), boosting.fit(x, np.ones(600))):
        assert len(set(bad.score(x).tolist())) == 1


def test_held_out_labels(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op4_quality"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert len(held) > 50 and sum(r.predicted == label[r.doc_id] for r in held) / len(held) >= 0.95


def test_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (3, "word " * 200_000, 3), (None, "Some text.", 4)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 7), (None, 1)], "doc_id bigint, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(r.score is not None for r in got)
    many = spark.createDataFrame([(i % 2 * 4 + 1, f"text {i} " * (1 + i % 3)) for i in range(3000)], "doc_id bigint, text string")
    twice = spark.createDataFrame([(1, 0), (1, 0), (5, 1), (5, 1), (5, 0), (2, 1)] * 500, "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality.boosting, "fit", lambda x, y: seen.append(len(x)) or boosting.Forest(*(np.zeros(0, int),) * 5, np.zeros(0), 0.0))
    quality.fit(quality.measured(many), twice)  # one row for each id, contradicting labels left out
    assert seen[0] <= 1
    monkeypatch.undo()
    assert quality.classify(docs, labels.limit(0)).count() == 5 and quality.classify(docs.limit(0), labels).count() == 0


def slow_statistics(text):
    """The features one by one, by name."""
    data = text.encode()
    n, words, lines = len(data), re.findall(rb"[^ \t\n\r\x0b\x0c]+", data), data.split(b"\n")
    w, pairs, count = len(words), [*zip(words, words[1:], strict=False)], Counter(data)
    share = lambda chars: sum(v for b, v in count.items() if b in chars) / max(1, n)
    named = {
        "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "blank": b" \t\n\r\x0b\x0c", "high": bytes(range(128, 256)), "period": b".",
        "comma": b",", "exclamation": b"!", "question": b"?", "bar": b"|", "symbol": b"*%&$#@^~+=<>_", "bracket": b"()[]{}\"'",
    }
    f = {k: share(v) for k, v in named.items()}
    f |= {"other": 1 - sum(f.values()) if n else 0.0, "largest_byte": max(count.values(), default=0) / max(1, n)}
    f |= {"log_bytes": math.log(1 + n), "log_words": math.log(1 + w), "bytes_per_word": n / max(1, w), "distinct_words": len(set(words)) / max(1, w)}
    f |= {"distinct_pairs": len(set(pairs)) / max(1, w - 1), "repeated_word": sum(a == b for a, b in pairs) / max(1, w - 1)}
    f |= {"upper_words": sum(bool(re.search(rb"[A-Z]", x)) and not re.search(rb"[a-z]", x) for x in words) / max(1, w)}
    f |= {"lines": len(lines) / max(1, w), "bytes_per_line": n / len(lines), "distinct_lines": len(set(lines)) / len(lines)}
    f |= {"ended_lines": sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)}
    return [f[k] for k in quality.FEATURES]


def slow_fit(x, y, trees, depth):
    """Boosting with every split of every node tried on its rows; the raw score of each row."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    raw = np.full(len(y), math.log(share / (1 - share)))
    edges = [sorted({sorted(x[:, f])[int(q * (len(y) - 1) / boosting.BINS)] for q in range(1, boosting.BINS)}) for f in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def grow(rows, level, g=g, h=h):
            value = lambda r: g[r].sum() ** 2 / (h[r].sum() + boosting.L2)
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                for e in edges[f]:
                    a, b = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                    if min(h[a].sum(), h[b].sum()) >= boosting.LEAST and (gain := value(a) + value(b) - value(rows)) > best[0] + 1e-12:
                        best = (gain, (a, b))
            if best[1] is None:
                raw[rows] -= boosting.RATE * g[rows].sum() / (h[rows].sum() + boosting.L2)
                return
            for part in best[1]:
                grow(part, level + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-raw))


def test_fit_equals_trying_every_split():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=150) > 0).astype(float)
    assert np.allclose(boosting.fit(x, y, 5).score(x), slow_fit(x, y, 5, boosting.DEPTH), atol=1e-9)


def test_whole_query_equals_brute_force(spark, monkeypatch):
    """Every score from features computed by name and from walking each tree, learned from the allowed rows alone."""
    sf, fitted, true_fit = "/root/testdata/sf0.001", [], boosting.fit
    monkeypatch.setattr(quality.boosting, "fit", lambda x, y: fitted.append((x, y, true_fit(x, y))) or fitted[-1][2])
    got = sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in QUERIES["op4_quality"](spark, sf).collect())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    stats = {i: np.array(slow_statistics(t), np.float32) for i, t in docs.items()}
    learn = sorted(i for i in docs if label.get(i) in (0, 1) and not held[i])
    ((x, y, forest),) = fitted
    assert len(x) == len(learn) and y.tolist() == [label[i] for i in learn] and np.allclose(x, [stats[i] for i in learn], atol=1e-6)
    assert [r[:2] for r in got] == sorted(held.items())
    scores = [slow_score(forest, stats[i]) for i, *_ in got]
    assert np.allclose([r[2] for r in got], scores, atol=1e-9)
    assert [r[3] for r in got] == [int(r[2] >= 0.3) for r in got]
