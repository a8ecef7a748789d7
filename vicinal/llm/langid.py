"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import Batches, held_out, map_batches, unit_hash
from vicinal.runtime import share

#: Documents of each language that a model is fitted on, at most (expected number; chosen by a hash of the id).
FIT_DOCS_PER_LANGUAGE = 4000
#: Nats that a change of language from one word to the next costs.
SWITCH = 12.0
#: Most nats by which one word may favour a language, and what a script that a language never uses costs.
WORD_LIMIT, WRONG_SCRIPT = 25.0, 60.0
#: Share of a language's letters from which a script is one of its own.
SCRIPT_SHARE = 0.001
BUCKETS = 1 << 16
#: Words that one Viterbi run spans, and characters of which scores are computed at a time.
WORDS_AT_ONCE, CHARS_AT_ONCE = 1 << 19, 1 << 18
#: Scores (words x languages) that one run holds; with more languages it spans fewer words, though always whole texts.
SCORES_AT_ONCE = 1 << 22
UNDETERMINED = "und"
RESULT = "doc_id bigint, lang_pred string, score double, spans array<struct<word:int,n_words:int,lang:string>>"

# First and last code point of the scripts told apart; everything else is script 0.
SCRIPTS = [
    (0x0041, 0x024F),  # Latin
    (0x0370, 0x03FF),  # Greek
    (0x0400, 0x052F),  # Cyrillic
    (0x0530, 0x058F),  # Armenian
    (0x0590, 0x05FF),  # Hebrew
    (0x0600, 0x077F),  # Arabic
    (0x0900, 0x097F),  # Devanagari
    (0x0980, 0x09FF),  # Bengali
    (0x0A00, 0x0A7F),  # Gurmukhi
    (0x0B80, 0x0BFF),  # Tamil
    (0x0C00, 0x0C7F),  # Telugu
    (0x0E00, 0x0E7F),  # Thai
    (0x10A0, 0x10FF),  # Georgian
    (0x1100, 0x11FF),  # Hangul letters
    (0x1E00, 0x1EFF),  # Latin, additional
    (0x3040, 0x309F),  # Hiragana
    (0x30A0, 0x30FF),  # Katakana
    (0x3400, 0x9FFF),  # Han
    (0xAC00, 0xD7AF),  # Hangul syllables
]


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, whether a mark (vowel signs, accents), and its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    mark = np.fromiter((category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for i, (first, last) in enumerate(SCRIPTS, 1):
        script[first : last + 1] = i
    script[0x1E00:0x1F00] = 1
    return letter, mark, script


@dataclass
class Words:
    """Words of some texts: maximal runs of letters and of the marks that follow them."""

    doc: np.ndarray  # text number of each word
    script: np.ndarray  # script of its first letter
    letters: np.ndarray  # its length
    grams: np.ndarray  # hashed trigram around each letter of all words, in order


def split_words(texts: list[str]) -> Words:
    letter, mark, script = _characters()
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in lower])
    is_letter = letter[codes]
    if mark[codes].any():  # a run of letters and marks belongs to a word from its first letter on
        inside = is_letter | mark[codes]
        at = np.arange(len(codes))
        begin = np.maximum.accumulate(np.where(inside, 0, at + 1))  # of the run around each place
        last = np.maximum.accumulate(np.where(is_letter, at, -1))  # letter up to it
        is_letter = inside & (last >= begin)
    kept = np.where(is_letter, codes, 0).astype(np.uint64)
    before = np.concatenate([[np.uint64(0)], kept[:-1]])
    after = np.concatenate([kept[1:], [np.uint64(0)]])
    at = np.flatnonzero(is_letter)
    mixed = (before[at] * np.uint64(0x9E3779B97F4A7C15) + kept[at]) * np.uint64(0xC2B2AE3D27D4EB4F) + after[at]
    grams = (mixed * np.uint64(0x165667B19E3779F9) >> np.uint64(48)).astype(np.int64)
    start = np.flatnonzero(before[at] == 0)
    first = at[start]
    return Words(np.searchsorted(ends, first, side="right"), script[codes[first]], np.diff(np.append(start, len(at))), grams)


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # trigram bucket x language
    allowed: np.ndarray  # script x language

    def emissions(self, w: Words) -> np.ndarray:
        """Nats of each word for each language, 0 for the best."""
        if not len(w.doc):
            return np.zeros((0, len(self.langs)), np.float32)
        e = np.add.reduceat(self.log_p[w.grams], np.cumsum(w.letters) - w.letters, axis=0)
        e = np.maximum(e - e.max(1, keepdims=True), -WORD_LIMIT)
        return e - np.where(self.allowed[w.script], 0, np.float32(WRONG_SCRIPT))


def make_model(langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> Model:
    """A model from counts by language and bucket; buckets from BUCKETS on count letters of a script."""
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(langs)))
    np.add.at(counts, (bucket, lang), n)
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    p = (grams + 0.2) / (grams.sum(0) + 0.2 * BUCKETS)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script that nobody uses tells nothing
    return Model(langs, np.log(p).astype(np.float32), allowed)


def viterbi(emissions: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of every word: most nats in total, where each change within a text costs penalty.

    All texts advance together, longest first, so one step is a few array operations over those that
    still have a word. Of equally good paths the one without a change, then the lowest language, wins.
    """
    order = np.argsort(-sizes, kind="stable")
    size, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    L = emissions.shape[1]
    number = np.int8 if L < 128 else np.int16
    own = np.arange(L, dtype=number)
    back = np.zeros((len(emissions), L), number)
    last = np.zeros(len(size), np.int64)
    V = np.zeros((len(size), L), np.float32)
    for t in range(steps):
        n = active[t]
        if t and n < len(V):
            last[n : len(V)] = V[n:].argmax(1)
            V = V[:n]
        at = first[:n] + t
        if t:
            top = V.argmax(1)
            jump = V[np.arange(n), top] - np.float32(penalty)
            stay = V >= jump[:, None]
            back[at] = np.where(stay, own, top[:, None])
            V = np.maximum(V, jump[:, None])
            V = V - V.max(1, keepdims=True) + emissions[at]
        else:
            V = V[:n] + emissions[at]
    if steps:
        last[: len(V)] = V.argmax(1)
    path = np.zeros(len(emissions), number)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = last[:n]
        last[:n] = back[at, last[:n]]
    return path


def at_once(model: Model) -> int:
    return min(WORDS_AT_ONCE, SCORES_AT_ONCE // max(1, len(model.langs)))


def _label(model: Model, ids: list, texts: list[str], with_spans: bool) -> dict[str, list]:
    docs, letters, emissions, a = [], [], [], 0
    while a < len(texts):
        b, chars = a, 0
        while b < len(texts) and (b == a or chars + len(texts[b]) <= CHARS_AT_ONCE):
            chars += len(texts[b])
            b += 1
        w = split_words(texts[a:b])
        docs.append(w.doc + a)
        letters.append(w.letters)
        emissions.append(model.emissions(w))
        a = b
    doc, n_letters = np.concatenate(docs), np.concatenate(letters)
    sizes = np.bincount(doc, minlength=len(texts))
    path = viterbi(np.concatenate(emissions), sizes)
    L = len(model.langs)
    share = np.bincount(doc * L + path, weights=n_letters, minlength=len(texts) * L).reshape(-1, L)
    total = share.sum(1)
    best = share.argmax(1)
    score = np.where(total > 0, share[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
    out = {"doc_id": ids, "lang_pred": [model.langs[k] if n else UNDETERMINED for k, n in zip(best, total, strict=True)], "score": score.tolist()}
    out["spans"] = [None] * len(texts)
    if with_spans:
        ends = np.cumsum(sizes)
        for i, (n, end) in enumerate(zip(sizes, ends, strict=True)):
            p = path[end - n : end]
            cut = np.flatnonzero(np.diff(p)) + 1
            starts = np.concatenate([[0], cut])[: 1 if n else 0] if not len(cut) else np.concatenate([[0], cut])
            stops = np.append(starts[1:], n)
            out["spans"][i] = [{"word": int(s), "n_words": int(e - s), "lang": model.langs[p[s]]} for s, e in zip(starts, stops, strict=False)]
    return out


def fit(docs: DataFrame) -> Model:
    """Trigram and script counts of a bounded sample of the rows with a language that aren't held out.

    Sampled is each language at the rate that gives FIT_DOCS_PER_LANGUAGE documents, so a rare language is
    learned whole. Only the languages' row counts and the bucket counts reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out())
    sizes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    langs = [x for x, _ in sizes]
    number = F.create_map(*(F.lit(v) for i, (x, _) in enumerate(sizes) for v in (x, i)))
    rate = F.create_map(*(F.lit(v) for x, n in sizes for v in (x, min(1.0, FIT_DOCS_PER_LANGUAGE / n))))
    sample = known.where(unit_hash("doc_id") < rate[F.col("lang")]).select(number[F.col("lang")].alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    width = BUCKETS + len(SCRIPTS) + 1

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), width), np.int64)
        for b in batches:
            lang, texts = b.column("lang").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for k in np.unique(lang):
                w = split_words([t for t, x in zip(texts, lang, strict=True) if x == k])
                counts[k] += np.bincount(w.grams, minlength=width)
                counts[k, BUCKETS:] += np.bincount(w.script, weights=w.letters, minlength=len(SCRIPTS) + 1).astype(np.int64)
        k, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[k, bucket])], names=["lang", "bucket", "n"])

    rows = map_batches(sample, scan, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return make_model(langs, rows["lang"].to_numpy(), rows["bucket"].to_numpy(), rows["n"].to_numpy())


def predict(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, spans of every document, whole texts.

    lang_pred is the language of most letters, score its share of them; spans are runs of words (maximal
    runs of letters, counted from 0) of one language. A text that is null, empty or without a letter, and
    every text where no language was learned, is `und` with score 0 and no spans. Rows are independent,
    so repeated rows and clashing extra columns don't matter.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])))])
    sent = share(docs.sparkSession, model)

    def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
        if not sent.value.langs:
            out = {"doc_id": ids, "lang_pred": [UNDETERMINED] * len(ids), "score": [0.0] * len(ids), "spans": [[] if with_spans else None] * len(ids)}
        else:
            out = _label(sent.value, ids, texts, with_spans)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        ids, texts, words = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                words += len(texts[-1]) // 6
                if words >= at_once(sent.value):
                    yield flush(ids, texts)
                    ids, texts, words = [], [], 0
        if ids:
            yield flush(ids, texts)

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), scan, RESULT)


def _filtered(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """docs with only the rows of a language; batches are held until one Viterbi run, then filtered in place."""
    sent = share(docs.sparkSession, model)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for b in held for t in b.column("text").to_pylist()]
        out = _label(sent.value, [None] * len(texts), texts, False)
        keep = np.array([k != UNDETERMINED and s >= least for k, s in zip(out["lang_pred"], out["score"], strict=True)], bool)
        at = 0
        for b in held:
            yield b.filter(pa.array(keep[at : at + b.num_rows]))
            at += b.num_rows

    def scan(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= 6 * at_once(sent.value):
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return map_batches(docs, scan, docs.schema)


def identify(docs: DataFrame, with_spans: bool = True) -> DataFrame:
    """Fit on docs, then predict all of docs."""
    return predict(docs, fit(docs), with_spans)


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents whose text has letters of which at least that share is in one language, all columns kept.

    Rows are judged one by one where they lie. Where no language can be learned (no row has one), nothing can
    be rejected for its language: every text with a letter stays.
    """
    model = fit(docs)
    return _filtered(docs, model, least) if model.langs else docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
