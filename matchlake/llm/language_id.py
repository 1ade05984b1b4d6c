"""Languages of documents and of spans in them.

A word is a run of letters of one script, told by ranges of code points. Its script narrows the
languages to those that use it in the labelled documents. Among these, each word has a score a
language: the log probability of its letter bigrams, trigrams and its whole form under hashed
models of the language. Viterbi finds the best path of languages over a document's words, where
each change of language costs a penalty; stretches of one language are the document's spans.
The document's language is the one with most letters on that path.

Learning reads only text and non-null lang of the rows that ``train`` selects, at most
``train_documents`` of them (by a hash of the id) and ``least_documents`` of each language more, so that rare languages are learnt; prediction reads only the text.

Defined cases: null text and text without a letter give ``und``, score 0 and no spans. Words of
a script that no learnt language uses count for all languages alike. Ties go to the language
first in order. With nothing to learn from, every text is ``und``. Repeated rows and ids keep a
row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_slice, slices

#: First and last code point of the letters of each script.
SCRIPT_RANGES = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0xAA), ("latin", 0xBA, 0xBA), ("latin", 0xC0, 0xD6), ("latin", 0xD8, 0xF6), ("latin", 0xF8, 0x2AF),
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x587), ("hebrew", 0x5D0, 0x5F2), ("arabic", 0x620, 0x64A), ("arabic", 0x671, 0x6D3), ("arabic", 0x750, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF),
    ("thai", 0xE01, 0xE4E), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF40, 0xFBC), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17D3),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3041, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x2FA1F),
]
SCRIPTS = list(dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))
_FIRST = np.array([a for _, a, _ in SCRIPT_RANGES], np.uint32)
_LAST = np.array([b for _, _, b in SCRIPT_RANGES], np.uint32)
_SCRIPT = np.array([SCRIPTS.index(name) + 1 for name, _, _ in SCRIPT_RANGES], np.uint8)
BUCKETS = 1 << 16
KINDS = 3


@dataclass(frozen=True)
class LanguageRules:
    train_documents: int = 60_000
    #: Of each language so many are learnt from, where there are as many, beyond its share.
    least_documents: int = 500
    #: Share of a language's letters that must be in a script for the language to be a candidate for its words.
    script_share: float = 0.001
    switch_penalty: float = 12.0
    #: Log score that a language which is no candidate loses on each word.
    off_script: float = 40.0
    #: How far word scores are trusted when a document's probability is told from them.
    temper: float = 0.1


def _lower_table() -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
            table[c] = ord(x)
    return table


_LOWER: list[np.ndarray] = []


@dataclass
class Words:
    """Words of some texts: begin and end among the letters, document, script, place in the text, and hashed grams of each letter and word."""

    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    script: np.ndarray
    at: np.ndarray
    grams: list[np.ndarray]


def words_of(texts: list[str | None]) -> Words:
    if not _LOWER:
        _LOWER.append(_lower_table())
    texts = [t or "" for t in texts]
    codes = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ranges = np.searchsorted(_FIRST, codes, "right").astype(np.int64) - 1
    script = np.where((ranges >= 0) & (codes <= _LAST[ranges]), _SCRIPT[ranges], 0)
    folded = np.where(codes < 0x10000, _LOWER[0][np.minimum(codes, 0xFFFF)], codes).astype(np.uint64)
    folded[script == 0] = 0
    letters = np.flatnonzero(script)
    starts = np.cumsum([1, *[len(t) + 1 for t in texts]])  # of each text among the codes
    if not len(letters):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, [none] * KINDS)
    new = np.ones(len(letters), bool)
    new[1:] = (np.diff(letters) > 1) | (np.diff(script[letters].astype(np.int16)) != 0)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(letters))
    here, before, after = folded[letters], folded[letters - 1], folded[letters + 1]
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    pairs = mix(before << np.uint64(21) | here)
    triples = mix((before * np.uint64(0x100000001B3) + here) * np.uint64(0x100000001B3) + after)
    place = np.arange(len(letters)) - np.repeat(begin, end - begin)
    whole = np.add.reduceat(here * (np.uint64(0xD6E8FEB86659FD93) * (2 * place.astype(np.uint64) + np.uint64(1)) ^ np.uint64(0x5851F42D4C957F2D)), begin)
    at = letters[begin]
    doc = np.searchsorted(starts, at, "right") - 1
    return Words(begin, end, doc, script[at] - 1, at - starts[doc], [pairs, triples, mix(whole ^ whole >> np.uint64(31))])


@dataclass
class LanguageModel:
    languages: list[str]
    tables: list[np.ndarray]  # of each kind of gram: log probability by bucket and language
    candidates: np.ndarray  # by script and language
    prior: np.ndarray


def fit(docs: DataFrame, train: Column, rules: LanguageRules) -> LanguageModel:
    """The models of all languages in the rows of ``docs`` (doc_id, text, lang) that ``train`` selects."""
    rows = docs.where(train & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    share = rules.train_documents / max(1, sum(sizes.values()))
    # of each language at least so many, so that rare ones are learnt
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, max(share, rules.least_documents / n)))]) if sizes else F.lit(None)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < (shares[F.col("lang")] if sizes else F.lit(0.0)) * (1 << 20)).select(F.col("text").cast("string"), "lang")
    width = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS * BUCKETS * width + len(SCRIPTS) * width, np.int64)
        number = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            for part in slices(batch, 300):
                words = words_of(part.column(0).to_pylist())
                language = np.array([number[x] for x in part.column(1).to_pylist()], np.int64)[words.doc]
                letters = words.end - words.begin
                each = np.repeat(language, letters)
                for k, grams in enumerate(words.grams):
                    whose = language if k == KINDS - 1 else each
                    total[k * BUCKETS * width : (k + 1) * BUCKETS * width] += np.bincount(grams * width + whose, minlength=BUCKETS * width)
                total[KINDS * BUCKETS * width :] += np.bincount(words.script * width + language, letters, len(SCRIPTS) * width).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["cell", "n"])

    counted = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(KINDS * BUCKETS * width + len(SCRIPTS) * width)
    cells[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    tables = []
    for k in range(KINDS):
        counts = cells[k * BUCKETS * width : (k + 1) * BUCKETS * width].reshape(BUCKETS, width)
        # A whole form that was never seen says nothing, so its table is a ratio to the mean of the languages.
        rates = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
        if k == KINDS - 1 and width:
            rates = np.where(counts.sum(axis=1, keepdims=True) > 0, rates - rates.mean(axis=1, keepdims=True), 0.0)
        tables.append(rates.astype(np.float32))
    scripts = cells[KINDS * BUCKETS * width :].reshape(len(SCRIPTS), width)
    prior = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, tables, scripts > rules.script_share * np.maximum(1, scripts.sum(axis=0)), np.log(prior / max(1.0, prior.sum())))


def word_scores(model: LanguageModel, words: Words, rules: LanguageRules) -> np.ndarray:
    scores = model.tables[2][words.grams[2]].astype(np.float64)
    for table, grams in zip(model.tables[:2], words.grams[:2], strict=True):
        scores += np.add.reduceat(table[grams], words.begin, axis=0)
    allowed = model.candidates[words.script]
    known = allowed.any(axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    scores -= rules.off_script * ~allowed
    scores[~known] = 0.0
    return scores


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; ``counts``: words of each document, one document after the other.

    All documents go forward together, a word at a time; leaving a language costs the penalty,
    so only the best language of the word before matters besides staying.
    """
    n, width = scores.shape
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if len(lengths) and lengths[0] else []
    stayed, came = np.ones((n, width), bool), np.zeros(n, np.int16)
    now = np.zeros((len(counts), width))
    for t, m in enumerate(active):
        at = starts[:m] + t
        if t == 0:
            now[:m] = scores[at]
            continue
        best = now[:m].argmax(axis=1)
        change = now[np.arange(m), best][:, None] - penalty
        stay = now[:m] >= change
        stayed[at], came[at] = stay, best
        now[:m] = np.where(stay, now[:m], change) + scores[at]
    path, state = np.zeros(n, np.int64), np.zeros(len(counts), np.int64)
    for t in range(len(active) - 1, -1, -1):
        m, longer = active[t], active[t + 1] if t + 1 < len(active) else 0
        at = starts[:m] + t
        if m > longer:
            state[longer:m] = now[longer:m].argmax(axis=1)
        path[at] = state[:m]
        state[:m] = np.where(stayed[at, state[:m]], state[:m], came[at])
    return path


def _label(model: LanguageModel, rules: LanguageRules, texts: list[str | None]) -> tuple[list, list, list]:
    n, width = len(texts), len(model.languages)
    words = words_of(texts)
    lettered = [any(map(str.isalpha, t or "")) for t in texts]
    if not width:
        return ["und"] * n, [0.0] * n, [[]] * n
    spans: list[list] = [[] for _ in texts]
    letters, total = np.zeros((n, width)), np.tile(model.prior, (n, 1))
    if len(words.doc):
        scores = word_scores(model, words, rules)
        path = viterbi(scores, np.bincount(words.doc, minlength=n), rules.switch_penalty)
        size = words.end - words.begin
        letters = np.bincount(words.doc * width + path, size, n * width).reshape(n, width)
        total = total + rules.temper * np.stack([np.bincount(words.doc, scores[:, k], n) for k in range(width)], axis=1)
        change = np.flatnonzero(np.append(True, (np.diff(path) != 0) | (np.diff(words.doc) != 0)))
        last = np.append(change[1:], len(path)) - 1
        for a, b in zip(change, last, strict=True):
            spans[words.doc[a]].append({"lang": model.languages[path[a]], "start": int(words.at[a]), "end": int(words.at[b] + size[b])})
    seen = letters.sum(axis=1)
    best = np.where(seen > 0, (letters + 1e-9 * (total - total.max(axis=1, keepdims=True))).argmax(axis=1), total.argmax(axis=1))
    chance = np.exp(total - total.max(axis=1, keepdims=True))
    chance /= chance.sum(axis=1, keepdims=True)
    rows = np.arange(n)
    score = np.where(seen > 0, letters[rows, best] / np.maximum(seen, 1), 1.0) * chance[rows, best]
    return ([model.languages[k] if x else "und" for k, x in zip(best, lettered, strict=True)], [float(s) if x else 0.0 for s, x in zip(score, lettered, strict=True)], spans)


def label_languages(docs: DataFrame, model: LanguageModel, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """doc_id, lang_pred, score, n_spans and spans (lang, start, end in code points) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, n_spans long, spans array<struct<lang: string, start: long, end: long>>"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, scores, spans = _label(shared.value, rules, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "n_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(per_slice(label, 300), schema)


def identify_languages(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans, spans; learnt from the rows whose crc32(doc_id as text) mod 3 is not 1."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs, fold != 1, rules)
    held = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    return label_languages(docs, model, rules).select("doc_id", held, "lang_pred", "score", "n_spans", "spans")
