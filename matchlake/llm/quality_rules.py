"""Quality rules by compression bands: zstandard ratios of whole documents and fixed chunks.

Repetitive text compresses better than prose, random strings far worse. What is usual
depends on the length, so each band of lengths has limits of its own, fitted to the documents
of a corpus that are labelled good (``fit_bands``); other corpora want other limits.

Each row is judged alone. Null text counts as empty: no words, so the base rules reject it.
Repeated rows and repeated ids give one row each. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_slice


@dataclass(frozen=True)
class CompressionRules:
    #: (bytes from, lowest ratio, highest ratio) of whole documents; the last that starts at or below a length holds. Fixed
    #: values: ``fit_bands`` over documents labelled good; random base64 text stays below all lower limits from 96 bytes on.
    bands: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 1.2), (64, 0.0, 1.2), (96, 0.92, 1.3), (128, 1.03, 1.5), (192, 1.12, 1.62), (256, 1.25, 1.7), (384, 1.35, 1.75),
        (512, 1.42, 1.93), (768, 1.55, 2.0), (1024, 1.66, 2.07), (1536, 1.78, 2.18), (2048, 1.85, 2.2), (3072, 1.95, 2.26),
        (4096, 2.05, 2.38), (8192, 2.15, 2.45), (16384, 2.25, 2.55), (65536, 2.25, 2.65),
    )
    chunk_bytes: int = 2048
    chunk_low: float = 1.6
    chunk_high: float = 2.2
    #: A document goes if more than this share of its chunks lies outside the chunk limits; a tail is judged in a chunk that ends with the text.
    chunk_share: float = 0.25
    level: int = 3
    min_words: int = 10
    window: int = 5
    #: A document goes if more than this many words in a hundred lie in repeated windows.
    max_repeat_percent: int = 20

    def limits(self, n_bytes: int) -> tuple[float, float]:
        return next((low, high) for start, low, high in reversed(self.bands) if n_bytes >= start)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [("n_bytes", pa.int64()), ("whole_ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64())]
)
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, whole_ratio double, n_chunks long, n_bad_chunks long"
_SPACES, _SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"


def words_in_repeats(words: list, window: int) -> int:
    """How many words lie in a window of so many words that the list holds at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    grams, kinds = codes[:n], len(ids)
    for k in range(1, window):  # exact: pairs are numbered anew before a product could overflow
        if kinds > (1 << 62) // max(1, len(ids)):
            distinct, grams = np.unique(grams, return_inverse=True)
            kinds = len(distinct)
        grams, kinds = grams * len(ids) + codes[k : k + n], kinds * len(ids)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(twice), 1)
    np.add.at(inside, np.flatnonzero(twice) + window, -1)
    return int(np.count_nonzero(np.cumsum(inside)))


def _measure(text: str | None, rules: CompressionRules, compress) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    n_words = len(words)
    word_chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)] if b"\n" in raw else []
    repeats = words_in_repeats(words, rules.window)
    failed = n_words < rules.min_words or 100 * repeats > rules.max_repeat_percent * n_words
    ratio = len(raw) / len(compress(raw)) if raw else 0.0
    low, high = rules.limits(len(raw))
    last = len(raw) - rules.chunk_bytes
    starts = [*range(0, last, rules.chunk_bytes), last] if last >= 0 else []
    chunks = [raw[k : k + rules.chunk_bytes] for k in starts]
    bad = sum(not rules.chunk_low <= rules.chunk_bytes / len(compress(x)) <= rules.chunk_high for x in chunks)
    fits = low <= ratio <= high and bad <= rules.chunk_share * len(chunks)
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeats, failed, not failed and fits, len(raw), ratio, len(chunks), bad


def compression_rules(docs: DataFrame, rules: CompressionRules = CompressionRules()) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) with its counts, ratios and verdict.

    One pass without a shuffle; a task holds one slice of rows at a time.
    """

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        compress = zstandard.ZstdCompressor(level=rules.level).compress
        rows = [_measure(text, rules, compress) for text in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * (len(SCHEMA) - 1)
        return pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(x, f.type) for x, f in zip(columns, list(SCHEMA)[1:], strict=True)], schema=SCHEMA)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(per_slice(judge), DDL)


def fit_bands(docs: DataFrame, rules: CompressionRules = CompressionRules(), quantile: float = 0.001, margin: float = 0.04) -> CompressionRules:
    """``rules`` with the bands' limits fitted to ``docs``, good documents: what all but ``quantile`` of a band reach, and a margin.

    Quantiles are approximate and added up in Spark; a band that no document lies in keeps its limits, and so does a lower limit of 0.
    """
    starts = [start for start, _, _ in rules.bands]
    band = sum((F.when(F.col("n_bytes") >= start, 1).otherwise(0) for start in starts[1:]), F.lit(0))
    measured = compression_rules(docs, rules).where("not base_failed")
    ends = F.percentile_approx("whole_ratio", [quantile, 1 - quantile], 10_000).alias("ends")
    found = {r.band: r.ends for r in measured.groupBy(band.alias("band")).agg(ends).collect()}
    fitted = [(start, max(0.0, found[k][0] - margin) if low else 0.0, found[k][1] + margin) if k in found else (start, low, high) for k, (start, low, high) in enumerate(rules.bands)]
    return replace(rules, bands=tuple(fitted))
