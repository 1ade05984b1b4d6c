"""Token counts of byte-level BPE without ever encoding a document.

1. Pre-tokens: the distinct ones of each task with their counts, then of the corpus. Each
   distinct pre-token is encoded once, and only the number of its pieces is kept.
2. Frequencies: how often each document holds each pre-token, joined to those numbers, and the
   sum of count times pieces by document. The join is in two parts, as pre-tokens are as skewed
   as words: the most frequent ones, ``hot`` at most, are broadcast, so their frequencies are
   summed where the document is read; the frequencies of all others are shuffled by pre-token.

Special strings in texts count as the library counts them by default: as one token each.
Null and empty texts have 0 bytes and 0 tokens. Rows with equal ids are counted apart: rows are
told apart by a number that a task gives them, and carry their id along. No rows: no rows.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: The pre-token pattern of the vocabulary (fixed by it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: Distinct pre-tokens that a task holds at a time; the longest that may be broadcast.
HELD, HOT_CHARS = 80_000, 32
Batches = Iterator[pa.RecordBatch]


def _splitter() -> Callable[[str], list[str]]:
    import regex

    found = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def pre_tokens(text: str) -> list[str]:
        if SPECIAL not in text:
            return found(text)
        first, *rest = text.split(SPECIAL)
        return found(first) + [x for part in rest for x in (SPECIAL, *found(part))]

    return pre_tokens


def _distinct(batches: Batches) -> Batches:
    split, held = _splitter(), Counter()
    emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
    for batch in batches:
        for text in batch.column(0):
            held.update(split(text.as_py() or ""))
            if len(held) > HELD:
                yield emit()
                held.clear()
    yield emit()


def _pieces(tokenizer_file: str) -> Callable[[Batches], Batches]:
    def count(batches: Batches) -> Batches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sizes = [len(x) for x in tokenizer.encode_batch(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64())], names=["token", "n", "pieces"])

    return count


def _frequencies(hot: Broadcast) -> Callable[[Batches], Batches]:
    """Rows (key, token, n) of a document's other pre-tokens, and one with the sum over its hot ones, its id and size.

    The latter's token is no pre-token and its own, so that these rows spread as well.
    """

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        split, known, key = _splitter(), hot.value, TaskContext.get().partitionId() << 33
        names = ["key", "token", "n", "doc_id", "n_bytes"]
        for batch in batches:
            for part in slices(batch, 500):
                keys, tokens, counts, own = [], [], [], []
                for text in part.column(1).to_pylist():
                    text, key = text or "", key + 1
                    found = split(text)
                    rest = Counter(x for x in found if x not in known)
                    own.append((key, f"\0{key}", sum(map(known.get, found, repeat(0))), len(text.encode())))
                    keys += [key] * len(rest)
                    tokens += rest
                    counts += rest.values()
                none = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.string()), pa.array(counts, pa.int64()), none, none], names=names)
                a, b, c, d = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), part.column(0), pa.array(d, pa.int64())], names=names)

    return run


def _least_count(pieces: DataFrame, most: int) -> int:
    """The least count so that at most so many short pre-tokens have it or more; counts are tried as powers of the fourth root of two."""
    by_size = pieces.where(F.length("token") <= HOT_CHARS).groupBy(F.floor(4 * F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()
    total, least = 0, None
    for size, n in by_size:
        total += n
        if total > most:
            break
        least = size
    return 1 << 62 if least is None else math.ceil(2 ** (least / 4))


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512, hot: int = 120_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    distinct = rows.select("text").mapInArrow(_distinct, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pieces = written(distinct.mapInArrow(_pieces(tokenizer_file), "token string, n long, pieces long"))
    frequent = (F.col("n") >= _least_count(pieces, hot)) & (F.length("token") <= HOT_CHARS)
    known = rows.sparkSession.sparkContext.broadcast({r.token: r.pieces for r in pieces.where(frequent).select("token", "pieces").toLocalIterator()})
    each = rows.mapInArrow(_frequencies(known), "key long, token string, n long, doc_id long, n_bytes long")
    joined = each.join(pieces.where(~frequent).select("token", "pieces"), "token", "left")
    # what a document adds up itself comes under a mark and counts as it is; any other pre-token has been counted
    pieces_of = F.when(F.col("token").rlike(r"^\x00[0-9]+$"), F.lit(1)).otherwise(F.coalesce("pieces", F.raise_error(F.concat(F.lit("pre-token without a count: "), "token")).cast("long")))
    summed = joined.groupBy("key").agg(F.sum(F.col("n") * pieces_of).alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
