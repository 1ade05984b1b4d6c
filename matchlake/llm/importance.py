"""Quality classifier by importance resampling with hashed n-gram generative models.

Two models are counted: one of the target (labelled documents of good quality), one of the raw
corpus (every document). Each is a product of independent draws of hashed n-grams: characters'
pairs and triples, which know marks, capitals and scripts; words; and, for each word, how many
of the words just before it are the same one, which knows runs of a repeated word. A document's
log weight is the sum over its n-grams of log p_target - log p_raw.

Documents are then sampled without replacement in proportion to their weights by Gumbel top-k:
log weight plus Gumbel noise, greatest k first. The noise is a hash of the id and the text, so
a lost task draws the same again. k is ``share`` of the corpus, or, by default, as many as the
weights themselves expect to be of the target: the documents whose log weight is at least 0, or
at least what all but ``floor_quantile`` of the good labelled documents reach, if that is less.

The k-th greatest key is found by counting keys digit by digit, four small aggregations, not by
a sort of the corpus. Keys that tie with it are all taken.

Defined cases: null and empty texts have log weight 0 and are judged like all others; repeated
rows tie and share their fate; with no good labels the target is the raw corpus, so all weights
are 0. An empty table gives no rows. Labels that are null or contradict each other for one id
count as not good. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, per_slice, slices, utf8

#: Buckets of each kind of n-gram, and values of the repeat count.
CHAR2, CHAR3, WORD, REPEAT = 1 << 16, 1 << 16, 1 << 16, 4
SIZES = (CHAR2, CHAR3, WORD, REPEAT)
_STARTS = np.cumsum((0, *SIZES))


@dataclass(frozen=True)
class ResamplingRules:
    #: Labelled documents of crc32(doc_id as text) mod ``folds`` 0 are held out of the target, so that accuracy can be measured.
    folds: int = 5
    #: The target model takes at most so many good documents (by a hash of the id); the raw model and all scores take everything.
    target_documents: int = 200_000
    smoothing: float = 1.0
    share: float | None = None
    floor_quantile: float = 0.001
    seed: int = 42


def _grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: buckets, and the row that each is in."""
    n = len(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    d = data.astype(np.uint32)
    same2, same3 = row[1:] == row[:-1], row[2:] == row[:-2]
    pair = (d[:-1] << 8 | d[1:])[same2] if n > 1 else np.zeros(0, np.uint32)
    triple = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(2654435761) >> np.uint32(16))[same3] if n > 2 else np.zeros(0, np.uint32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    edge = np.empty(n, bool)
    edge[:1] = True
    edge[1:] = space[:-1] | ~same2 if n > 1 else True
    begins = np.flatnonzero(inside & edge)
    if len(begins):
        word = np.cumsum(inside & edge) - 1
        place = np.arange(n) - begins[np.maximum(word, 0)]
        mixed = (data.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (2 * place.astype(np.uint64) + np.uint64(1)) >> np.uint64(7) | np.uint64(1))
        sums = np.add.reduceat(np.where(inside, mixed * np.uint64(0xD6E8FEB86659FD93), np.uint64(0)), begins)
        words, rows = sums ^ sums >> np.uint64(29), row[begins]
        run = np.zeros(len(words), np.int64)
        for k in range(1, REPEAT):
            run[k:] += (words[k:] == words[:-k]) & (rows[k:] == rows[:-k])
        words = (words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    else:
        words, rows, run = (np.zeros(0, np.int64),) * 3
    return [(pair, row[:-1][same2] if n > 1 else pair), (triple, row[:-2][same3] if n > 2 else triple), (words, rows), (run, rows)]


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in ``docs`` (text): one vector a task, added in Spark bucket by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_STARTS[-1], np.int64)
        for batch in batches:
            for part in slices(batch, 500):
                for first, size, (buckets, _) in zip(_STARTS, SIZES, _grams(*utf8(part.column(0))), strict=False):
                    total[first : first + size] += np.bincount(buckets, minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_STARTS[-1])
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    """log p_target - log p_raw of each bucket, smoothed within its kind by so many draws spread as in the raw model."""
    parts = []
    for first, size in zip(_STARTS, SIZES, strict=False):
        t, r = target[first : first + size], raw[first : first + size]
        p_raw = (r + smoothing / size) / (r.sum() + smoothing)
        weight = smoothing * max(1.0, t.sum() ** 0.5)
        parts.append(np.log((t + weight * p_raw) / (t.sum() + weight)) - np.log(p_raw))
    return np.concatenate(parts)


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight, n_grams and ``draw`` (64 bits of id and text) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))
    schema = pa.schema([("doc_id", pa.int64()), ("draw", pa.int64()), ("log_weight", pa.float64()), ("n_grams", pa.int64())])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for first, (buckets, rows) in zip(_STARTS, _grams(*utf8(batch.column(2))), strict=False):
            total += np.bincount(rows, shared.value[first + buckets], batch.num_rows)
            many += np.bincount(rows, minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), pa.array(many)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("draw"), F.col("text").cast("string"))
    return rows.mapInArrow(per_slice(score, 500), "doc_id long, draw long, log_weight double, n_grams long")


def gumbel(bits: Column, seed: int) -> Column:
    """A standard Gumbel draw from 64 bits."""
    uniform = (F.shiftrightunsigned(F.xxhash64(bits, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def _ordered(key: Column) -> Column:
    """The key as an integer in the same order, to 2^-20; beyond 2^42 keys are as one."""
    return F.round(F.greatest(F.least(key, F.lit(2.0**42)), F.lit(-(2.0**42))) * 2.0**20).cast("long")


def kth_greatest(keys: DataFrame, k: int) -> int | None:
    """The k-th greatest value of the long column ``key``, found 16 bits at a time; None if there are fewer."""
    if k < 1:
        return None
    low, left = -(1 << 63), k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift)
        inside = keys if shift == 48 else keys.where(F.shiftright("key", shift + 16) == F.lit(low >> (shift + 16)))
        for value, n in inside.groupBy(digit.alias("d")).count().orderBy(F.desc("d")).collect():
            if n >= left:
                low = value << shift
                break
            left -= n
        else:
            return None
    return low


def resampled(docs: DataFrame, labels: DataFrame, rules: ResamplingRules = ResamplingRules()) -> DataFrame:
    """doc_id, log_weight, sample_key and kept (drawn among the k) for each row of ``docs``, and its ``draw``."""
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality").cast("int"), F.lit(0))).alias("quality")).where("quality = 1")
    trained = good.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % rules.folds != 0)
    trained = trained.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.target_documents).select("doc_id")
    trained = F.broadcast(trained)  # ids, and no more than the rule allows
    target = gram_counts(docs.join(trained, "doc_id", "left_semi"))
    raw = gram_counts(docs)
    scored = cut_lineage(log_weights(docs, log_ratios(target if target.any() else raw, raw, rules.smoothing)))
    if rules.share is None:
        floor = scored.join(trained, "doc_id", "left_semi").agg(F.percentile_approx("log_weight", rules.floor_quantile, 10_000)).first()[0]
        k = scored.where(F.col("log_weight") >= min(floor if floor is not None else 0.0, 0.0)).count()
    else:
        k = round(rules.share * scored.count())
    keyed = scored.withColumn("sample_key", F.col("log_weight") + gumbel(F.col("draw"), rules.seed)).withColumn("key", _ordered(F.col("sample_key")))
    least = kth_greatest(keyed, k)
    kept = F.lit(k > 0) if least is None else F.col("key") >= least
    return keyed.select("doc_id", "draw", "log_weight", "sample_key", kept.alias("kept"))


def keep_resampled(docs: DataFrame, labels: DataFrame, rules: ResamplingRules = ResamplingRules()) -> DataFrame:
    """The rows of ``docs`` that are drawn, their columns as they were."""
    gone = resampled(docs, labels, rules).where("not kept").select(F.col("doc_id").alias("_id"), "draw").distinct()
    return docs.join(gone, (F.xxhash64(docs["doc_id"], docs["text"]) == gone["draw"]) & docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
