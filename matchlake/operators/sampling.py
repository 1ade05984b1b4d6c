"""Random draws that a lost task repeats: every draw is a hash of a key, never of a partition's order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number from [0, 1) for the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def draws(n: int, seed: int, session) -> DataFrame:
    """(draw, u): ``n`` uniform draws."""
    return session.range(n).select(F.col("id").alias("draw"), uniform(seed, "id").alias("u"))


def weighted_draws(items: DataFrame, key: str, weight: str, n: int, seed: int, *keep: str, buckets: int = 1024) -> DataFrame:
    """(draw, key, keep): ``n`` draws with replacement among the rows, in proportion to the weights.

    Two steps of cumulative weights, over buckets of rows and then within one, so no task holds
    all items: a draw first picks its bucket; there draws and items are sorted together by
    cumulative weight, and a draw takes the item that ends next. Nothing is paired.
    """
    each = items.where(F.col(weight) > 0).select(key, *keep, F.col(weight).cast("double").alias("w"), F.pmod(F.xxhash64(key, *keep), F.lit(buckets)).alias("bucket"))
    sums = sorted((r.bucket, r.size) for r in each.groupBy("bucket").agg(F.sum("w").alias("size")).collect())  # as many as there are buckets
    if not sums:
        return items.select(F.lit(0).cast("long").alias("draw"), key, *keep).limit(0)
    numbers, sizes = np.array([b for b, _ in sums]), np.array([s for _, s in sums])
    ends = np.cumsum(sizes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy() * ends[-1]
            k = np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)
            inside = np.clip(at - (ends[k] - sizes[k]), 0.0, sizes[k] * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers[k]), pa.array(inside)], names=["draw", "bucket", "at"])

    placed = draws(n, seed, items.sparkSession).mapInArrow(place, "draw long, bucket long, at double")
    by = Window.partitionBy("bucket").orderBy(key, *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = each.select("bucket", F.sum("w").over(by).alias("at"), F.struct(key, *keep).alias("item"), F.lit(None).cast("long").alias("draw"))
    both = within.unionByName(placed.select("bucket", "at", F.lit(None).cast(within.schema["item"].dataType).alias("item"), "draw"))
    # From the far end on; a draw comes before an item that ends where it falls, as that one is over by then.
    back = Window.partitionBy("bucket").orderBy(F.desc("at"), F.col("draw").isNull(), F.desc("item"))
    taken = both.select("draw", F.last("item", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("item"))
    return taken.where(F.col("draw").isNotNull()).select("draw", *[F.col("item")[c].alias(c) for c in (key, *keep)])


def ranked_weighted_draws(items: DataFrame, key: str, weight: str, n: int, ranks: int, seed: int, epoch: int) -> DataFrame:
    """(rank, draw, key): each rank draws from its own stride of the items."""
    parts = None
    for rank in range(ranks):
        part = weighted_draws(items.where(F.pmod(F.col(key), F.lit(ranks)) == rank), key, weight, n // ranks, seed + epoch * ranks + rank).select(F.lit(rank).alias("rank"), "draw", key)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def clip_starts(videos: DataFrame, key: str, frames: str, length: int, pad: int, n: int, seed: int) -> DataFrame:
    """(draw, key, start): videos drawn by their length, the start uniform over the padded video."""
    drawn = weighted_draws(videos.withColumn("_w", F.col(frames)), key, "_w", n, seed, frames)
    room = F.greatest(F.col(frames) + 2 * pad - length, F.lit(0)) + 1
    return drawn.select("draw", key, (F.floor(uniform(seed + 1, "draw") * room) - pad).alias("start"))


def foreground_starts(events: DataFrame, key: str, frame: str, length: int, n: int, seed: int) -> DataFrame:
    """(draw, key, start): an event drawn evenly, the start so that the event is inside the clip; a key may have many events."""
    drawn = weighted_draws(events.withColumn("_one", F.lit(1.0)), key, "_one", n, seed, frame)
    return drawn.select("draw", key, (F.col(frame) - F.floor(uniform(seed + 1, "draw") * length)).alias("start"))


def balanced_anchors(anchors: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """(draw, label, key): a label drawn evenly, then one of its anchors evenly; a key may have many anchors."""
    sizes = anchors.groupBy(label).agg((1.0 / F.count("*")).alias("_w"))
    return weighted_draws(anchors.join(sizes, label), key, "_w", n, seed, label).select("draw", label, key)


def per_video_starts(videos: DataFrame, key: str, frames: str, clip: int, per_video: int, seed: int) -> DataFrame:
    """(key, k, start): so many starts a video, uniform from 1 to frames - (clip + 1)."""
    each = videos.select(key, frames, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_video - 1).cast("long"))).alias("k"))
    room = F.greatest(F.col(frames) - (clip + 1), F.lit(1))
    return each.select(key, "k", (1 + F.floor(uniform(seed, key, "k") * room)).alias("start"))


def mixed(a: Column, b: Column, part: Column) -> Column:
    """Elementwise part * a + (1 - part) * b."""
    return F.zip_with(a, b, lambda x, y: part * x + (1 - part) * y)
