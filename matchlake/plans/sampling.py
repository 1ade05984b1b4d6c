"""Queries of sampling. Draws are hashes, so SQL of another engine can't give the same rows; tests hold their shares instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from .base import query, table


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.greatest("c_acctbal", F.lit(0.0)).alias("w"))


@query()
def weighted_draws(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    return S.weighted_draws(rows, "c_custkey", "w", rows.count(), 42)


@query()
def distributed_weighted_draws(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    return S.ranked_weighted_draws(rows, "c_custkey", "w", rows.count(), 4, 42, 1)


@query()
def random_clip_starts(spark, sf_dir):
    videos = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return S.clip_starts(videos, "user_id", "n", 10, 5, 5000, 7)


@query()
def foreground_clip_starts(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type <> 'view'")
    return S.foreground_starts(events.select("event_id", F.floor(F.col("event_id") / 3).alias("frame")), "event_id", "frame", 16, 5000, 7)


@query()
def balanced_anchors(spark, sf_dir):
    return S.balanced_anchors(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 5000, 7)


@query()
def per_video_starts(spark, sf_dir):
    videos = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return S.per_video_starts(videos, "user_id", "n", 16, 3, 7)


@query("""SELECT a.vec_id, round(sum((0.25 * a.embedding[i] + 0.75 * b.embedding[i])::DOUBLE), 3) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(1, 65) r(i) GROUP BY 1""")
def mixup_blend(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    blend = S.mixed(F.col("a"), F.col("b"), F.lit(0.25))
    return a.join(b, "vec_id").select("vec_id", F.round(F.aggregate(blend, F.lit(0.0), lambda x, y: x + y), 3).alias("total"))
