"""Queries that go through a stream or through written documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ranks import shared_folder
from ..sources import sinks
from ..streaming import suppression, windows
from .base import PREDICTIONS, predictions, query, table


def _folder(spark) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


@query("""SELECT (epoch_us(ts) // 21600000000 * 21600)::BIGINT AS start_s, event_type AS label, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def stream_window_counts(spark, sf_dir):
    folder = _folder(spark)
    windows.latest(windows.window_counts(windows.read_events(spark, f"{sf_dir}/events.parquet"), late="60 days"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select(F.unix_seconds("start").alias("start_s"), "label", "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(events).select("user_id", F.unix_micros("start").alias("start_us"), "n")


#: Parts in which the predictions of a stream arrive, the files of each, and the predictions to a bucket.
ARRIVALS = 5
ARRIVAL_FILES = 12
BUCKET_ROWS = 10_000


@query(PREDICTIONS + """, s AS (SELECT *, max(confidence) OVER (PARTITION BY video, label ORDER BY frame RANGE BETWEEN 720 PRECEDING AND 1 PRECEDING) AS a,
 max(confidence) OVER (PARTITION BY video, label ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND 720 FOLLOWING) AS b FROM pred)
SELECT video, label, frame, ord FROM s WHERE confidence >= coalesce(greatest(a, b), confidence)""")
def stream_suppression(spark, sf_dir):
    folder, pred = _folder(spark), predictions(spark, sf_dir)
    first, last, n = pred.agg(F.min("frame"), F.max("frame"), F.count("*")).first()
    for k in range(ARRIVALS):  # one part after the other, and within each part in no order
        low, high = (first + (last + 1 - first) * j // ARRIVALS for j in (k, k + 1))
        pred.where((F.col("frame") >= low) & (F.col("frame") < high)).repartition(ARRIVAL_FILES).write.mode("append").parquet(f"{folder}/in")
    spark.range(1).select(F.lit(None).cast("long").alias("video"), F.lit("end").alias("label"), F.lit(last + 100_000).alias("frame"), F.lit(0).cast("long").alias("position_ms"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("ord")).write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(pred.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    width = -(-(last + 1 - first) // ARRIVALS)
    found = suppression.suppress_stream(arriving, 720, 60_000, f"{2 * width + 1} minutes", "video", "label", buckets=max(ARRIVAL_FILES, n // BUCKET_ROWS))
    suppression.write_epochs(found, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out").where("video IS NOT NULL").select("video", "label", "frame", "ord")


@query(PREDICTIONS + """SELECT video::VARCHAR AS path, count(*) AS n_events, min(frame) AS first_frame, max(position_ms) AS last_ms FROM pred GROUP BY video""")
def prediction_documents(spark, sf_dir):
    docs = sinks.prediction_documents(predictions(spark, sf_dir), "action", 25.0)
    parsed = F.from_json("document", "data array<struct<inputs: array<struct<path: string>>, events: array<struct<frame: long, position_ms: long>>>>")["data"][0]
    return docs.select(parsed["inputs"][0]["path"].alias("path"), F.size(parsed["events"]).cast("long").alias("n_events"), F.array_min(F.transform(parsed["events"], lambda e: e["frame"])).alias("first_frame"), F.array_max(F.transform(parsed["events"], lambda e: e["position_ms"])).alias("last_ms"))
