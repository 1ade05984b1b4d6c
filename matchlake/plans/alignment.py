"""Queries of alignment, clip windows and label shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..sources import games
from .base import PREDICTIONS, micros, predictions, query, table, task_count


@query("""WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_id % 5 = 0), r AS (SELECT event_id AS o, user_id, epoch_us(ts) AS t FROM events WHERE event_id % 5 <> 0),
j AS (SELECT l.event_id, arg_min(r.t, (abs(r.t - l.t), r.t)) AS nearest_time, min(abs(r.t - l.t)) AS gap FROM l JOIN r USING (user_id) GROUP BY 1) SELECT event_id, nearest_time FROM j WHERE gap <= 7200000000""")
def asof_nearest_tol(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    left, right = rows.where("event_id % 5 = 0"), rows.where("event_id % 5 <> 0").withColumn("value", F.col("event_id"))
    return A.nearest(left, right, "user_id", "t", "event_id", "value", 7_200_000_000).select("event_id", "nearest_time")


@query(PREDICTIONS + """, w AS (SELECT ord, video, slot, frame + (slot - 2) * 60 AS frame FROM pred, range(5) r(slot))
SELECT w.ord, w.slot, w.frame, coalesce(f.label, 'none') AS label FROM w LEFT JOIN (SELECT video, frame // 60 AS h, arg_min(label, ord) AS label FROM pred GROUP BY ALL) f ON f.video = w.video AND f.h = w.frame // 60""")
def frame_lookup_default(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    hours = rows.select("video", F.floor(F.col("frame") / 60).alias("h"), "label", F.col("ord").alias("o"))
    wanted = A.around(rows.select("ord", "video", F.col("frame").alias("at")), F.col("at"), 5, 60).withColumn("h", F.floor(F.col("frame") / 60))
    return A.frame_lookup(wanted, hours, ["video", "h"], "label", "o", "none").select("ord", F.col("slot").cast("long").alias("slot"), "frame", "label")


@query("""SELECT l_suppkey, l_linenumber, arg_max(l_partkey, l_orderkey * 10000 + l_partkey) AS part FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL""")
def last_position_map(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_orderkey") * 10000 + F.col("l_partkey")).withColumn("part", F.when(F.col("l_returnflag") != "N", F.col("l_partkey")))
    return A.position_map(rows, ["l_suppkey", "l_linenumber"], "part", "at")


def _videos(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.count("*").alias("n"))


VIDEOS = "WITH v AS (SELECT user_id AS video, count(*) AS n FROM events GROUP BY 1)\n"


@query(VIDEOS + """, s AS (SELECT video, n, clip, clip * 9 AS start FROM v, range(100000) r(clip) WHERE n > 1 AND clip * 9 <= n - 2)
SELECT video, clip, slot, greatest(0, least(start + slot - 4, n - 1)) AS frame FROM s, range(16) q(slot)""")
def clip_windows_clamped(spark, sf_dir):
    return A.clip_windows(_videos(spark, sf_dir), "n", 9, 16, before=4).select("video", F.col("clip").cast("long").alias("clip"), F.col("slot").cast("long").alias("slot"), "frame")


@query(VIDEOS + """, s AS (SELECT video, n, clip, CASE WHEN clip = (n - 2) // 9 THEN n - 16 ELSE clip * 9 END AS start FROM v, range(100000) r(clip) WHERE n > 1 AND clip * 9 <= n - 2)
SELECT video, clip, slot, greatest(0, least(start + slot, n - 1)) AS frame FROM s, range(16) q(slot)""")
def clip_windows_end(spark, sf_dir):
    return A.clip_windows(_videos(spark, sf_dir), "n", 9, 16, end_clip=True).select("video", F.col("clip").cast("long").alias("clip"), F.col("slot").cast("long").alias("slot"), "frame")


@query(VIDEOS + "SELECT video, -5 + 6 * k AS start FROM v, range(100000) r(k) WHERE -5 + 6 * k <= greatest(0, n - 4) - 1")
def clip_enumeration(spark, sf_dir):
    return A.clip_starts(_videos(spark, sf_dir), "n", 10, 4, 5).select("video", "start")


@query("""WITH v AS (SELECT l_orderkey AS video, l_quantity::BIGINT % 7 AS n FROM lineitem WHERE l_linenumber = 1) SELECT video, 12 * k AS start FROM v, range(3) r(k) WHERE 12 * k < greatest(0, n - 3)
UNION ALL SELECT video, -4 + 12 * k FROM v, range(3) r(k) WHERE -4 + 12 * k < n""")
def clip_enumeration_short(spark, sf_dir):
    """Videos of 0 to 6 frames, at stride 1 without padding, and at stride 2 with padding and a partial end."""
    videos = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("video"), (F.col("l_quantity").cast("long") % 7).alias("n"))
    return A.clip_starts(videos, "n", 15, 3, 0).union(A.clip_starts(videos, "n", 9, 3, 2, stride=2, partial_end=True)).select("video", "start")


@query(PREDICTIONS + """, x AS (SELECT video, ord, CASE WHEN ord % 11 = 0 THEN -200 ELSE confidence END AS x FROM pred), l AS (SELECT *, lag(x) OVER (PARTITION BY video ORDER BY ord) AS p FROM x)
SELECT ord, round(CASE WHEN x = -200 THEN -200 WHEN p IS NULL OR p = -200 THEN 0 ELSE x - p END, 6) AS dx FROM l""")
def deltas_lag(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("video", "ord", F.when(F.col("ord") % 11 == 0, -200.0).otherwise(F.col("confidence")).alias("x"))
    return A.deltas(rows, ["video"], "ord", ["x"], -200.0).select("ord", F.round("dx", 6).alias("dx"))


@query(PREDICTIONS + "SELECT video, frame + d AS frame, arg_max(label, ord) AS label FROM pred, range(-2, 3) r(d) WHERE frame + d >= 0 GROUP BY ALL")
def dilated_labels(spark, sf_dir):
    return A.frame_labels(predictions(spark, sf_dir), 2)


@query(PREDICTIONS + "SELECT video, frame, arg_max(label, ord) AS label FROM pred GROUP BY ALL")
def dense_frame_labels(spark, sf_dir):
    return A.frame_labels(predictions(spark, sf_dir))


@query(PREDICTIONS + "SELECT DISTINCT video, frame // 1440 AS clip, label FROM pred")
def tumbling_labels(spark, sf_dir):
    return A.tumbling_labels(predictions(spark, sf_dir), 1440)


#: Frames of six hours, from each user's first event to the last; every event type is a label.
SHIFTS = """WITH marks AS (SELECT user_id AS video, event_type AS label, (epoch_us(ts) // 21600000000)::BIGINT AS t FROM events),
u AS (SELECT video, min(t) AS t0, max(t) - min(t) + 1 AS frames FROM marks GROUP BY 1), e AS (SELECT DISTINCT video, label, t - t0 AS frame FROM marks JOIN u USING (video)),
g AS (SELECT video, label, frames, unnest(range(frames)) AS frame FROM u, (SELECT DISTINCT event_type AS label FROM events)), w AS (SELECT g.*, e.frame AS e FROM g LEFT JOIN e USING (video, label, frame)),
x AS (SELECT *, max(e) OVER (PARTITION BY video, label ORDER BY frame ROWS UNBOUNDED PRECEDING) AS l, min(e) OVER (PARTITION BY video, label ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r, count(e) OVER (PARTITION BY video, label) AS n FROM w),
o AS (SELECT *, frame - l AS a, frame - r AS b, coalesce(frame - l, frame + 10) AS s1, coalesce(frame - r, frame - frames - 12) AS s2 FROM x),
s AS (SELECT video, label, frame, (CASE WHEN n = 0 THEN -12 WHEN n = 1 THEN coalesce(a, b) WHEN s1 < 4 THEN s1 WHEN s1 < 10 AND s2 <= -12 THEN s1
 WHEN s1 < 10 AND (s1 - 4) / 6.0::DOUBLE < (-2 - s2) / 10.0::DOUBLE THEN s1 ELSE s2 END)::BIGINT AS shift FROM o)
"""
BOUNDS = (-12, -2, 4, 10)


def _shifts(spark, sf_dir, bounds=BOUNDS):
    quarter = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("label"), quarter.alias("t"))
    videos = events.groupBy("video").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    spots = events.join(videos, "video").select("video", "label", (F.col("t") - F.col("t0")).alias("frame"))
    labels = F.broadcast(events.select("label").distinct())  # the event types
    spine = videos.crossJoin(labels).select("video", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t1") - F.col("t0"))).alias("frame"))
    return A.shift_labels(spine, spots, bounds)


#: Other bounds for two of the labels.
OWN_BOUNDS = {"click": (-20, -3, 2, 7), "error": (-6, -1, 5, 8)}
BY_LABEL = SHIFTS[: SHIFTS.index("o AS")] + """b AS (SELECT label, CASE label WHEN 'click' THEN -20 WHEN 'error' THEN -6 ELSE -12 END AS k1, CASE label WHEN 'click' THEN -3 WHEN 'error' THEN -1 ELSE -2 END AS k2,
 CASE label WHEN 'click' THEN 2 WHEN 'error' THEN 5 ELSE 4 END AS k3, CASE label WHEN 'click' THEN 7 WHEN 'error' THEN 8 ELSE 10 END AS k4 FROM (SELECT DISTINCT event_type AS label FROM events)),
o AS (SELECT *, frame - l AS a, frame - r AS c, coalesce(frame - l, frame + k4) AS s1, coalesce(frame - r, frame - frames + k1) AS s2 FROM x JOIN b USING (label))
SELECT video, label, frame, (CASE WHEN n = 0 THEN k1 WHEN n = 1 THEN coalesce(a, c) WHEN s1 < k3 THEN s1 WHEN s1 < k4 AND s2 <= k1 THEN s1
 WHEN s1 < k4 AND (s1 - k3) / (k4 - k3)::DOUBLE < (k2 - s2) / (k2 - k1)::DOUBLE THEN s1 ELSE s2 END)::BIGINT AS shift FROM o
"""


@query(BY_LABEL)
def shift_labels_by_class(spark, sf_dir):
    kinds = [r["event_type"] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    return _shifts(spark, sf_dir, {kind: OWN_BOUNDS.get(kind, BOUNDS) for kind in kinds})


@query(SHIFTS + "SELECT * FROM s")
def shift_labels(spark, sf_dir):
    return _shifts(spark, sf_dir)


ISLANDS = SHIFTS + """, q AS (SELECT video, frame FROM s GROUP BY ALL HAVING bool_and(shift <= -2 OR shift >= 2)), r AS (SELECT *, frame - row_number() OVER (PARTITION BY video ORDER BY frame) AS run FROM q),
i AS (SELECT video, min(frame) AS start, max(frame) + 1 AS stop FROM r GROUP BY video, run HAVING count(*) >= 2)
"""


@query(ISLANDS + "SELECT * FROM i")
def negative_islands(spark, sf_dir):
    return A.quiet_islands(_shifts(spark, sf_dir), -2, 2, 2)


@query(ISLANDS + "SELECT video, label, frame AS start, frame + 1 AS stop FROM s WHERE shift = 0 UNION ALL SELECT video, 'background', start, stop FROM i")
def chunk_anchors(spark, sf_dir):
    shifts = _shifts(spark, sf_dir)
    return A.anchors(shifts, A.quiet_islands(shifts, -2, 2, 2), "background")


@query(SHIFTS + "SELECT video, slot, label, round(frame / 120.0::DOUBLE, 6) AS at FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame, label) - 1 AS slot FROM s WHERE shift = 0) WHERE slot < 5")
def anchor_targets_topn(spark, sf_dir):
    return A.timestamp_targets(_shifts(spark, sf_dir), 5, 120).withColumn("at", F.round("at", 6))


@query("""WITH c AS (SELECT user_id AS video, k, k * 12 AS start, o AS offset_, (user_id * 7 + k * 31 + o) % 97 AS value FROM (SELECT DISTINCT user_id FROM events), range(6) a(k), range(20) b(o)),
w AS (SELECT video, start, offset_, start + offset_ AS frame, value FROM c WHERE offset_ BETWEEN 4 AND 15 OR (k = 0 AND offset_ < 4) OR (k = 5 AND offset_ >= 16)) SELECT video, frame, arg_max(value, start) AS value FROM w GROUP BY ALL""")
def stitch_chunks(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"))
    # a number given keeps the few bytes of the users from being put together in one task, where each becomes 120 rows
    videos = users.repartition(task_count(spark, 120 * users.distinct().count()), "video").distinct()
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    chunks = videos.select("video", number(6).alias("k")).select("video", "k", number(20).alias("offset"))
    chunks = chunks.select("video", (F.col("k") * 12).alias("start"), "offset", ((F.col("video") * 7 + F.col("k") * 31 + F.col("offset")) % 97).alias("value"))
    return A.stitch(chunks, 20, 4)


#: Users as games: odd events in the second half, a half ends a day before its last event, every third event is not shown.
HALVES = """WITH l AS (SELECT user_id AS game, event_id AS ord, event_type AS label, (event_id % 2 + 1)::INTEGER AS half, (epoch_us(ts) // 60000000)::BIGINT AS t, event_id % 3 > 0 AS visible FROM events),
z AS (SELECT *, t - min(t) OVER (PARTITION BY game, half) AS frame FROM l), n AS (SELECT game, half, max(frame) - 1440 AS frames FROM z GROUP BY ALL)
"""


def _halves(spark, sf_dir):
    minute, half = F.floor(micros() / 60_000_000).cast("long"), (F.col("event_id") % 2 + 1).cast("int")
    labels = table(spark, sf_dir, "events").select(F.col("user_id").alias("game"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"), half.alias("half"), minute.alias("t"), (F.col("event_id") % 3 > 0).alias("visible"))
    first = labels.groupBy("game", "half").agg(F.min("t").alias("t0"), (F.max("t") - F.min("t") - 1440).alias("frames"))
    return labels.join(first, ["game", "half"]).withColumn("frame", F.col("t") - F.col("t0")).drop("frames", "t", "t0"), first.select("game", "half", "frames")


@query(HALVES + """SELECT game, half, frame, label, arg_max(CASE WHEN visible THEN 1 ELSE -1 END, ord)::INTEGER AS value FROM (SELECT game, half, label, ord, visible, least(frame, frames - 1) AS frame FROM z JOIN n USING (game, half) WHERE frames > 0) GROUP BY ALL""")
def half_frame_labels(spark, sf_dir):
    return games.half_frame_labels(*_halves(spark, sf_dir))


@query(HALVES + """, c AS (SELECT game, half, unnest(range(ceil((frames - 1) / 720.0)::BIGINT)) AS clip FROM n WHERE frames > 1)
SELECT DISTINCT game, half, clip, coalesce(z.label, 'background') AS label FROM c LEFT JOIN (SELECT game, half, frame // 720 AS clip, label FROM z) z USING (game, half, clip)""")
def half_clip_labels(spark, sf_dir):
    return games.half_clip_labels(*_halves(spark, sf_dir), 720)
