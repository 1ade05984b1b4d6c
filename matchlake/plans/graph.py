"""Queries of frame graphs, neighbours, pooling and normalisation. Lines of an order stand for the nodes of a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .base import query, table, task_count

NODES = """WITH n AS (SELECT l_orderkey % 500 AS clip, l_orderkey AS frame, l_linenumber::BIGINT AS slot, l_quantity AS x, l_extendedprice / 1000 AS y, l_suppkey % 2 AS team FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)
, p AS (SELECT a.clip, a.frame, a.slot AS src, b.slot AS dst, b.team AS bt, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM n a JOIN n b ON a.clip = b.clip AND a.frame = b.frame AND a.slot <> b.slot)
"""


def _nodes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    # dealt by frames once, in as many parts as the lines need; what is made of a frame stays in its part
    dealt = lines.select((F.col("l_orderkey") % 500).alias("clip"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("slot"), "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey").repartition(task_count(spark, lines.count()), *G.KEYS)
    rows = dealt.groupBy(*G.KEYS, "slot").agg(F.min_by(F.struct("l_quantity", "l_extendedprice", "l_suppkey"), F.struct("l_partkey", "l_suppkey")).alias("m"))
    return rows.select(*G.KEYS, "slot", F.col("m.l_quantity").alias("x"), (F.col("m.l_extendedprice") / 1000).alias("y"), (F.col("m.l_suppkey") % 2).alias("team"))


@query(NODES + "SELECT clip, frame, src, dst FROM p")
def full_edges(spark, sf_dir):
    return G.full_edges(_nodes(spark, sf_dir))


@query(NODES + "SELECT clip, frame, src, dst FROM p WHERE d <= 10")
def distance_edges(spark, sf_dir):
    return G.distance_edges(_nodes(spark, sf_dir), 10.0)


@query(NODES + ", k AS (SELECT *, row_number() OVER (PARTITION BY clip, frame, src ORDER BY d, dst) AS r FROM p) SELECT clip, frame, src, dst FROM k WHERE r <= 2 UNION SELECT clip, frame, dst, src FROM k WHERE r <= 2")
def knn_edges(spark, sf_dir):
    return G.knn_edges(_nodes(spark, sf_dir), 2)


@query(NODES + """, k AS (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY d, dst) AS r FROM p WHERE src = 1), s AS (SELECT clip, frame, dst, bt FROM k WHERE r <= 3)
SELECT clip, frame, 1::BIGINT AS src, dst FROM s UNION SELECT clip, frame, dst, 1 FROM s UNION SELECT a.clip, a.frame, a.dst, b.dst FROM s a JOIN s b ON a.clip = b.clip AND a.frame = b.frame AND a.bt = b.bt AND a.dst <> b.dst""")
def ball_knn_edges(spark, sf_dir):
    return G.ball_edges(_nodes(spark, sf_dir), 1, k=3)


@query(NODES + """, s AS (SELECT clip, frame, dst, bt FROM p WHERE src = 1 AND d <= 20)
SELECT clip, frame, 1::BIGINT AS src, dst FROM s UNION SELECT clip, frame, dst, 1 FROM s UNION SELECT a.clip, a.frame, a.dst, b.dst FROM s a JOIN s b ON a.clip = b.clip AND a.frame = b.frame AND a.bt = b.bt AND a.dst <> b.dst""")
def ball_distance_edges(spark, sf_dir):
    return G.ball_edges(_nodes(spark, sf_dir), 1, radius=20.0)


@query(NODES + """, q AS (SELECT *, slot % 4 AS line FROM n WHERE slot <> 1)
SELECT a.clip, a.frame, a.slot AS src, b.slot AS dst FROM q a JOIN q b ON a.clip = b.clip AND a.frame = b.frame AND a.team = b.team AND a.slot <> b.slot AND (abs(a.line - b.line) = 1 OR (a.line = b.line AND a.line > 0))
UNION SELECT q.clip, q.frame, 1, q.slot FROM q JOIN n b ON b.clip = q.clip AND b.frame = q.frame AND b.slot = 1 UNION SELECT q.clip, q.frame, q.slot, 1 FROM q JOIN n b ON b.clip = q.clip AND b.frame = q.frame AND b.slot = 1""")
def line_edges(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumn("line", F.col("slot") % 4)
    return G.line_edges(nodes, "line", [(0, 1), (1, 2), (2, 3), (1, 1), (2, 2), (3, 3)], 1)


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS v FROM embeddings), d AS (SELECT a.id, b.id AS neighbour, array_distance(a.v, b.v) AS d FROM e a, e b WHERE a.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM d) SELECT id, neighbour, rank FROM r WHERE rank <= 8""")
def feature_knn(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return G.feature_knn(points.where("id % 50 = 0"), points, 8).select("id", "neighbour", F.col("rank").cast("long").alias("rank"))


@query("SELECT label, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 5) AS value FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def pool_mean(spark, sf_dir):
    return G.pooled(table(spark, sf_dir, "embeddings"), ["label"], "embedding", "mean").select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 5).alias("value"))


@query("SELECT label, vec_id % 2 AS half, i - 1 AS dim, max(embedding[i]::DOUBLE) AS value FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def pool_max_halves(spark, sf_dir):
    return G.pooled(table(spark, sf_dir, "embeddings").withColumn("half", F.col("vec_id") % 2), ["label", "half"], "embedding", "max").withColumn("dim", F.col("dim").cast("long"))


@query("""WITH u AS (SELECT label, vec_id, i - 1 AS dim, embedding[i] AS v FROM embeddings, range(1, 65) r(i))
SELECT label, vec_id, dim, round(CASE WHEN dim < 8 THEN coalesce(lead(v) OVER w, 0) WHEN dim < 16 THEN coalesce(lag(v) OVER w, 0) ELSE v END::DOUBLE, 5) AS value FROM u WINDOW w AS (PARTITION BY label, dim ORDER BY vec_id)""")
def temporal_shift(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return G.shifted_channels(rows, ["label"], "vec_id", "embedding", 8).select("label", "vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 5).alias("value"))


@query("SELECT event_id, round(CASE WHEN event_id % 9 = 0 THEN -2 ELSE value / 52.5 END::DOUBLE, 6) AS x FROM events")
def normalize_sentinel(spark, sf_dir):
    raw = F.when(F.col("event_id") % 9 == 0, -200.0).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.round(G.normalised(raw, 52.5, -200.0, -2.0), 6).alias("x"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -200 WHEN user_id % 2 = 0 THEN -value ELSE value END AS x FROM events")
def horizontal_flip(spark, sf_dir):
    raw = F.when(F.col("event_id") % 9 == 0, -200.0).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", G.flipped(raw, -200.0, F.col("user_id") % 2 == 0).alias("x"))


@query("""SELECT l_orderkey, l_linenumber, slot FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS slot FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)) WHERE slot <= 4""")
def player_slots(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    frames = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("jersey")))).alias("players"))
    return frames.select("l_orderkey", F.explode(G.slots_of(F.col("players"), 1, 4)).alias("s")).select("l_orderkey", F.col("s.p.l_linenumber").alias("l_linenumber"), F.col("s.slot").cast("long").alias("slot"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS v FROM embeddings), d AS (SELECT a.id, b.id AS neighbour, a.v AS own, b.v AS theirs, array_distance(a.v, b.v) AS d FROM e a, e b WHERE a.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM d) SELECT id, rank, i - 1 AS dim, round(CASE WHEN i <= 64 THEN theirs[i] - own[i] ELSE own[i - 64] END, 6) AS x FROM r, range(1, 129) q(i) WHERE rank <= 4""")
def neighbour_features(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    gathered = G.neighbour_features(G.feature_knn(points.where("id % 50 = 0"), points, 4), points)
    return gathered.select("id", F.col("rank").cast("long").alias("rank"), F.posexplode("feature").alias("dim", "x")).select("id", "rank", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("""WITH s AS (SELECT vec_id % 40 AS clip, embedding::DOUBLE[] AS v, exp(4 * embedding[1]::DOUBLE) AS w FROM embeddings)
SELECT clip, i - 1 AS dim, round(sum(w * v[i]) / sum(w), 5) AS value FROM s, range(1, 65) r(i) GROUP BY ALL""")
def attention_pool(spark, sf_dir):
    views = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("clip"), F.col("embedding").cast("array<double>").alias("v")).withColumn("score", 4 * F.col("v")[0])
    return G.attention_pooled(views, ["clip"], "v", "score").select("clip", F.col("dim").cast("long").alias("dim"), F.round("value", 5).alias("value"))


@query("""WITH e AS (SELECT vec_id, vec_id % 20 AS clip, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), c AS (SELECT label AS centre, i, avg(x) AS c FROM e GROUP BY ALL),
a AS (SELECT vec_id, clip, centre, exp(8 * sum(x * c) - 4 * sum(c * c)) AS a FROM e JOIN c USING (i) GROUP BY ALL), s AS (SELECT *, a / sum(a) OVER (PARTITION BY vec_id) AS p FROM a),
v AS (SELECT s.clip, centre, i, sum(p * (x - c)) AS x FROM s JOIN e USING (vec_id) JOIN c USING (centre, i) GROUP BY ALL), n AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY clip, centre)) AS y FROM v)
SELECT clip, centre, i - 1 AS dim, round(y / sqrt(sum(y * y) OVER (PARTITION BY clip)), 5) AS value FROM n""")
def vlad_pool(spark, sf_dir):
    """Centres are the labels' means."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("clip"), "label", F.col("embedding").cast("array<double>").alias("v"))
    means = G.pooled(rows, ["label"], "v", "mean").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("c"))
    centres = means.select(F.col("label").alias("centre"), F.transform("c", lambda x: 8 * x).alias("w"), (-4 * F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)).alias("b"), "c")
    return G.vlad_pooled(rows, ["clip"], "v", centres).select("clip", "centre", F.col("dim").cast("long").alias("dim"), F.round("value", 5).alias("value"))
