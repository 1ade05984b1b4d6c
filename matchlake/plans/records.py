"""Queries of record operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import records as R
from ..sources import datasets
from .base import PREDICTIONS, predictions, query, table


@query("""SELECT l_orderkey, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_custkey::VARCHAR END AS customer, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority ELSE '' END AS kind,
count(*) AS n_players, sum(l_quantity)::BIGINT AS sum_x, count(*) FILTER (l_linenumber IN (1, 2)) AS known FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def flat_frames(spark, sf_dir):
    """Orders as frames: lines are players, the line number their jersey."""
    player = F.struct(F.col("l_linenumber").cast("int").alias("jersey"), F.col("l_quantity").alias("x"))
    players = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(player).alias("players"))
    orders = table(spark, sf_dir, "orders")
    game = F.when(F.col("o_orderstatus") != "O", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))).alias("game_event")
    possession = F.when(F.col("o_orderpriority").startswith("1"), F.struct(F.col("o_orderpriority").alias("kind"))).alias("possession")
    frames = orders.join(players, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", game, possession, "players", (F.col("o_orderkey") % 2).alias("game"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    squad = lines.select((F.col("l_orderkey") % 2).alias("game"), F.lit("home").alias("team"), F.col("l_linenumber").cast("int").alias("jersey"), F.lit("GK").alias("position")).distinct()
    flat = R.flat_frames(R.with_positions(frames, "players", F.lit("home"), squad), ["l_orderkey"], "game_event", ["status", "customer"], "possession", "kind", ["players"])
    read = F.from_json("players", "array<struct<jersey: int, x: double, position: string>>")
    total = F.aggregate(read, F.lit(0.0), lambda s, p: s + p["x"]).cast("long")
    return flat.select("l_orderkey", "status", "customer", "kind", F.size(read).cast("long").alias("n_players"), total.alias("sum_x"), F.size(F.filter(read, lambda p: p["position"] == "GK")).cast("long").alias("known"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 WHEN event_id % 3 = 1 THEN -1 ELSE user_id END::INT AS number, CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS flag, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS name FROM events""")
def coerced_types(spark, sf_dir):
    number = F.when(F.col("event_id") % 3 == 1, "n/a").when(F.col("event_id") % 3 == 2, F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", number.alias("number"), (F.col("event_id") % 2 == 0).alias("flag"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("name"))
    return R.coerced(rows, ["number", "event_id"], []).withColumn("event_id", F.col("event_id").cast("long"))


@query("SELECT event_id, (CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN 2 END)::INT AS class FROM events WHERE event_type IN ('click', 'signup', 'error')")
def coarse_labels(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "y-card").when(F.col("event_type") == "signup", "subs-in").when(F.col("event_type") == "error", "soccer-ball").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", R.coarse_label(name).alias("class")).where("class is not null")


CLIPS = PREDICTIONS + """, c AS (SELECT video, count(*) AS n_clips FROM pred GROUP BY video), l AS (SELECT DISTINCT pred.video, frame % 40000 // 480 AS clip, label FROM pred JOIN c ON c.video = pred.video WHERE frame % 40000 // 480 < n_clips)
"""


def _clips(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("frame", F.col("frame") % 40000)
    clips = rows.groupBy("video").agg(F.count("*").alias("n_clips"))
    return R.clip_labels(rows, clips, "frame", 480), clips


@query(CLIPS + "SELECT * FROM l")
def clip_labels(spark, sf_dir):
    return _clips(spark, sf_dir)[0]


@query(CLIPS + ", e AS (SELECT video, unnest(range(n_clips)) AS clip FROM c) SELECT e.video, e.clip, count(l.label) AS n_labels, count(l.label) > 0 AS has_event FROM e LEFT JOIN l ON l.video = e.video AND l.clip = e.clip GROUP BY ALL")
def clips_with_events(spark, sf_dir):
    return R.clips_with_events(*_clips(spark, sf_dir))


@query("""WITH v AS (SELECT user_id AS video, greatest(1, ceil((count(*) - 4) / 6.0))::BIGINT AS n FROM events GROUP BY 1), p AS (SELECT video, n, unnest(range((ceil(n / 8.0) * 8)::BIGINT)) AS place FROM v)
SELECT video, place, 1 + least(place, n - 1) * 6 AS start FROM p""")
def filled_clips(spark, sf_dir):
    return R.filled_clips(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.count("*").alias("n")), "n", 10, 4, 8)


@query("SELECT p_name || p_partkey AS path, p_size // 3 AS frames, round(p_retailprice / 3, 6) AS fps FROM part")
def videos_at_stride(spark, sf_dir):
    videos = table(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("path"), F.col("p_size").alias("frames"), F.col("p_retailprice").alias("fps"))
    return R.videos_at_stride(videos, 3).withColumn("fps", F.round("fps", 6))


@query(PREDICTIONS + ", v AS (SELECT video, max(frame) - 7200 AS frames FROM pred GROUP BY video) SELECT pred.video, frame FROM pred JOIN v ON v.video = pred.video WHERE frame < frames")
def foreground_events(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return R.foreground(rows, rows.groupBy("video").agg((F.max("frame") - 7200).alias("frames")))


@query("""SELECT c_mktsegment AS split, count(*) AS n_videos, count(*) FILTER (c_custkey % 3 <> 0) AS n_annotated, min(c_name) AS first FROM customer GROUP BY 1""")
def split_manifests(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    games = customers.select(F.col("c_name").alias("game"), F.col("c_mktsegment").alias("split"), F.concat("c_name", F.lit(".mp4")).alias("path"))
    found = R.split_manifests(games, customers.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("game"), F.concat("c_name", F.lit(".json")).alias("path")), "video")
    read = F.from_json("manifest", "videos array<struct<id: string, annotations: string>>")["videos"]
    return found.select("split", F.size(read).cast("long").alias("n_videos"), F.size(F.filter(read, lambda v: v["annotations"].isNotNull())).cast("long").alias("n_annotated"), read[0]["id"].alias("first"))


@query("SELECT s_suppkey, trim(s_name) AS repository, CASE WHEN s_nationkey % 2 = 0 THEN 'main' ELSE '' END AS branch, s_name AS other FROM supplier")
def stamped_headers(spark, sf_dir):
    header = F.create_map(F.lit("hf_repo_id"), F.lit("old"), F.lit("name"), F.col("s_name"))
    mark = R.stamped(header, F.concat(F.lit(" "), "s_name", F.lit(" ")), F.when(F.col("s_nationkey") % 2 == 0, "main"), F.lit("train"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", mark["hf_repo_id"].alias("repository"), mark["hf_branch"].alias("branch"), mark["name"].alias("other"))


@query("SELECT p_partkey, (contains(lower(p_name), 'a') AND contains(lower(p_name), 'e')) OR contains(lower(p_name), 'o') AS hit FROM part")
def error_predicates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.says(F.col("p_name"), ("A", "e"), ("O",)).alias("hit"))


@query(PREDICTIONS + """SELECT ord, CASE WHEN ord % 7 = 0 THEN -200 WHEN ord % 2 = 0 THEN -confidence ELSE confidence END AS y, ord % 3 = 0 AS away FROM pred""")
def vertical_and_team_flip(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    y = G.flipped(F.when(F.col("ord") % 7 == 0, -200.0).otherwise(F.col("confidence")), -200.0, F.col("ord") % 2 == 0)
    sides = R.team_flipped(F.array(F.struct((F.col("ord") % 3 == 0).alias("home"), F.lit(False).alias("away"))))
    return rows.select("ord", y.alias("y"), sides[0]["away"].alias("away"))


@query(PREDICTIONS + """SELECT ord, (1 + ord % 2)::VARCHAR || ' - ' || lpad((position_ms % 5400000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((position_ms % 5400000 // 1000 % 60)::VARCHAR, 2, '0') AS clock, (position_ms % 5400000)::VARCHAR AS position FROM pred""")
def prediction_records(spark, sf_dir):
    record = R.prediction_record(1 + F.col("ord") % 2, F.col("position_ms") % 5_400_000, F.col("label"), F.col("confidence"))
    return predictions(spark, sf_dir).select("ord", record["gameTime"].alias("clock"), record["position"].alias("position"))


@query(PREDICTIONS + """, s AS (SELECT ord, label, confidence, frame % 90000 AS f, (frame % 90000) // 25 AS s, 1 + ord % 2 AS h FROM pred), c AS (SELECT *, lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM s)
SELECT ord, clock AS plain, h || ' - ' || clock AS padded, h || ' - ' || (s // 60) || ':' || (s % 60) AS short, h::VARCHAR AS half, label, trunc((f / 25.0::DOUBLE) * 1000)::BIGINT AS position, confidence FROM c""")
def spotting_records(spark, sf_dir):
    frame, half = F.col("frame") % 90_000, 1 + F.col("ord") % 2
    made = lambda *more: R.spotting_record(frame, F.lit(25), F.col("label"), F.col("confidence"), *more)
    rows = predictions(spark, sf_dir).select("ord", made().alias("a"), made(half).alias("b"), made(half, False).alias("c"))
    return rows.select("ord", F.col("a.gameTime").alias("plain"), F.col("b.gameTime").alias("padded"), F.col("c.gameTime").alias("short"), "c.half", "a.label", "b.position", "c.confidence")


@query("""SELECT c_custkey::VARCHAR AS game_id, c_mktsegment AS split, 'videos/' || c_custkey || '.mp4' AS path, 25.0::DOUBLE AS fps, n, first, last FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def manifest_entries(spark, sf_dir):
    """Customers as games, their orders as annotations; entries read back whole."""
    games = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("game_id"), F.col("c_mktsegment").alias("split"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("game_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("position"))
    entry = F.from_json("entry", "path string, source_fps double, gameId string, annotations array<struct<position: long>>")
    read = datasets.manifest_entries(games, notes, "mp4", 25.0).select("split", entry.alias("e"))
    positions = F.transform("e.annotations", lambda a: a["position"])
    return read.select(F.col("e.gameId").alias("game_id"), "split", "e.path", F.col("e.source_fps").alias("fps"), F.when(F.col("e.annotations").isNotNull(), F.size(positions)).cast("long").alias("n"), F.try_element_at(positions, F.lit(1)).alias("first"), F.try_element_at(positions, F.lit(-1)).alias("last"))
