"""Queries of suppression, matching and spotting metrics. One event in five is taken as truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spotting as S
from .base import PREDICTIONS, predictions, query, table

WINDOW = 720


def _both(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.where(F.col("ord") % 5 != 0).withColumn("confidence", F.col("confidence") / 500), rows.where(F.col("ord") % 5 == 0)


@query(PREDICTIONS + """, s AS (SELECT *, max(confidence) OVER (PARTITION BY video, label ORDER BY frame RANGE BETWEEN 720 PRECEDING AND 1 PRECEDING) AS a,
 max(confidence) OVER (PARTITION BY video, label ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND 720 FOLLOWING) AS b FROM pred)
SELECT label, count(*) AS kept FROM s WHERE confidence >= coalesce(greatest(a, b), confidence) GROUP BY label""")
def nms_window(spark, sf_dir):
    return S.suppress_window(predictions(spark, sf_dir), WINDOW, "video", "label").groupBy("label").agg(F.count("*").alias("kept"))


@query(PREDICTIONS + """SELECT p.ord FROM pred p WHERE NOT EXISTS (SELECT 1 FROM pred q WHERE q.video = p.video AND q.label = p.label AND q.frame <> p.frame AND abs(q.frame - p.frame) <= 2880 AND q.confidence > p.confidence)""")
def nms_survivors(spark, sf_dir):
    return S.suppress_window(predictions(spark, sf_dir), 2880, "video", "label").select("ord")


@query(PREDICTIONS + """, l AS (SELECT video, list(struct_pack(c := confidence, f := frame, o := ord) ORDER BY confidence DESC, frame, ord) AS x FROM pred WHERE confidence >= 5 GROUP BY video),
g AS (SELECT video, list_reduce(list_transform(x, lambda e: [e]), lambda a, e: CASE WHEN len(list_filter(a, lambda k: e[1].f >= k.f - 720 AND e[1].f < k.f + 720)) > 0 THEN a ELSE list_concat(a, e) END) AS k FROM l)
SELECT video, unnest(k).o AS ord FROM g""")
def greedy_nms(spark, sf_dir):
    return S.suppress_greedy(predictions(spark, sf_dir), 1440, 5.0, "video").select("video", "ord")


#: Matching in order, as a fold over each (video, label): the first element holds what is free, the others one taker each.
FOLDED = """, sides AS (SELECT video, label, tol, list(struct_pack(f := frame, o := ord, c := confidence) ORDER BY {order}) FILTER ({taker}) AS takers,
 list(struct_pack(f := frame, o := ord, c := confidence) ORDER BY frame, ord) FILTER ({good}) AS goods FROM pred, (VALUES {tolerances}) t(tol) GROUP BY ALL),
folds AS (SELECT video, label, tol, list_concat([struct_pack(free := goods, took := []::BIGINT[], gave := []::BIGINT[], p := takers[1])], list_transform(takers, lambda t: struct_pack(free := goods[1:0], took := []::BIGINT[], gave := []::BIGINT[], p := t))) AS x FROM sides WHERE takers IS NOT NULL AND goods IS NOT NULL),
ends AS (SELECT video, label, tol, list_reduce(x, lambda a, e: list_transform([list_min(list_transform(list_filter(a.free, lambda t: abs(t.f - e.p.f) <= tol), lambda t: struct_pack(d := {rank}, f := {tie}, o := t.o)))],
 lambda b: CASE WHEN b IS NULL THEN a ELSE struct_pack(free := list_filter(a.free, lambda t: t.o <> b.o), took := list_append(a.took, e.p.o), gave := list_append(a.gave, b.o), p := a.p) END)[1]) AS z FROM folds)
"""
NEAREST = PREDICTIONS + FOLDED.format(order="confidence DESC, ord", taker="ord % 5 <> 0", good="ord % 5 = 0", tolerances="(60), (240), (720)", rank="abs(t.f - e.p.f)", tie="0")
STRONGEST = PREDICTIONS + FOLDED.format(order="frame, ord", taker="ord % 5 = 0", good="ord % 5 <> 0", tolerances="(240)", rank="-t.c", tie="t.f")


@query(NEAREST + "SELECT ord, EXISTS (SELECT 1 FROM (SELECT unnest(z.took) AS o FROM ends WHERE tol = 240) h WHERE h.o = ord) AS hit FROM pred WHERE ord % 5 <> 0")
def match_nearest(spark, sf_dir):
    pred, truth = _both(spark, sf_dir)
    return S.match_nearest(pred, truth, 240).select("ord", "hit")


@query(STRONGEST + "SELECT ord, EXISTS (SELECT 1 FROM (SELECT unnest(z.gave) AS o FROM ends) h WHERE h.o = ord) AS hit FROM pred WHERE ord % 5 <> 0")
def match_strongest(spark, sf_dir):
    pred, truth = _both(spark, sf_dir)
    return S.match_strongest(pred, truth, 480.0).select("ord", "hit")


@query(PREDICTIONS + """, r AS (SELECT label, ord % 3 = 0 AS hit, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, ord) AS rank FROM pred WHERE ord % 5 <> 0),
h AS (SELECT label, rank, row_number() OVER (PARTITION BY label ORDER BY rank) / rank::DOUBLE AS p FROM r WHERE hit),
m AS (SELECT label, max(p) OVER (PARTITION BY label ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM h),
t AS (SELECT label, count(*) AS n FROM pred WHERE ord % 5 = 0 GROUP BY label)
SELECT label, round(coalesce((SELECT sum(p) FROM m WHERE m.label = t.label), 0) / n, 6) AS ap FROM t""")
def ap_interpolated(spark, sf_dir):
    pred, truth = _both(spark, sf_dir)
    matched = pred.withColumn("hit", F.col("ord") % 3 == 0)
    return S.average_precision(matched, truth, [F.desc("confidence"), F.col("ord")]).select("label", F.round("ap", 6).alias("ap"))


@query(NEAREST + """, hits AS (SELECT tol, unnest(z.took) AS ord FROM ends),
r AS (SELECT t.tol, label, h.ord IS NOT NULL AS hit, row_number() OVER (PARTITION BY t.tol, label ORDER BY confidence DESC, p.ord) AS rank FROM pred p CROSS JOIN (VALUES (60), (240), (720)) t(tol) LEFT JOIN hits h ON h.tol = t.tol AND h.ord = p.ord WHERE p.ord % 5 <> 0),
h AS (SELECT tol, label, rank, row_number() OVER (PARTITION BY tol, label ORDER BY rank) / rank::DOUBLE AS p FROM r WHERE hit),
m AS (SELECT tol, label, max(p) OVER (PARTITION BY tol, label ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM h),
n AS (SELECT label, count(*) AS n FROM pred WHERE ord % 5 = 0 GROUP BY label),
s AS (SELECT t.tol, n.label, coalesce((SELECT sum(p) FROM m WHERE m.label = n.label AND m.tol = t.tol), 0) / n AS ap FROM n, (VALUES (60), (240), (720)) t(tol))
SELECT tol AS tolerance, round(avg(ap), 6) AS mean_ap FROM s GROUP BY tol""")
def ap_e2e(spark, sf_dir):
    pred, truth = _both(spark, sf_dir)
    return S.mean_average_precision(pred, truth, [60, 240, 720]).select("tolerance", F.round("mean_ap", 6).alias("mean_ap"))


PR_SQL = PREDICTIONS + """, m AS (SELECT label, confidence / 500 AS c, ord % 3 = 0 AS hit FROM pred WHERE ord % 5 <> 0), t AS (SELECT label, count(*) AS truths FROM pred WHERE ord % 5 = 0 GROUP BY label),
g AS (SELECT label, truths, k FROM t, range(200) r(k)), s AS (SELECT g.label, k, truths, (SELECT count(*) FROM m WHERE m.label = g.label AND floor(m.c * 199 + 1e-9) >= k) AS n, (SELECT count(*) FROM m WHERE m.label = g.label AND hit AND floor(m.c * 199 + 1e-9) >= k) AS tp FROM g),
curve AS (SELECT label, k / 199.0::DOUBLE AS threshold, coalesce(tp::DOUBLE / nullif(n, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(truths, 0), 0) AS recall FROM s)
"""


def _curve(spark, sf_dir):
    pred, truth = _both(spark, sf_dir)
    return S.precision_recall(pred.withColumn("hit", F.col("ord") % 3 == 0), truth)


@query(PR_SQL + "SELECT label, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve")
def pr_thresholds(spark, sf_dir):
    return _curve(spark, sf_dir).select("label", *[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall")])


@query(PR_SQL + "SELECT label, round(sum(p) / 11, 6) AS ap FROM (SELECT label, j, coalesce(max(precision) FILTER (recall >= j / 10.0::DOUBLE), 0) AS p FROM curve, range(11) r(j) GROUP BY label, j) GROUP BY label")
def map_11pt(spark, sf_dir):
    return S.eleven_points(_curve(spark, sf_dir)).select("label", F.round("ap", 6).alias("ap"))


@query(PREDICTIONS + """, y AS (SELECT label, video, avg(confidence) AS y FROM pred GROUP BY label, video), z AS (SELECT label, y, (y + lead(y) OVER (PARTITION BY label ORDER BY video)) / 2 AS p FROM y)
SELECT label, round(coalesce(avg(p), min(y)), 6) AS area FROM z GROUP BY label""")
def trapezoid_amap(spark, sf_dir):
    means = predictions(spark, sf_dir).groupBy("label", "video").agg(F.avg("confidence").alias("y"))
    return S.trapezoid_mean(means, "label", "video", "y").select("label", F.round("area", 6).alias("area"))


CLASSES = ["click", "error", "purchase", "signup", "view"]

#: Cells of predictions and truths: the last row of each (video, label, frame); deltas are of 120 frames a second of tolerance.
CELLS = """WITH e AS (SELECT user_id::BIGINT AS video, event_type AS label, (epoch_us(ts) // 60000000)::BIGINT AS frame, value::DOUBLE / 500 AS c, event_id::BIGINT AS o FROM events),
pred AS (SELECT video, label, frame, coalesce(arg_max(c, o), -1) AS confidence, frame * 10 + 1 AS ord, false AS visible FROM e WHERE o % 5 <> 0 GROUP BY ALL
 UNION ALL SELECT video, label, frame, 0, frame * 10, max(o) % 3 <> 0 FROM e WHERE o % 5 = 0 GROUP BY ALL)
"""
SCORED = CELLS + FOLDED.format(order="frame, ord", taker="ord % 10 = 0", good="ord % 10 = 1", tolerances="(60), (120), (180), (240), (300)", rank="-t.c", tie="t.f") + """, hits AS (SELECT tol, video, label, unnest(z.gave) AS ord FROM ends),
s AS (SELECT video, label, frame AS event, visible, floor((lag(frame) OVER (PARTITION BY video, label ORDER BY frame) + frame) / 2)::BIGINT AS f FROM pred WHERE ord % 10 = 0),
k AS (SELECT p.*, coalesce((SELECT arg_max(s.visible, event) FROM s WHERE s.video = p.video AND s.label = p.label AND coalesce(f, -1000) <= p.frame), false) AS shown FROM pred p WHERE ord % 10 = 1 AND confidence >= 0),
m AS (SELECT t.tol, k.label, unnest(['any', CASE WHEN shown THEN 'visible' ELSE 'unshown' END]) AS kind, least(floor(confidence * 199 + 1e-9), 199)::BIGINT AS step, (h.ord IS NOT NULL)::INT AS hit
 FROM k CROSS JOIN (VALUES (60), (120), (180), (240), (300)) t(tol) LEFT JOIN hits h ON h.tol = t.tol AND h.video = k.video AND h.label = k.label AND h.ord = k.ord),
n AS (SELECT tol, label, kind, step, count(*) AS n, sum(hit) AS tp FROM m GROUP BY ALL),
g AS (SELECT tol, label, kind, step, (SELECT count(*) FROM pred p WHERE p.ord % 10 = 0 AND p.label = l.label AND (kind = 'any' OR p.visible = (kind = 'visible'))) AS truths
 FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) l(label), (VALUES (60), (120), (180), (240), (300)) t(tol), (VALUES ('any'), ('visible'), ('unshown')) q(kind), range(200) r(step)),
c AS (SELECT g.*, sum(coalesce(n, 0)) OVER w AS n, sum(coalesce(tp, 0)) OVER w AS tp FROM g LEFT JOIN n USING (tol, label, kind, step) WINDOW w AS (PARTITION BY g.tol, g.label, g.kind ORDER BY g.step DESC)),
curve AS (SELECT tol, label, kind, coalesce(tp::DOUBLE / nullif(n, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(truths, 0), 0) AS recall FROM c),
ap AS (SELECT tol, label, kind, sum(p) / 11 AS ap FROM (SELECT tol, label, kind, j, coalesce(max(precision) FILTER (recall >= j / 10.0::DOUBLE), 0) AS p FROM curve, range(11) r(j) GROUP BY ALL) GROUP BY ALL),
rows AS (SELECT * FROM ap UNION ALL SELECT tol, 'Average mAP', kind, avg(ap) FROM ap GROUP BY tol, kind),
parts AS (SELECT label, kind, (ap + lead(ap) OVER (PARTITION BY label, kind ORDER BY tol)) / 2 AS p FROM rows),
area AS (SELECT label, kind, avg(p) * CASE WHEN label = 'Average mAP' AND kind = 'unshown' THEN 17 / 13.0::DOUBLE ELSE 1 END AS a FROM parts GROUP BY label, kind)
"""


@query(SCORED + """SELECT label, round(max(a) FILTER (kind = 'any'), 6) AS "any", round(max(a) FILTER (kind = 'visible'), 6) AS visible, round(max(a) FILTER (kind = 'unshown'), 6) AS unshown FROM area GROUP BY label""")
def spotting_performances(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    cells = S.dense_grid(rows.where("ord % 5 <> 0"), F.col("frame"), F.col("confidence") / 500, 1 << 40)
    pred = cells.select("video", "label", "frame", F.coalesce("value", F.lit(-1.0)).alias("confidence"), F.col("frame").alias("ord"))
    truth = S.dense_grid(rows.where("ord % 5 = 0"), F.col("frame"), F.col("ord"), 1 << 40).select("video", "label", "frame", F.col("frame").alias("ord"), (F.col("value") % 3 != 0).alias("visible"))
    found = S.performances(pred, truth, "tight", CLASSES, fps=120)
    return found.select("label", *[F.round(k, 6).alias(k) for k in S.KINDS])


AVERAGES = PREDICTIONS + """, a AS (SELECT video, frame // 1440 AS frame, label, avg(confidence) AS score, count(*) AS support FROM pred GROUP BY ALL)
"""


def _averages(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return S.frame_averages(rows.select("video", F.floor(F.col("frame") / 1440).alias("frame"), "label", F.col("confidence").alias("score")))


@query(AVERAGES + "SELECT video, frame, label, round(score, 6) AS score, support FROM a")
def frame_average(spark, sf_dir):
    return _averages(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(AVERAGES + """SELECT video, frame, label, round(score, 6) AS score, (frame * 86400 // 60)::VARCHAR || ':00' AS game_time
FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY score DESC, label) AS r FROM a) WHERE r = 1 AND label <> 'view'""")
def frame_argmax(spark, sf_dir):
    minutes = F.floor(F.col("frame") * 86400 / 60).cast("string")
    best = S.frame_classes(_averages(spark, sf_dir)).where("label <> 'view'")
    return best.select("video", "frame", "label", F.round("score", 6).alias("score"), F.concat(minutes, F.lit(":00")).alias("game_time"))


@query(PREDICTIONS + "SELECT video, ord, lpad((position_ms // 1000 % 6000 // 60)::VARCHAR, 2, '0') || ':' || lpad((position_ms // 1000 % 60)::VARCHAR, 2, '0') AS game_time FROM pred")
def game_times(spark, sf_dir):
    return predictions(spark, sf_dir).select("video", "ord", S.game_time(F.col("position_ms") % 6_000_000).alias("game_time"))


@query(PREDICTIONS + "SELECT label, round(avg((confidence > 50)::INT), 6) AS error FROM pred GROUP BY label")
def error_stat(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("label").agg(F.round(F.avg((F.col("confidence") > 50).cast("int")), 6).alias("error"))


@query("""WITH s AS (SELECT a.event_type AS t, b.event_type AS p FROM events a JOIN events b ON b.event_id = a.event_id + 1),
c AS (SELECT l.label, (SELECT count(*) FROM s WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM s WHERE t <> label AND p = label) AS fp, (SELECT count(*) FROM s WHERE t = label AND p <> label) AS fn FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type <> 'view') l
UNION ALL SELECT 'any', count(*) FILTER (t <> 'view' AND p <> 'view'), count(*) FILTER (t = 'view' AND p <> 'view'), count(*) FILTER (t <> 'view' AND p = 'view') FROM s)
SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn, 0), 0), 6) AS f1 FROM c""")
def foreground_f1(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pairs = events.select("event_id", F.col("event_type").alias("t")).join(events.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("p")), "event_id")
    return S.foreground_f1(pairs, "t", "p", "view").withColumn("f1", F.round("f1", 6))


@query(PREDICTIONS + """, e AS (SELECT DISTINCT video, label, frame AS event FROM pred WHERE ord % 5 = 0), s AS (SELECT *, floor((lag(event) OVER (PARTITION BY video, label ORDER BY event) + event) / 2)::BIGINT AS f FROM e)
SELECT p.ord, coalesce((SELECT max(event) FROM s WHERE s.video = p.video AND s.label = p.label AND coalesce(f, -1000) <= p.frame), -1) AS closest FROM pred p WHERE ord % 5 <> 0""")
def closest_event(spark, sf_dir):
    pred, truth = _both(spark, sf_dir)
    found = S.closest_event(pred, truth).distinct()
    return pred.join(found, ["video", "label", "frame"]).select("ord", "closest")


@query(PREDICTIONS + "SELECT ord, label FROM pred WHERE label <> 'view' AND confidence / 500 >= 0.01")
def high_recall(spark, sf_dir):
    return predictions(spark, sf_dir).where((F.col("label") != "view") & (F.col("confidence") / 500 >= 0.01)).select("ord", "label")


@query(PREDICTIONS + "SELECT video, label, least(frame % 10000, 4999) AS frame, arg_max(confidence, ord) AS value FROM pred GROUP BY ALL")
def dense_grid(spark, sf_dir):
    return S.dense_grid(predictions(spark, sf_dir), F.col("frame") % 10000, F.col("confidence"), 5000)
