"""Queries of classification metrics. Labels' quality and toxicity, and the events' kinds, stand for truth and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classification as C
from .base import query, table

PAIRS = "WITH s AS (SELECT a.event_type AS t, b.event_type AS p FROM events a JOIN events b ON b.event_id = a.event_id + 1)\n"
CLASSES = PAIRS + """, l AS (SELECT DISTINCT t AS label FROM s UNION SELECT DISTINCT p FROM s),
c AS (SELECT label, (SELECT count(*) FROM s WHERE t = label) AS support, (SELECT count(*) FROM s WHERE p = label) AS predicted, (SELECT count(*) FROM s WHERE t = label AND p = label) AS hits FROM l),
m AS (SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(hits::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * hits / nullif(support + predicted, 0), 0) AS f1 FROM c)
"""


def _pairs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.col("event_type").alias("t")).join(events.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("p")), "event_id")


@query(PAIRS + "SELECT t AS truth, p AS predicted, count(*) AS n FROM s GROUP BY ALL")
def confusion_long(spark, sf_dir):
    return C.confusion(_pairs(spark, sf_dir), "t", "p")


@query(CLASSES + "SELECT label, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def class_metrics(spark, sf_dir):
    rows = C.per_class(C.confusion(_pairs(spark, sf_dir), "t", "p"))
    return rows.select("label", "support", "predicted", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(CLASSES + """SELECT round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(precision), 6) AS macro_precision,
 round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM m""")
def macro_metrics(spark, sf_dir):
    one = C.summary(C.per_class(C.confusion(_pairs(spark, sf_dir), "t", "p")))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


@query(CLASSES + "SELECT label, support, round(hits * 100.0::DOUBLE / greatest(support, 1), 6) AS accuracy, row_number() OVER (ORDER BY support DESC, label) AS place FROM m")
def classes_by_frequency(spark, sf_dir):
    return C.by_frequency(C.per_class(C.confusion(_pairs(spark, sf_dir), "t", "p"))).withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT doc_id, toxic::BIGINT AS predicted, quality::BIGINT AS truth FROM labels WHERE quality <> 2 AND doc_id IN (SELECT doc_id FROM documents)""")
def eval_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    truth = labels.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("doc_id").alias("ord"))
    pred = labels.select("doc_id", F.col("toxic").cast("long").alias("predicted")).join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    return C.join_by_id(pred, truth, "doc_id", "quality", "ord", ("2",))


@query("""SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS predicted FROM embeddings""")
def argmax_logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", C.argmax(F.col("embedding")).cast("long").alias("predicted"))


@query("""WITH e AS (SELECT vec_id, (label % 64)::BIGINT AS label, embedding[1:64] AS x FROM embeddings), u AS (SELECT vec_id, label, x[label + 1] AS own, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM e)
SELECT vec_id, label, count(*) FILTER (v > own OR (v = own AND i > label)) < 5 AS hit FROM u GROUP BY ALL""")
def topk_accuracy(spark, sf_dir):
    label = F.col("label") % 64
    return table(spark, sf_dir, "embeddings").select("vec_id", label.cast("long").alias("label"), C.in_top(F.col("embedding"), label, 5).alias("hit"))


@query("""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, max(v) AS m FROM u GROUP BY 1) SELECT vec_id, round(1 / sum(exp(v - m)), 6) AS confidence FROM u JOIN m USING (vec_id) GROUP BY 1""")
def softmax_confidence(spark, sf_dir):
    scores = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(C.softmax(scores)), 6).alias("confidence"))


@query("""SELECT user_id, CASE WHEN max(s) > 0 THEN arg_max(event_id, (s, -event_id)) ELSE arg_min(event_id, (value, event_id)) END AS best
FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END AS s FROM events) GROUP BY user_id""")
def best_epoch(spark, sf_dir):
    logs = table(spark, sf_dir, "events").withColumn("s", F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(0.0))
    return C.best_epoch(logs, "event_id", "s", "value", "user_id")


@query("""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1""")
def weighted_mean(spark, sf_dir):
    return C.weighted_mean(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag").withColumn("mean", F.round("mean", 4))


@query("""SELECT event_id, round(-ln(greatest(least(value / 500, 1), 1e-12)), 6) AS loss FROM events""")
def nll_loss(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(C.negative_log_likelihood(F.least(F.col("value") / 500, F.lit(1.0))), 6).alias("loss"))
