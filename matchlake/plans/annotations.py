"""Queries of annotation filters, grouping, de-duplication, splits and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..operators import annotations as A
from .base import PREDICTIONS, predictions, query, table


@query("""WITH l AS (SELECT event_type AS label, min(event_id) AS f FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT label, (row_number() OVER (ORDER BY f, label) - 1)::BIGINT AS class_id FROM l""")
def label_index(spark, sf_dir):
    return A.label_index(table(spark, sf_dir, "events"), "event_type", "event_id", ("error",))


@query("""WITH c AS (SELECT label, (row_number() OVER (ORDER BY f, label) - 1)::BIGINT AS class_id FROM (SELECT event_type AS label, min(event_id) AS f FROM events WHERE event_type <> 'error' GROUP BY 1))
SELECT e.event_id, c.class_id FROM (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_type END AS t FROM events) e LEFT JOIN c ON e.t = c.label WHERE e.t IS NOT NULL""")
def missing_label_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    classes = A.label_index(events, "event_type", "event_id", ("error",))
    samples = events.select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("event_type")).alias("label"))
    return A.with_class(samples, classes, "label").select("event_id", "class_id")


@query("""SELECT doc_id, lang AS path FROM documents WHERE source IN ('src1', 'src2')""")
def modality_filter(spark, sf_dir):
    inputs = F.array(F.struct(F.when(F.col("source").isin("src1", "src2"), "video").otherwise("tracking").alias("type"), F.col("lang").alias("path")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("path")))
    return A.of_modality(table(spark, sf_dir, "documents").select("doc_id", inputs.alias("inputs")), "inputs", "video").select("doc_id", F.col("inputs")[0]["path"].alias("path"))


@query("""SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL ORDER BY user_id LIMIT 10)""")
def slice_first_n(spark, sf_dir):
    return A.first_groups(table(spark, sf_dir, "events"), "user_id", 10).select("event_id", "user_id")


@query("""SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50""")
def limit_samples(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(50)


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, arg_max(role, turn) FILTER (role <> 'user') AS label, min(turn) AS first FROM conversations GROUP BY conv_id""")
def multiview_group(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("label", F.when(F.col("role") != "user", F.col("role")))
    return A.group_views(turns, F.col("conv_id"), "turn", "role", "label").select(F.col("group_id").alias("conv_id"), F.array_join("paths", ",").alias("roles"), "label", "first")


@query("""SELECT conv_id, arg_min(role, turn) AS first_view FROM conversations GROUP BY conv_id""")
def single_view(spark, sf_dir):
    grouped = A.group_views(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", "role", "role")
    return grouped.select(F.col("group_id").alias("conv_id"), A.select_views(F.col("paths"), "single")[0].alias("first_view"))


@query()
def view_pairs(spark, sf_dir):
    grouped = A.group_views(table(spark, sf_dir, "conversations").withColumn("at", F.col("turn").cast("string")), F.col("conv_id"), "turn", "at", "role")
    return grouped.select(F.col("group_id").alias("conv_id"), A.select_views(F.col("paths"), "pair", F.col("group_id")).alias("views"))


@query(PREDICTIONS + """SELECT video, count(*) AS n_events, string_agg(label, ',' ORDER BY position_ms, ord) AS labels FROM pred WHERE label IN ('click', 'view') GROUP BY video""")
def group_events_by_game(spark, sf_dir):
    grouped = A.group_events(predictions(spark, sf_dir), "video", "position_ms", "label", "ord", ("click", "view"))
    return grouped.select("video", F.size("events").cast("long").alias("n_events"), F.array_join(F.transform("events", lambda e: e["label"]), ",").alias("labels"))


@query("""WITH s AS (SELECT user_id % 3 AS split, event_type AS label FROM events),
c AS (SELECT a.split, b.label, (SELECT count(*) FROM s WHERE s.split = a.split AND s.label = b.label) AS n FROM (SELECT DISTINCT split FROM s) a, (SELECT DISTINCT label FROM s) b),
u AS (SELECT split, label, n FROM c UNION ALL SELECT NULL, label, sum(n) FROM c GROUP BY label)
SELECT split, label, n::BIGINT AS n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY split), 6) AS percent FROM u""")
def counts_rollup(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("split"), F.col("event_type").alias("label"))
    return A.label_shares(samples, "split", "label").select("split", "label", F.col("n").cast("long").alias("n"), F.round("percent", 6).alias("percent"))


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1""")
def dedup_priority(spark, sf_dir):
    return A.best_of_each(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f")).select("l_partkey", "l_suppkey", "f.*")


@query("""SELECT c_custkey, CASE WHEN r < 700 THEN 'train' WHEN r < 850 THEN 'valid' WHEN r < 1000 THEN 'test' END AS split
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS r FROM customer) WHERE r < 1000""")
def split_by_rank(spark, sf_dir):
    rows = ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")
    return rows.select("c_custkey", A.split_of_rank(F.col("rank"), [("train", 700), ("valid", 850), ("test", 1000)]).alias("split")).where("split is not null")


@query("""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 20""")
def balanced_subset(spark, sf_dir):
    return A.first_of_each(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], 20, "event_id")


@query("""WITH n AS (SELECT event_type AS label, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1 UNION ALL SELECT 'view', 0),
w AS (SELECT label, n, 1 / sqrt(greatest(n, 1)::DOUBLE) AS w FROM n) SELECT label, n, round(w * count(*) OVER () / sum(w) OVER (), 6) AS weight FROM w""")
def class_weights(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"))
    weights = A.class_weights(events.where("label <> 'view'"), events.distinct(), "label", root=True)
    return weights.select("label", "n", F.round("weight", 6).alias("weight"))


@query("""SELECT event_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY event_type), 9) AS weight FROM events""")
def sample_weights(spark, sf_dir):
    return A.sample_weights(table(spark, sf_dir, "events"), "event_type").select("event_id", F.round("weight", 9).alias("weight"))


@query("""SELECT l_partkey, arg_min(l_suppkey, struct_pack(at := l_orderkey * 100 + l_linenumber, v := l_suppkey)) AS first, count(*) AS n, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def conflict_detect(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return A.conflicts(rows, "l_partkey", "l_suppkey", "at")


@query("""SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def semi_present(spark, sf_dir):
    return A.with_present(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""")
def anti_missing(spark, sf_dir):
    return A.with_missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def annotation_left_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"))


@query("""SELECT id, count(*) AS n FROM (SELECT o_custkey AS id FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY id""")
def union_all_files(spark, sf_dir):
    both = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT doc_id AS id, 'truth_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'prediction_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def set_difference(spark, sf_dir):
    truth = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    predicted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return truth.subtract(predicted).withColumn("side", F.lit("truth_only")).unionByName(predicted.subtract(truth).withColumn("side", F.lit("prediction_only")))


@query("""SELECT DISTINCT CASE WHEN starts_with(source, 'src1') THEN source ELSE 'src1/' || source END AS path FROM documents""")
def prefixed_paths(spark, sf_dir):
    path = F.when(F.col("source").startswith("src1"), F.col("source")).otherwise(F.concat(F.lit("src1/"), F.col("source")))
    return table(spark, sf_dir, "documents").select(path.alias("path")).distinct()


@query("""SELECT max(event_id) AS event_id, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id, event_type""")
def last_wins(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("last_value"))
    return grouped.select("event_id", "last_value")


@query(PREDICTIONS + """SELECT video, label, ord FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY confidence DESC, ord) AS r FROM pred) WHERE r <= 3""")
def top_predictions(spark, sf_dir):
    order = Window.partitionBy("video").orderBy(F.desc("confidence"), "ord")
    return predictions(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 3").select("video", "label", "ord")
