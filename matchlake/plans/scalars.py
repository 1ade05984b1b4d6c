"""Queries of scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timing as T
from .base import query, table


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN round(l_tax * 100) - 2 <= 0 THEN 1 ELSE trunc(l_quantity / (round(l_tax * 100) - 2))::INT END AS stride FROM lineitem")
def stride_int(spark, sf_dir):
    rate = F.round(F.col("l_tax") * 100) - 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.stride(F.col("l_quantity"), rate).alias("stride"))


@query("SELECT p_partkey, greatest(1, round_even(p_size / 4.0, 0)::INT) AS stride FROM part")
def effective_stride(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.effective_stride(F.col("p_size"), 4.0).alias("stride"))


@query("SELECT p_partkey, ceil(p_retailprice / p_size)::BIGINT AS frames, round(p_retailprice / p_size, 6) AS fps FROM part")
def sampled_rates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.frame_count(F.col("p_retailprice"), F.col("p_size")).alias("frames"), F.round(F.col("p_retailprice") / F.col("p_size"), 6).alias("fps"))


@query("SELECT event_id, CASE WHEN trunc(event_id / 1000.0::DOUBLE * 25)::BIGINT = 0 THEN 1 ELSE trunc(event_id / 1000.0::DOUBLE * 25)::BIGINT END AS frame FROM events")
def frame_from_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.frame_of_ms(F.col("event_id"), F.lit(25.0)).alias("frame"))


@query("SELECT event_id, (1 + event_id % 2)::INT AS half, (event_id % 90) * 60 + event_id % 60 AS seconds FROM events")
def gametime_parse(spark, sf_dir):
    clock = F.format_string("%d - %02d:%02d", 1 + F.col("event_id") % 2, F.col("event_id") % 90, F.col("event_id") % 60)
    return table(spark, sf_dir, "events").select("event_id", T.half_of(clock).alias("half"), T.seconds_of(clock).alias("seconds"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN (event_id % 3)::VARCHAR END, '1') || ' - ' || CASE WHEN event_id % 5 = 0 THEN '00:00' ELSE event_type END AS clock FROM events")
def gametime_compose(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.clock_of(F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3), F.when(F.col("event_id") % 5 != 0, F.col("event_type"))).alias("clock"))


LABELS = """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PA' WHEN 1 THEN 'CR' WHEN 2 THEN 'SH' WHEN 3 THEN 'CH' ELSE 'CL' END AS k, CASE WHEN event_id % 4 = 0 THEN 'HE' ELSE 'RF' END AS b, CASE WHEN event_id % 7 = 0 THEN 'A' ELSE 'G' END AS h,
 CASE WHEN event_id % 6 = 0 THEN 'H' ELSE 'S' END AS p, CASE WHEN event_id % 3 = 0 THEN 'G' ELSE 'S' END AS o, CASE WHEN event_id % 2 = 0 THEN user_id END AS w, CASE WHEN event_type = 'error' THEN 'OUT' END AS g, CASE event_type WHEN 'click' THEN 'T' WHEN 'signup' THEN 'F' END AS s FROM events)
, labels AS (SELECT event_id, 'HEADER' AS label FROM e WHERE b = 'HE' AND k IN ('PA', 'SH', 'CL') UNION ALL SELECT event_id, CASE WHEN h = 'A' THEN 'HIGH PASS' WHEN p = 'H' THEN 'THROW IN' ELSE 'PASS' END FROM e WHERE k = 'PA' AND b <> 'HE'
UNION ALL SELECT event_id, 'CROSS' FROM e WHERE k = 'CR' UNION ALL SELECT event_id, 'SHOT' FROM e WHERE k = 'SH' UNION ALL SELECT event_id, 'GOAL' FROM e WHERE k = 'SH' AND o = 'G' UNION ALL SELECT event_id, 'PLAYER SUCCESSFUL TACKLE' FROM e WHERE k = 'CH' AND coalesce(w, 0) <> 0
UNION ALL SELECT event_id, 'OUT' FROM e WHERE g = 'OUT' UNION ALL SELECT event_id, 'THROW IN' FROM e WHERE s = 'T' UNION ALL SELECT event_id, 'FREE KICK' FROM e WHERE s = 'F')
"""


def _labels(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    labels = T.labels_of(
        F.element_at(F.array(*map(F.lit, ("PA", "CR", "SH", "CH", "CL"))), (i % 5 + 1).cast("int")), F.when(i % 4 == 0, "HE").otherwise("RF"), F.when(i % 7 == 0, "A").otherwise("G"), F.when(i % 6 == 0, "H").otherwise("S"),
        F.when(i % 3 == 0, "G").otherwise("S"), F.when(i % 2 == 0, F.col("user_id")), F.when(kind == "error", "OUT"), F.when(kind == "click", "T").when(kind == "signup", "F"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.explode(labels).alias("label"))


@query(LABELS + "SELECT * FROM labels")
def label_multimap(spark, sf_dir):
    return _labels(spark, sf_dir)


@query(LABELS + """SELECT event_id, arg_max(label, list_position(['PASS', 'HIGH PASS', 'OUT', 'CROSS', 'SHOT', 'HEADER', 'PLAYER SUCCESSFUL TACKLE', 'THROW IN', 'FREE KICK', 'GOAL'], label)) AS label FROM labels GROUP BY event_id""")
def label_priority(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy("event_id").agg(F.max_by("label", T.priority_of(F.col("label"))).alias("label"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' WHEN 3 THEN 'FWD' END AS grp FROM events""")
def position_groups(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("GK", "LWB", "AM", "CF", "SUB"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.position_group(code).alias("grp"))


@query("SELECT o_orderkey, i AS place, least(trunc(i * 2.5::DOUBLE)::BIGINT, o_custkey - 1) AS frame FROM orders, range(4) r(i)")
def resampled_frames(spark, sf_dir):
    frames = T.resampled_frames(F.col("o_custkey"), 2.5, 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(frames).alias("place", "frame")).withColumn("place", F.col("place").cast("long"))


@query("SELECT o_orderkey, (o_custkey + 31) // 32 * 32 - o_custkey AS padding FROM orders")
def batch_padding(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.to_batch(F.col("o_custkey"), 32).alias("padding"))


@query("""SELECT DISTINCT path FROM (SELECT regexp_replace(replace('/' || source || '\\x/a.mp4', '\\', '/'), '^/+', '') AS path FROM documents UNION ALL SELECT regexp_replace(url, '^/+', '') FROM pages WHERE url <> '')""")
def repo_paths_union(spark, sf_dir):
    legacy = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), F.col("source"), F.lit("\\x/a.mp4")).alias("path"))
    newer = table(spark, sf_dir, "pages").where("url <> ''").select(F.col("url").alias("path"))
    return legacy.unionByName(newer).select(T.repository_path(F.col("path")).alias("path")).distinct()


@query("""SELECT doc_id, nullif(CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END, '') AS split, source AS folder FROM documents""")
def split_names(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 9 == 0, " /.json").otherwise(F.concat(F.lit(" //"), F.col("source"), F.lit(".json ")))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_split(raw).alias("split"), T.folder_of(F.concat(F.col("source"), F.lit("/x.json"))).alias("folder"))


@query("""SELECT p.path, coalesce(d.n::VARCHAR, 'Not found') AS size FROM (SELECT DISTINCT 'src' || (event_id % 30) AS path FROM events) p LEFT JOIN (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1) d ON d.source = p.path""")
def transfer_plan(spark, sf_dir):
    paths = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("event_id") % 30).cast("string")).alias("path")).distinct()
    listing = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.sum("n_chars").alias("n"))
    return paths.join(listing, "path", "left").select("path", F.coalesce(F.col("n").cast("string"), F.lit("Not found")).alias("size"))


@query("SELECT sum(n_chars)::BIGINT AS frames, count(*) AS events, round(count(*) * 100.0::DOUBLE / sum(n_chars), 6) AS percent FROM documents")
def totals_info(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("frames"), F.count("*").alias("events"), F.round(F.count("*") * 100.0 / F.sum("n_chars"), 6).alias("percent"))
