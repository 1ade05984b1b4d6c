"""Queries of shard packing, manifests and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sizes
from ..operators import packing as P
from .base import query, table

MEMBERS = "WITH m AS (SELECT doc_id, source, 512 + (n_chars + 511) // 512 * 512 AS member FROM documents)\n"


@query(MEMBERS + """, l AS (SELECT source, list(struct_pack(d := doc_id, m := member, s := 0::BIGINT, t := 0::BIGINT) ORDER BY doc_id) AS x FROM m GROUP BY source),
f AS (SELECT source, list_reduce(list_transform(x, lambda e: [struct_pack(d := e.d, m := e.m, s := 0::BIGINT, t := e.m)]), lambda a, e: list_concat(a, [CASE WHEN (a[-1].t + e[1].m + 1024 + 10239) // 10240 * 10240 > 40960
 THEN struct_pack(d := e[1].d, m := e[1].m, s := a[-1].s + 1, t := e[1].m) ELSE struct_pack(d := e[1].d, m := e[1].m, s := a[-1].s, t := a[-1].t + e[1].m) END])) AS r FROM l)
SELECT source, unnest(r).d AS doc_id, unnest(r).s AS shard FROM f""")
def shard_pack_size(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", sizes.tar_member(F.col("n_chars")).alias("member"))
    return P.pack_by_size(docs, "source", "doc_id", "member", 40960).select("source", "doc_id", "shard")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS shard FROM orders")
def shard_pack_count(spark, sf_dir):
    return P.pack_by_count(table(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey").select("o_orderkey", "shard")


@query("""SELECT p_partkey, (p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000000 WHEN 2 THEN 1048576 END)::BIGINT AS bytes FROM part""")
def shard_size_parse(spark, sf_dir):
    unit = F.element_at(F.array(F.lit(""), F.lit("MB"), F.lit(" MiB"), F.lit("parsecs")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sizes.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query(MEMBERS + "SELECT source, ((sum(member) + 1024 + 10239) // 10240 * 10240)::BIGINT AS bytes FROM m GROUP BY source")
def tar_size_model(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(sizes.tar_file(F.sum(sizes.tar_member(F.col("n_chars")))).alias("bytes"))


@query("""SELECT p_partkey, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size FROM (SELECT p_partkey, floor(p_retailprice) * p_size * 20 + 1 AS b FROM part)""")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sizes.human_size(F.floor("p_retailprice") * F.col("p_size") * 20 + 1).alias("size"))


@query("""SELECT o_orderkey AS sample_id, (o_orderkey % 8)::BIGINT AS shard, i AS input_index, 'c/' || (o_custkey + i) || '.MP4' AS path, CASE WHEN (o_custkey + i) IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) THEN 'ok' ELSE 'missing' END AS status,
 CASE WHEN (o_custkey + i) IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) THEN printf('%09d.%d.mp4', o_orderkey, i) END AS member FROM orders, range(2) r(i)""")
def shard_manifest(spark, sf_dir):
    path = lambda i: F.struct(F.concat(F.lit("c/"), (F.col("o_custkey") + i).cast("string"), F.lit(".MP4")).alias("path"))
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderkey").alias("sample_index"), (F.col("o_orderkey") % 8).alias("shard"), F.array(path(0), path(1)).alias("inputs"))
    listing = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string"), F.lit(".MP4")).alias("path"))
    return P.manifest(samples, "inputs", listing).withColumn("input_index", F.col("input_index").cast("long"))


@query("""SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events""")
def payload_json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT event_id, '{"k":' || (props::JSON->>'k') || '}' AS payload FROM events""")
def payload_json_roundtrip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.from_json("props", "k long")).alias("payload"))


@query("""SELECT count(*) AS num_samples, count(DISTINCT source) AS num_shards, count(*) FILTER (n_chars > 100) AS files_added, count(*) FILTER (n_chars <= 100) AS missing FROM documents""")
def conversion_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("num_samples"), F.countDistinct("source").alias("num_shards"), F.count_if(F.col("n_chars") > 100).alias("files_added"), F.count_if(F.col("n_chars") <= 100).alias("missing"))
