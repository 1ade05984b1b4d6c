"""Work of a task that stays bounded as tables grow, and results that ties leave alone."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from matchlake.operators import annotations, graph, spotting
from matchlake.plans import base, catalog
from matchlake.streaming import suppression

SF = "/root/testdata/sf0.001"


def test_conflicts_with_equal_ordinals(spark):
    rows = [("a", 7, 1), ("a", 5, 1), ("a", 6, 2), ("b", 5, 1), ("b", 7, 1), ("c", 4, 1), ("c", 4, 2)]
    for some in (rows, rows[::-1]):
        found = annotations.conflicts(spark.createDataFrame(some, "k string, v long, at long").coalesce(1), "k", "v", "at")
        assert sorted(map(tuple, found.collect())) == [("a", 5, 3, 3), ("b", 5, 2, 2)]


@pytest.mark.parametrize("name", ["knn_edges", "ball_knn_edges", "distance_edges"])
def test_frames_are_dealt_by_the_number_of_lines(spark, monkeypatch, name):
    monkeypatch.setattr(base, "TASK_ROWS", 500)
    lines = base.table(spark, SF, "lineitem").count()
    found = catalog.QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(clip" in plan and f", {-(-lines // 500)}), REPARTITION_BY_NUM" in plan


def test_edges_stay_where_their_frame_is(spark):
    nodes = spark.createDataFrame([(0, f, s, float(s * s), 0.0, s % 2) for f in range(50) for s in range(5)], "clip int, frame int, slot long, x double, y double, team int").repartition(7, "clip", "frame")
    found = graph.knn_edges(nodes, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("REPARTITION_BY_NUM") == 2  # the two sides of the join, which are one where they run
    near = {(s, d) for s in range(5) for d in sorted((d for d in range(5) if d != s), key=lambda d: (abs(s * s - d * d), d))[:2]}
    assert {(r.src, r.dst) for r in found.where("frame = 3").collect()} == near | {(d, s) for s, d in near}


def test_chunks_of_few_users_go_to_many_tasks(spark, monkeypatch):
    users = base.table(spark, SF, "events").select("user_id").distinct().count()
    assert catalog.QUERIES["stitch_chunks"](spark, SF).rdd.getNumPartitions() == 4
    monkeypatch.setattr(base, "TASK_ROWS", 100)
    assert catalog.QUERIES["stitch_chunks"](spark, SF).rdd.getNumPartitions() == -(-120 * users // 100)


def test_stream_of_many_keys_has_few_states(spark, tmp_path):
    """Keys that are null or hold marks of their own come back, and NaN is the greatest."""
    rng = random.Random(8)
    names = [None, 'a"b', "a\nb", "", "é\\n"]
    rows = [(rng.choice([None, 1 << 60, (1 << 60) + 1, *range(300)]), rng.choice(names), rng.randrange(1000), rng.choice([rng.random(), 0.5, float("nan")]), k) for k in range(4000)]
    kind = "video long, label string, frame long, confidence double, ord long"
    end = (-1, "end", 10**6, 0.0, -1)
    os.makedirs(tmp_path / "in")
    table = pa.table({c: [r[k] for r in [*rows, end]] for k, c in enumerate(["video", "label", "frame", "confidence", "ord"])})
    pq.write_table(table, tmp_path / "in/0.parquet")
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    query = suppression.write_epochs(suppression.suppress_stream(stream, 60, 1000, "1 second", "video", "label", buckets=16), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 16
    got = sorted(map(repr, spark.read.schema(kind).parquet(str(tmp_path / "out")).where("ord >= 0").drop("epoch").collect()))
    want = sorted(map(repr, spotting.suppress_window(spark.createDataFrame(rows, kind), 60, "video", "label").collect()))
    assert got == want
