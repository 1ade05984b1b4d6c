"""Edge cases of operators against plain loops and hand-made rows."""

import io
import json
import random
import tarfile
import zipfile

import numpy as np
import pytest

from matchlake.functions import sizes
from matchlake.functions.ranks import ranked
from matchlake.operators import alignment, graph, packing, records, sampling, spotting
from matchlake.sources import documents, sinks
from pyspark.sql import functions as F

PRED = "video long, label string, frame long, confidence double, ord long"


def test_window_suppression(spark):
    rows = [(1, "a", 10, 0.5, 0), (1, "a", 10, 0.9, 1), (1, "a", 15, 0.6, 2), (1, "a", 21, 0.7, 3), (1, "a", 31, 0.7, 4), (1, "b", 12, 0.1, 5), (2, "a", 10, 0.2, 6)]
    kept = {r.ord for r in spotting.suppress_window(spark.createDataFrame(rows, PRED), 10, "video", "label").collect()}
    expected = {r[4] for r in rows if not any(q[:2] == r[:2] and q[2] != r[2] and abs(q[2] - r[2]) <= 10 and q[3] > r[3] for q in rows)}
    assert kept == expected


def test_greedy_suppression(spark):
    random.seed(1)
    rows = [(v, "a", random.randint(0, 200), random.randint(0, 20) / 20, v * 100 + k) for v in range(3) for k in range(60)]
    for window, back, ahead in ((8, 4, 4), (5, 3, 2)):
        got = {r.ord for r in spotting.suppress_greedy(spark.createDataFrame(rows, PRED), window, 0.3, "video").collect()}
        expected = set()
        for v in range(3):
            left = sorted((r for r in rows if r[0] == v and r[3] >= 0.3), key=lambda r: (-r[3], r[2], r[4]))
            while left:
                best = left[0]
                expected.add(best[4])
                left = [r for r in left[1:] if not best[2] - back <= r[2] < best[2] + ahead]
        assert got == expected
    with pytest.raises(ValueError):
        spotting.suppress_greedy(spark.createDataFrame(rows, PRED), 1, 0.3, "video")


def test_matching(spark):
    truth = spark.createDataFrame([(1, "a", 10, 0.0, 0), (1, "a", 20, 0.0, 1), (1, "b", 5, 0.0, 2), (2, "a", 7, 0.0, 3)], PRED)
    pred = spark.createDataFrame([(1, "a", 15, 0.9, 0), (1, "a", 14, 0.8, 1), (1, "a", 11, 0.7, 2), (3, "a", 7, 0.9, 3)], PRED)
    nearest = {r.ord: r.hit for r in spotting.match_nearest(pred, truth, 6).collect()}
    assert nearest == {0: True, 1: True, 2: False, 3: False}
    strongest = {r.ord: r.hit for r in spotting.match_strongest(pred, truth, 10.0).collect()}
    assert strongest == {0: True, 1: False, 2: False, 3: False}


def _brute_nearest(pred, truth, tolerance):
    hits, left = {}, sorted(truth, key=lambda t: t[4])
    for p in sorted(pred, key=lambda p: (-p[3], p[4])):
        near = [t for t in left if t[:2] == p[:2] and abs(t[2] - p[2]) <= tolerance]
        best = min(near, key=lambda t: abs(t[2] - p[2]), default=None)
        hits[p[4]] = best is not None
        if best is not None:
            left.remove(best)
    return hits


def _brute_strongest(pred, truth, delta):
    hits = dict.fromkeys((p[4] for p in pred), False)
    for t in sorted(truth, key=lambda t: (t[2], t[4])):
        near = [p for p in pred if p[:2] == t[:2] and abs(p[2] - t[2]) <= delta / 2 and not hits[p[4]]]
        if near:
            hits[max(near, key=lambda p: (p[3], -p[2], -p[4]))[4]] = True
    return hits


def _brute_greedy(pred, window, least):
    kept = []
    for p in sorted((p for p in pred if p[3] >= least), key=lambda p: (-p[3], p[2], p[4])):
        if not any(k[:2] == p[:2] and k[2] - (window + 1) // 2 <= p[2] < k[2] + window // 2 for k in kept):
            kept.append(p)
    return {k[4] for k in kept}


def test_hot_keys_are_settled_in_chunks(spark, monkeypatch):
    """One key holds all rows, in one island of time: no task may get more than a small part of it."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

    def bounded(kind):
        original = kind.applyInPandas

        def apply(self, f, schema):
            def checked(*frames):
                assert sum(map(len, frames)) <= 250, "a task holds too much of a key"
                return f(*frames)

            if kind is PandasCogroupedOps:
                return original(self, lambda a, b: checked(a, b), schema)
            return original(self, lambda a: checked(a), schema)

        monkeypatch.setattr(kind, "applyInPandas", apply)

    bounded(PandasCogroupedOps)
    bounded(PandasGroupedOpsMixin)
    monkeypatch.setattr(spotting, "CHUNK_ROWS", 100, raising=False)
    rng = random.Random(4)
    for rising in (False, True):  # a rising confidence passes each decision on to the next
        pred = [(1, "a", f := rng.randint(0, 1500), f / 1500 if rising else rng.randint(0, 30) / 30, k) for k in range(1200)]
        truth = [(1, "a", rng.randint(0, 1500), 0.0, k) for k in range(300)]
        p, t = spark.createDataFrame(pred, PRED), spark.createDataFrame(truth, PRED)
        assert {r.ord: r.hit for r in spotting.match_nearest(p, t, 6).collect()} == _brute_nearest(pred, truth, 6)
        assert {r.ord: r.hit for r in spotting.match_strongest(p, t, 9.0).collect()} == _brute_strongest(pred, truth, 9.0)
        for window in (12, 7):
            assert {r.ord for r in spotting.suppress_greedy(p, window, 0.1, "video", "label").collect()} == _brute_greedy(pred, window, 0.1)


def test_average_precision_over_ranges(spark):
    rng = random.Random(5)
    rows = [("ab"[k % 2], rng.random(), k, rng.random() < 0.4) for k in range(400)]
    truth = spark.createDataFrame([("a",)] * 90 + [("b",)] * 80 + [("c",)], "label string")
    found = spotting.average_precision(spark.createDataFrame(rows, "label string, confidence double, ord long, hit boolean"), truth, [F.desc("confidence"), F.col("ord")])
    assert not any("Window [" in x and "label" in x and "_part" not in x and "confidence" in x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    expected = {"c": 0.0}
    for label, n in (("a", 90), ("b", 80)):
        hits = [r[3] for r in sorted((r for r in rows if r[0] == label), key=lambda r: (-r[1], r[2]))]
        points = [sum(hits[: k + 1]) / (k + 1) for k, hit in enumerate(hits) if hit]
        expected[label] = sum(max(points[k:]) for k in range(len(points))) / n
    got = {r.label: r.ap for r in found.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_nearest_ties_and_duplicates(spark):
    marks = spark.createDataFrame([("g", 0.0, 1, 1), ("g", 0.0, 2, 2), ("g", 10.0, 3, 3), ("g", 10.0, 4, 4)], "k string, t double, o long, v long")
    asked = spark.createDataFrame([("g", 5.0), ("g", 6.0), ("g", -3.0), ("g", 30.0), ("g", 10.0), ("h", 1.0)], "k string, t double")
    got = {r.t: r.v for r in alignment.nearest(asked, marks, "k", "t", "o", "v").where("k = 'g'").collect()}
    assert got == {5.0: 2, 6.0: 3, -3.0: 1, 30.0: 4, 10.0: 3}
    assert {r.t for r in alignment.nearest(asked, marks, "k", "t", "o", "v", 4.0).collect()} == {6.0, -3.0, 10.0}


def test_clip_windows_short_videos(spark):
    videos = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "video string, n long")
    got = alignment.clip_windows(videos, "n", 1, 4, before=2)
    assert got.where("video = 'a'").count() == 0
    assert [r.frame for r in got.where("video = 'b'").orderBy("clip", "slot").collect()] == [0, 0, 0, 1]


def test_packing(spark):
    member = lambda n: 512 + -(-n // 512) * 512
    rows = [("x", i, member(n)) for i, n in enumerate([3000, 3000, 3000, 50_000, 10])]
    got = packing.pack_by_size(spark.createDataFrame(rows, "g string, i long, m long"), "g", "i", "m", 10240)
    assert [r.shard for r in got.orderBy("i").collect()] == [0, 0, 1, 2, 3]
    texts = spark.createDataFrame([("500MB",), ("1GB",), ("1024MiB",), ("42",), ("0",), ("3 parsecs",), (None,)], "t string")
    assert [r[0] for r in texts.select(sizes.parse_size(F.col("t"))).collect()] == [500_000_000, 1_000_000_000, 1_073_741_824, 42, None, None, None]


def test_packing_folds_over_batches(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def whole_group(self, f, schema):
        raise AssertionError("a whole group is one frame")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", whole_group)
    rng = random.Random(6)
    rows = [("xyz"[k % 3], k, 512 * rng.randint(1, 12)) for k in range(300)] + [(None, k, 512) for k in range(60)]
    expected, state = {}, {}
    for g, i, m in rows:
        shard, total = state.get(g, (0, 0))
        if total and -(-(total + m + 1024) // 10240) * 10240 > 20480:
            shard, total = shard + 1, 0
        state[g], expected[g, i] = (shard, total + m), shard
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng.shuffle(rows)
        got = packing.pack_by_size(spark.createDataFrame(rows, "g string, i long, m long"), "g", "i", "m", 20480).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.g, r.i): r.shard for r in got} == expected


def test_ranks(spark):
    rows = ranked(spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")), "x")
    assert rows.where("x <> rank").count() == 0 and rows.count() == 1000
    assert ranked(spark.range(0), "id").count() == 0


def test_draws_follow_weights(spark):
    items = spark.createDataFrame([(i, float(i % 3)) for i in range(90)], "k long, w double")
    drawn = sampling.weighted_draws(items, "k", "w", 30_000, 3)
    shares = {r.c: r["count"] for r in drawn.groupBy((F.col("k") % 3).alias("c")).count().collect()}
    assert drawn.count() == 30_000 and set(shares) == {1, 2} and abs(shares[2] / 30_000 - 2 / 3) < 0.02
    assert sampling.weighted_draws(items.where("w < 0"), "k", "w", 10, 3).count() == 0


def test_documents_and_archives(spark, tmp_path):
    doc = {"labels": {"action": {"type": "single", "labels": ["PASS", "SHOT"]}}, "data": [{"id": "s0", "inputs": [{"type": "video", "path": "a.mp4", "fps": 25}], "labels": {"action": {"label": "PASS"}}, "events": [{"label": "PASS", "position_ms": 40}]}, {"id": "s1", "inputs": []}]}
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    samples = documents.annotations(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert samples.count() == 4 and documents.class_lists(samples) == 1 and documents.has_events(samples)
    (tmp_path / "t.jsonl").write_text('{"frameNum": 1}\nbroken{\n{"frameNum": 2}\n')
    assert documents.json_lines(spark, str(tmp_path / "t.jsonl")).count() == 2
    (tmp_path / "c.txt").write_text("x\n\n  y \n")
    assert [r.line for r in documents.text_lines(spark, str(tmp_path / "c.txt")).collect()] == ["x", "y"]
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert documents.matrices(spark, str(tmp_path / "m.npy")).count() == 3
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.json", "{}")
    assert documents.zip_member(spark, str(tmp_path / "z.zip"), "in.json").first().text == "{}"


def test_shards_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([(0, "s0", '{"id":"s0","n":1}', [("a.mp4",)], 0), (1, None, '{"n":2}', [], 1)], "sample_index long, sample_id string, payload string, inputs array<struct<path: string>>, shard long")
    rows = sinks.dataset_rows(samples, "{}")
    assert [r.sample_id for r in rows.orderBy("sample_index").collect()] == ["s0", "sample_000001"]
    rows.write.parquet(str(tmp_path / "metadata.parquet"))
    members = [("shard-000000.tar", "000000000.json", b'{"n":5}'), ("shard-000000.tar", "000000000.0.mp4", b"film"), ("shard-000001.tar", "000000001.json", b"{}")]
    (tmp_path / "shards").mkdir()
    for name in ("shard-000000.tar", "shard-000001.tar"):
        with tarfile.open(tmp_path / "shards" / name, "w") as tar:
            for r in members:
                if r[0] == name:
                    info = tarfile.TarInfo(r[1])
                    info.size = len(r[2])
                    tar.addfile(info, io.BytesIO(r[2]))
    back = {r.sample_id: json.loads(r.payload) for r in documents.shards(spark, str(tmp_path)).collect()}
    assert back == {"s0": {"id": "s0", "n": 5}, "sample_000001": {"n": 2}}


def test_draws_carry_their_own_row(spark):
    """Keys with many rows: each draw comes out once, with the row it drew, in proportion to the weights."""
    rows = [(k % 7, k, "ab"[k % 3 == 0]) for k in range(210)]
    events = spark.createDataFrame(rows, "video long, frame long, label string")
    drawn = sampling.foreground_starts(events, "video", "frame", 10, 4000, 5).collect()
    assert sorted(r.draw for r in drawn) == list(range(4000)) and all(any(0 <= f - r.start < 10 for v, f, _ in rows if v == r.video) for r in drawn)
    assert max(abs(sum(r.video == v for r in drawn) / 4000 - 1 / 7) for v in range(7)) < 0.03
    anchors = sampling.balanced_anchors(events, "label", "video", 4000, 5).collect()
    assert sorted(r.draw for r in anchors) == list(range(4000)) and abs(sum(r.label == "a" for r in anchors) / 4000 - 0.5) < 0.04
    skewed = spark.range(5000).selectExpr("id", "if(id = 3, 5000.0, 1.0) as w")
    got = sampling.weighted_draws(skewed, "id", "w", 8000, 1, buckets=4).collect()
    assert len(got) == 8000 and abs(sum(r.id == 3 for r in got) / 8000 - 0.5) < 0.03


def test_feature_knn_against_all_distances(spark):
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(1, 6)), 60, axis=0)])  # with more copies than neighbours
    points = spark.createDataFrame([(int(k), x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = {(r.id, r["rank"]): r.neighbour for r in graph.feature_knn(points.where("id % 7 = 0"), points, 5, block=20).collect()}
    for q in range(0, 360, 7):
        d = ((v - v[q]) ** 2).sum(axis=1)
        assert [got[q, k] for k in range(1, 6)] == sorted(range(360), key=lambda p: (d[p], p))[:5]
    assert graph.feature_knn(points.where("false"), points, 5).count() == 0


def test_record_rules(spark):
    rows = spark.createDataFrame([("12.0", True, 1.5, None), ("x", False, None, "a"), (None, None, 2.5, "b"), ("3e12", True, 0.1, "")], "n string, flag boolean, ms double, name string")
    got = [tuple(r) for r in records.coerced(rows, ["n"], ["ms"]).collect()]
    assert [r[:2] for r in got] == [(12, "True"), (-1, "False"), (-1, ""), (-1, "True")] and [r[3] for r in got] == ["", "a", "b", ""] and got[1][2] is None
    clips = records.filled_clips(spark.createDataFrame([(1, 3), (2, 22)], "video long, n long"), "n", 10, 4, 4).orderBy("video", "place").collect()
    assert [r.start for r in clips] == [1, 1, 1, 1, 1, 7, 13, 13]
    texts = spark.createDataFrame([("Repository NOT Found",), ("not",), (None,)], "m string")
    assert [r[0] for r in texts.select(records.says(F.col("m"), ("repository", "not found"), ("404",))).collect()] == [True, False, False]
    empty = spark.createDataFrame([], "game string, split string, path string")
    assert records.split_manifests(empty, empty.select("game", "path"), "video").count() == 0


def _brute_performances(pred, truth, classes, deltas):
    """Average precision by plain loops over rows (video, label, frame, confidence) and (video, label, frame, visible)."""

    def ap(label, kind, delta):
        scored = []
        for video in {r[0] for r in pred if r[1] == label}:
            events = sorted((t[2], t[3]) for t in truth if t[:2] == (video, label))
            mine, used = sorted((p[2], p[3]) for p in pred if p[:2] == (video, label)), set()
            for at, _ in events:
                near = [p for p in mine if abs(p[0] - at) <= delta / 2 and p not in used]
                if near:
                    used.add(max(near, key=lambda p: (p[1], -p[0])))
            for p in mine:
                starts = [0] + [(a[0] + b[0]) // 2 for a, b in zip(events, events[1:])]
                shown = events[max(k for k, s in enumerate(starts) if s <= p[0] or k == 0)][1] if events else False
                scored.append((p[1], p in used, "visible" if shown else "unshown"))
        scored = [s for s in scored if kind in ("any", s[2])]
        total = sum(t[1] == label and kind in ("any", "visible" if t[3] else "unshown") for t in truth)
        points = []
        for k in range(200):
            kept = [hit for c, hit, _ in scored if c >= k / 199 - 1e-9]
            points.append((sum(kept) / len(kept) if kept else 0.0, sum(kept) / total if total else 0.0))
        return sum(max((p for p, r in points if r >= j / 10), default=0.0) for j in range(11)) / 11

    mean = lambda values: values[0] if len(values) == 1 else sum((a + b) / 2 for a, b in zip(values, values[1:])) / (len(values) - 1)
    out = {c: [mean([ap(c, kind, d) for d in deltas]) for kind in spotting.KINDS] for c in classes}
    out["Average mAP"] = [mean([sum(ap(c, kind, d) for c in classes) / len(classes) for d in deltas]) for kind in spotting.KINDS]
    if len(deltas) > 1:
        out["Average mAP"][2] *= 17 / 13
    return out


def test_performances(spark):
    random.seed(5)
    pred = sorted({(v, c, f): random.randint(0, 199) / 199 for v in range(3) for c in "ab" for f in random.sample(range(120), 25)}.items())
    pred = [(*k, conf) for k, conf in pred]
    truth = [(v, c, f, random.random() < 0.6) for v in range(2) for c in "ab" for f in random.sample(range(120), 12)]
    p = spark.createDataFrame([(*r, r[2]) for r in pred], PRED)
    t = spark.createDataFrame([(v, c, f, f, shown) for v, c, f, shown in truth], "video long, label string, frame long, ord long, visible boolean")
    for metric, deltas in (("tight", [2, 4, 6, 8, 10]), ("at2", [4])):
        got = {r.label: [r["any"], r.visible, r.unshown] for r in spotting.performances(p, t, metric, ["a", "b", "none"]).collect()}
        expected = _brute_performances(pred, truth, ["a", "b", "none"], deltas)
        assert got.keys() == expected.keys()
        for label in expected:
            assert got[label] == pytest.approx(expected[label]), (metric, label)
    with pytest.raises(ValueError):
        spotting.performances(p, t, "at9", ["a"])
