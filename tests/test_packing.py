"""Packing by size against the fold."""

import random

import pytest

from matchlake.operators import packing


def fold(sizes, limit):
    out, shard, total = [], 0, 0
    for m in sizes:
        if total and -(-(total + m + 1024) // 10240) * 10240 > limit:
            shard, total = shard + 1, 0
        total += m
        out.append(shard)
    return out


@pytest.mark.parametrize("limit", [5_000, 10_240, 40_960, 100_000])
@pytest.mark.parametrize("shards", [1, 2, 64])
def test_packing_equals_the_fold(spark, monkeypatch, limit, shards):
    """Groups of many blocks and of one sample, with equal, oversized, empty and null sizes and a null group."""
    monkeypatch.setattr(packing, "BLOCK_SHARDS", shards)
    rng = random.Random(limit + shards)
    sizes = {"a": [rng.choice([512, 1024, 4608, 0, 9216]) for _ in range(300)], "b": [rng.choice([0, 0, None, 700_000, 512, 39_936, 39_937]) for _ in range(120)], None: [512] * 90, "one": [7], "none": [0, 0, None], "big": [10**6, 0, 10**6, 512, 0, 512]}
    rows = [(g, k, m, "kept") for g, found in sizes.items() for k, m in enumerate(found)]
    rng.shuffle(rows)
    got = packing.pack_by_size(spark.createDataFrame(rows, "g string, k long, m long, note string"), "g", "k", "m", limit)
    assert got.columns == ["g", "k", "m", "note", "shard"]
    found = {(r.g, r.k): r.shard for r in got.collect()}
    assert found == {(g, k): s for g, each in sizes.items() for k, s in enumerate(fold([m or 0 for m in each], limit))}


def test_packing_of_nothing(spark):
    assert packing.pack_by_size(spark.createDataFrame([], "g string, k long, m long"), "g", "k", "m", 40_960).count() == 0


def test_short_videos(spark):
    """Videos shorter than a clip or its overlap have no clips rather than wrong ones."""
    from matchlake.operators import alignment, records

    videos = spark.createDataFrame([(n, n) for n in (0, 1, 3, 4, 9)], "video long, n long")
    starts = lambda **k: sorted((r.video, r.start) for r in alignment.clip_starts(videos, "n", 5, 3, **k).collect())
    assert starts(pad=0) == [(4, 0), (9, 0), (9, 2), (9, 4)]
    loop = lambda n, pad, stride, whole: list(range(-pad * stride, max(0, n - 3 * stride * whole), 2 * stride))
    for pad, stride, partial in ((1, 1, False), (2, 2, True), (0, 3, True)):
        assert starts(pad=pad, stride=stride, partial_end=partial) == [(n, k) for n in (0, 1, 3, 4, 9) for k in loop(n, pad, stride, not partial)]
    clips = spark.createDataFrame([(1, 0), (2, 2)], "video long, n_clips long")
    labels = spark.createDataFrame([(2, 1, "x")], "video long, clip long, label string")
    assert sorted(tuple(r) for r in records.clips_with_events(labels, clips).collect()) == [(2, 0, 0, False), (2, 1, 1, True)]
    for call in (lambda: alignment.clip_starts(videos, "n", 3, 3, 0), lambda: records.filled_clips(videos, "n", 3, 3, 8)):
        with pytest.raises(ValueError):
            call()


def test_positions_of_the_side_that_the_event_names(spark):
    from matchlake.operators import annotations, records
    from pyspark.sql import functions as F

    frames = spark.createDataFrame([(1, "g", (True, "t1"), [("7",)], [("7",)]), (2, "g", (False, "t2"), [("7",)], [("7",)]), (3, "g", None, [("7",)], [("9",)])], "n int, game string, game_event struct<home_team: boolean, team_id: string>, homePlayers array<struct<jersey: string>>, awayPlayers array<struct<jersey: string>>")
    squad = spark.createDataFrame([("g", "t1", "7", "GK"), ("g", "t2", "7", "CB")], "game string, team string, jersey string, position string")
    got = {r.n: (r.homePlayers[0].position, r.awayPlayers[0].position) for r in records.sided_positions(frames, "game_event", "homePlayers", "awayPlayers", squad).collect()}
    assert got == {1: ("GK", None), 2: (None, "CB"), 3: (None, None)}
    header = spark.createDataFrame([({"hf_repo_id": " a/b ", "hf_branch": "", "x": "y"},)], "h map<string,string>")
    assert tuple(header.select(records.stamp(F.col("h")).alias("s")).first().s) == ("a/b", None, None)
    shares = annotations.label_shares(spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), (None, None)], "split string, label string"), "split", "label")
    assert sorted((str(r.split), str(r.label), r.n, r.percent) for r in shares.collect()) == [("None", "None", 1, 25.0), ("None", "x", 2, 50.0), ("None", "y", 1, 25.0), ("a", "None", 0, 0.0), ("a", "x", 1, 50.0), ("a", "y", 1, 50.0)]


def test_rising_confidences_take_few_rounds(spark, monkeypatch):
    """Each prediction can take its own truth or the next one's, so every chunk waits for the one behind it."""
    from matchlake.operators import spotting

    rounds = []
    inner = spotting._by_chunk
    monkeypatch.setattr(spotting, "CHUNK_ROWS", 40)
    monkeypatch.setattr(spotting, "_by_chunk", lambda *a: rounds.append(a[3]) or inner(*a))
    n = 800
    kind = "video long, label string, frame long, confidence double, ord long"
    pred = spark.createDataFrame([(1, "a", 10 * k, k / n, k) for k in range(n)], kind)
    truth = spark.createDataFrame([(1, "a", 10 * k + 5, 1.0, k) for k in range(n)], kind)
    hits = {r.ord: r.hit for r in spotting.match_nearest(pred, truth, 6).select("ord", "hit").collect()}
    free, want = set(range(n)), {}
    for k in reversed(range(n)):
        near = [g for g in (k - 1, k) if g in free]
        want[k] = bool(near)
        free -= set(near[:1])
    assert hits == want and len(rounds) <= 12
