"""Chunks that are settled together, against plain loops over each key."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from matchlake.operators import spotting

from .test_operators import PRED, _brute_greedy, _brute_nearest, _brute_strongest


def chunks(sizes, seed=1):
    """Arrow batches of 7 rows with chunks of the sizes given, one after the other."""
    rng = random.Random(seed)
    rows = [(f, c, k == 0) for c, n in enumerate(sizes) for k, f in enumerate(sorted(rng.randrange(-50, 50) for _ in range(n)))]
    table = pa.table({"frame": [r[0] for r in rows], "_chunk": [r[1] for r in rows], "_new": [r[2] for r in rows]})
    return rows, table.to_batches(max_chunksize=7)


@pytest.mark.parametrize("sizes", [[1], [3, 1, 2] * 40, [90], [5, 90, 1, 1], [7] * 12])
def test_small_chunks_are_settled_together(monkeypatch, sizes):
    monkeypatch.setattr(spotting, "TOGETHER_ROWS", 20)
    calls = []

    def settle(x: pd.DataFrame) -> pd.DataFrame:
        calls.append(x)
        return x[["frame", "_chunk"]]

    rows, batches = chunks(sizes)
    halo = 9
    told = list(spotting._settle_together(settle, ["frame", "_chunk", "_new"], halo, None)(iter(batches)))
    assert [c for b in told for c in b.column("_chunk").to_pylist()] == [r[1] for r in rows]
    assert len(calls) <= len(rows) // 20 + 1 and max(map(len, calls)) <= 20 + 7 + max(sizes)
    for x in calls:
        frames, chunk = x["frame"].to_numpy(), x["_chunk"].to_numpy()
        assert (np.diff(frames)[np.diff(chunk) != 0] > halo).all()  # no row touches one of another chunk
    own, seen = defaultdict(list), defaultdict(list)
    for f, c, _ in rows:
        own[c].append(f)
    for x in calls:
        for f, c in zip(x["frame"], x["_chunk"], strict=True):
            seen[c].append(f)
    assert all([f - own[c][0] for f in own[c]] == [f - seen[c][0] for f in seen[c]] for c in own)


def test_far_apart_frames_are_settled_one_by_one():
    table = pa.table({"frame": [-(2**60), 5, 2**60, 1, 2], "_new": [True, False, False, True, False]})
    calls = []
    list(spotting._settle_together(lambda x: calls.append(x["frame"].tolist()) or x[["frame"]], ["frame", "_new"], 3, None)(iter(table.to_batches())))
    assert calls == [[-(2**60), 5, 2**60], [1, 2]]


@pytest.mark.parametrize("rows", [30, 100_000])
def test_many_keys_by_brute_force(spark, monkeypatch, rows):
    """Keys of a few rows each, null ones too, in whole and cut into chunks; several tolerances share their rounds."""
    monkeypatch.setattr(spotting, "CHUNK_ROWS", rows)
    monkeypatch.setattr(spotting, "TOGETHER_ROWS", 64)
    rng = random.Random(rows)
    video = lambda: rng.choice([None, *range(25)])
    pred = [(video(), rng.choice("ab"), rng.randrange(-200, 200), rng.choice([rng.random(), 0.5]), k) for k in range(1500)]
    truth = [(video(), rng.choice("ab"), rng.randrange(-200, 200), 0.0, k) for k in range(500)]
    p, t = spark.createDataFrame(pred, PRED), spark.createDataFrame(truth, PRED)
    nearest = {(r.tolerance, r.ord): r.hit for r in spotting.match_nearest_each(p, t, [3, 8]).collect()}
    assert nearest == {(d, o): hit for d in (3, 8) for o, hit in _brute_nearest(pred, truth, d).items()}
    strongest = {(r.delta, r.ord): r.hit for r in spotting.match_strongest_each(p, t, [7.0, 18.0]).collect()}
    assert strongest == {(d, o): hit for d in (7.0, 18.0) for o, hit in _brute_strongest(pred, truth, d).items()}
    assert {r.ord for r in spotting.suppress_greedy(p, 11, 0.2, "video", "label").collect()} == _brute_greedy(pred, 11, 0.2)


def test_tolerances_share_their_rounds(spark, monkeypatch):
    rounds = []
    inner = spotting._by_chunk
    monkeypatch.setattr(spotting, "_by_chunk", lambda *a: rounds.append(a[3]) or inner(*a))
    rng = random.Random(3)
    pred = spark.createDataFrame([(rng.randrange(5), rng.choice("ab"), rng.randrange(100), rng.random(), k) for k in range(200)], PRED)
    truth = spark.createDataFrame([(rng.randrange(5), rng.choice("abc"), rng.randrange(100), 0.0, k) for k in range(60)], PRED)
    found = {r.tolerance: r.mean_ap for r in spotting.mean_average_precision(pred, truth, [1, 4, 9]).collect()}
    assert len(rounds) == 1
    for tolerance, mean in found.items():
        alone = spotting.average_precision(spotting.match_nearest(pred, truth, tolerance), truth, [spotting.F.desc("confidence"), spotting.F.col("ord")]).collect()
        assert mean == pytest.approx(sum(r.ap for r in alone) / 3) and len(alone) == 3
    assert sorted(found) == [1, 4, 9]
