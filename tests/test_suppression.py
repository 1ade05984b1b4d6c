"""Window suppression of tables and streams against plain loops."""

import glob
import os
import random
import time

import pandas as pd
import pytest

from matchlake.operators import spotting
from matchlake.streaming import suppression

PRED = "video long, label string, frame long, confidence double, ord long"


def brute(rows, window):
    return {r[4] for r in rows if r[3] is not None and (r[2] is None or not any(q[:2] == r[:2] and q[2] is not None and q[3] is not None and 0 < abs(q[2] - r[2]) <= window and q[3] > r[3] for q in rows))}


def predictions(n, seed, spread=2000):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2]), rng.choice("ab"), rng.randrange(spread), rng.choice([rng.random(), 0.5]), k) for k in range(n)]


@pytest.mark.parametrize("window", [0, 1, 2, 7, 100, 5000])
def test_window_suppression_by_brute_force(spark, window):
    """With negative frames, ties, nulls and keys that are null."""
    rows = [(v, c, f - 300, x, k) for v, c, f, x, k in predictions(400, window, 600)] + [(1, "a", None, 0.1, 1000), (1, "a", 5, None, 1001), (None, "a", 5, 0.3, 1002), (None, "a", 6, 0.4, 1003), (1, None, 6, 0.4, 1004)]
    got = [r.ord for r in spotting.suppress_window(spark.createDataFrame(rows, PRED), window, "video", "label").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, window)


def test_window_suppression_keeps_the_columns(spark):
    rows = spark.createDataFrame([(1, 3, 0.5, "x"), (1, 4, 0.6, "y")], "_key0 long, frame long, confidence double, _near string")
    got = spotting.suppress_window(rows, 2, "_key0")
    assert got.columns == rows.columns and [tuple(r) for r in got.collect()] == [(1, 4, 0.6, "y")]
    assert spotting.suppress_window(rows.where("false"), 2, "_key0").count() == 0


def feed(folder, rows, batches, jitter, seed):
    """Files in the order of arrival, up to ``jitter`` frames out of order, and a closing one."""
    rng = random.Random(seed)
    arrived = sorted(rows, key=lambda r: r[2] + rng.randrange(jitter + 1))
    cuts = [k * len(arrived) // batches for k in range(batches + 1)]
    parts = [arrived[a:b] for a, b in zip(cuts, cuts[1:])] + [[(-1, "end", 10**6, 0.0, -1)]]
    os.makedirs(folder)
    for k, part in enumerate(parts):
        pd.DataFrame(part, columns=["video", "label", "frame", "confidence", "ord"]).to_parquet(f"{folder}/{k:03d}.parquet")
        os.utime(f"{folder}/{k:03d}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))


@pytest.mark.parametrize("batches", [1, 3, 12])
def test_stream_equals_table(spark, tmp_path, batches):
    rows, window = predictions(300, batches), 60
    feed(str(tmp_path / "in"), rows, batches, 40, batches)
    stream = lambda: spark.readStream.schema(PRED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        found = suppression.suppress_stream(stream(), window, 1000, "41 seconds", "video", "label")
        suppression.write_epochs(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).where("video > 0").collect())

    want = sorted(brute(rows, window))
    assert want == sorted(r.ord for r in spotting.suppress_window(spark.createDataFrame(rows, PRED), window, "video", "label").collect())
    assert run() == want
    # the last batches are run again, as after a failure between result and commit
    last = sorted(glob.glob(str(tmp_path / "state/commits/[0-9]*")), key=lambda p: int(os.path.basename(p)))[-1]
    os.remove(last)
    for crc in glob.glob(str(tmp_path / f"state/commits/.{os.path.basename(last)}.crc")):
        os.remove(crc)
    assert run() == want and run() == want


def test_state_is_forgotten(spark, tmp_path):
    """What no open window reaches leaves the state."""
    rows = [(1, "a", f, 0.5, f) for f in range(0, 3000, 10)]
    feed(str(tmp_path / "in"), rows, 6, 0, 1)
    found = suppression.suppress_stream(spark.readStream.schema(PRED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 20, 1000, "1 second", "video", "label")
    query = suppression.write_epochs(found, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).where("video > 0").count() == len(rows)
    assert max(held) < 100 and held[-1] < 10
