"""Sinks with a commit: what is written, and what failed, repeated and clashing tasks leave."""

import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlake.sources import conversion, datasets

CLIP = "clip long, split string, game_id string, game_time string, position_ms long, team string, label string, source_fps double, frame_interval int, window_size int"


def files(folder):
    return sorted(os.path.relpath(p, folder) for p in glob.glob(f"{folder}/**/*", recursive=True) if os.path.isfile(p))


def test_files_and_parquet(spark, tmp_path):
    rows = [(f"d/{k % 3}.txt", k, f"{k};".encode()) for k in range(30)] + [("empty", 0, None)]
    datasets.save(spark.createDataFrame(rows, "path string, part long, content binary"), str(tmp_path / "a"), "part")
    assert files(tmp_path / "a") == ["d/0.txt", "d/1.txt", "d/2.txt", "empty"] and not glob.glob(str(tmp_path / "a" / ".drafts*"))
    assert (tmp_path / "a/d/1.txt").read_text() == "".join(f"{k};" for k in range(1, 30, 3)) and (tmp_path / "a/empty").read_text() == ""
    table = spark.range(100).select(F.format_string("p%d.parquet", F.col("id") % 4).alias("path"), (-F.col("id")).alias("x"))
    datasets.save(table, str(tmp_path / "b"), "x", parquet=True)
    assert pd.read_parquet(tmp_path / "b/p3.parquet")["x"].tolist() == list(range(-99, 0, 4))
    with pytest.raises(Exception, match="outside the folder"):
        datasets.save(spark.createDataFrame([("../x", b"")], "path string, content binary"), str(tmp_path / "c"))
    assert files(tmp_path) == ["a/d/0.txt", "a/d/1.txt", "a/d/2.txt", "a/empty", *(f"b/p{k}.parquet" for k in range(4))]


def test_a_failed_task_leaves_the_old_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.txt", str(k)) for k in range(40)], "path string, content string")
    datasets.save(rows, str(tmp_path))
    bad = rows.withColumn("content", F.when(F.col("path") == "17.txt", F.raise_error(F.lit("no such row"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="no such row"):
        datasets.save(bad, str(tmp_path))
    assert {p: (tmp_path / p).read_text() for p in files(tmp_path)} == {f"{k}.txt": str(k) for k in range(40)} and not glob.glob(str(tmp_path / ".drafts*"))
    datasets.save(rows.withColumn("content", F.lit("new")), str(tmp_path))
    assert {(tmp_path / p).read_text() for p in files(tmp_path)} == {"new"} and len(files(tmp_path)) == 40


def test_rows_of_a_path_in_two_tasks_are_refused(spark, tmp_path):
    rows = spark.range(8).select(F.lit("one").alias("path"), F.lit("x").cast("binary").alias("content")).repartition(4)
    spark.dataSource.register(datasets.CommittedFiles)
    with pytest.raises(Exception, match="two tasks"):
        rows.write.format("committed_files").mode("append").save(str(tmp_path))
    assert files(tmp_path) == []


def test_replaced_folder(tmp_path):
    folder = tmp_path / "set"
    for text in ("old", "new"):
        with datasets.replaced(str(folder)) as place:
            os.makedirs(place)
            open(f"{place}/x", "w").write(text)
    with pytest.raises(RuntimeError), datasets.replaced(str(folder)) as place:
        os.makedirs(place)
        open(f"{place}/x", "w").write("broken")
        raise RuntimeError
    assert (folder / "x").read_text() == "new" and os.listdir(tmp_path) == ["set"]


def test_a_set_of_shards_survives_a_failed_overwrite(spark, tmp_path):
    document, media = tmp_path / "d.json", tmp_path / "media"
    media.mkdir()
    (media / "a.mp4").write_bytes(b"abc")
    document.write_text(json.dumps({"data": [{"id": "s", "inputs": [{"path": "a.mp4"}]}]}))
    conversion.to_shards(spark, str(document), str(media), str(tmp_path / "set"))
    before = {p: (tmp_path / "set" / p).read_bytes() for p in files(tmp_path / "set")}
    document.write_text(json.dumps({"data": [{"id": "s", "inputs": [{"path": "gone.mp4"}]}]}))
    with pytest.raises(FileNotFoundError):
        conversion.to_shards(spark, str(document), str(media), str(tmp_path / "set"), overwrite=True)
    (media / "b.mp4").symlink_to(media / "a.mp4")
    document.write_text(json.dumps({"data": [{"id": "t", "inputs": [{"path": "b.mp4"}]}]}))
    original = conversion.dataset_rows
    conversion.dataset_rows = lambda *a: (_ for _ in ()).throw(RuntimeError("late"))
    try:
        with pytest.raises(RuntimeError, match="late"):
            conversion.to_shards(spark, str(document), str(media), str(tmp_path / "set"), overwrite=True)
    finally:
        conversion.dataset_rows = original
    assert {p: (tmp_path / "set" / p).read_bytes() for p in files(tmp_path / "set")} == before
    assert sorted(os.listdir(tmp_path)) == ["d.json", "media", "set"]


def test_clip_data_set(spark, tmp_path):
    clips = spark.createDataFrame([(k, ["train", "test"][k % 3 == 0], f"g{k % 2}", "1 - 00:01", 1000 * k, None, "PASS", [25.0, None][k % 2], k % 4, 16) for k in range(9)], CLIP)
    tracking = spark.createDataFrame([(k, s, 10 * k - s) for k in range(9) for s in (2, 0, 1)], "clip long, slot int, x long")
    datasets.save_clips(clips, tracking, str(tmp_path / "set"), ["PASS", "SHOT"], "2024-01-01")
    assert len(files(tmp_path / "set")) == 9 + 2
    train = json.loads((tmp_path / "set/annotations_train.json").read_text())
    assert [train[k] for k in ("version", "date", "task", "dataset_name", "modalities")] == ["2.0", "2024-01-01", "action_classification", "soccernet_gar_tracking_train", ["tracking_parquet"]]
    assert train["labels"] == {"action": {"type": "single_label", "labels": ["PASS", "SHOT"]}} and [d["id"] for d in train["data"]] == [f"train_{k:06d}" for k in range(6)]
    one = train["data"][1]  # clip 2
    assert one["inputs"] == [{"type": "tracking_parquet", "path": "train/clip_000001.parquet"}] and one["labels"] == {"action": {"label": "PASS"}}
    assert one["metadata"] == {"game_id": "g0", "game_time": "1 - 00:01", "position_ms": 2000, "team": None, "source_fps": 25.0, "effective_fps": 12.5, "window_size": 16, "frame_interval": 2}
    assert train["data"][0]["metadata"]["effective_fps"] is None
    assert pd.read_parquet(tmp_path / "set/train/clip_000001.parquet").to_dict("list") == {"x": [20, 19, 18]}


def test_spotting_data_set(spark, tmp_path):
    events = spark.createDataFrame([("train", "g1", "SHOT", 900, "1 - 00:00", "home", 0), ("train", "g1", "PASS", 100, "1 - 00:00", None, 1), ("train", "g2", "PASS", 5, "x", None, 2), ("valid", "g3", "PASS", 5, "x", None, 3)], "split string, game_id string, label string, position_ms long, game_time string, team string, ord long")
    tracking = spark.createDataFrame([("g1", 30.0, 3, "c"), ("g1", 10.0, 1, "a"), ("g1", 10.0, 1, "a"), ("g1", 20.0, 2, "b"), ("g3", 1.0, 1, "z"), ("g9", 1.0, 1, "none")], "game_id string, videoTimeMs double, frameNum long, balls string")
    lost = datasets.save_spotting(events, tracking, str(tmp_path / "set"), ["PASS", "SHOT"], 25.0, "2024-01-01")
    assert [tuple(r) for r in lost.collect()] == [("train", "g2")]
    assert files(tmp_path / "set") == ["annotations_train.json", "annotations_valid.json", "train/g1.parquet", "valid/g3.parquet"]
    train = json.loads((tmp_path / "set/annotations_train.json").read_text())
    assert train["data"] == [{"inputs": [{"type": "tracking", "path": "train/g1.parquet", "fps": 25.0}], "events": [{"label": "PASS", "position_ms": 100, "gameTime": "1 - 00:00", "team": None}, {"label": "SHOT", "position_ms": 900, "gameTime": "1 - 00:00", "team": "home"}]}]
    assert pd.read_parquet(tmp_path / "set/train/g1.parquet").to_dict("list") == {"videoTimeMs": [10.0, 20.0, 30.0], "frameNum": [1, 2, 3], "balls": ["a", "b", "c"]}


def test_split_manifests(spark, tmp_path):
    games = spark.createDataFrame([("g2", "train"), ("g1", "train"), ("g3", "valid")], "game_id string, split string")
    notes = spark.createDataFrame([("g1", 1, "SHOT", 90), ("g1", 0, "PASS", 10)], "game_id string, ord long, label string, position long")
    datasets.save_manifests(games, notes, str(tmp_path), "parquet", 29.97, ["PASS", "SHOT"])
    assert files(tmp_path) == ["train/train.json", "valid/valid.json"]
    assert json.loads((tmp_path / "train/train.json").read_text()) == {
        "version": 1, "format": "parquet", "labels": ["PASS", "SHOT"], "videos": [
            {"path": "videos/g1.parquet", "input_type": "parquet", "source_fps": 29.97, "gameId": "g1", "annotations": [{"label": "PASS", "position": 10}, {"label": "SHOT", "position": 90}]},
            {"path": "videos/g2.parquet", "input_type": "parquet", "source_fps": 29.97, "gameId": "g2"},
        ],
    }
