"""Documents with media into shards and back: what goes in comes out, and each policy does what it says."""

import json
import tarfile

import pytest

from matchlake.sources import conversion


def _media(root, **files):
    for name, content in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def _document(tmp_path, data, **header):
    path = tmp_path / "in.json"
    path.write_text(json.dumps({**header, "data": data}, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_round_trip(spark, tmp_path):
    media = tmp_path / "media"
    _media(media, halves__one_dot_MP4=b"film" * 1000, halves__one_dot_parquet=b"rows", halves__plain=b"")
    data = [
        {"id": "first", "inputs": [{"type": "video", "path": "halves/one.MP4", "fps": 25.0}, {"type": "tracking", "path": "halves/one.parquet"}], "labels": {"b": {"label": "é"}, "a": None}},
        {"inputs": [{"type": "video"}, {"path": "halves/plain"}, "odd"], "metadata": {"n": 1.50}},
        {"id": "bare"},
    ]
    path = _document(tmp_path, data, version="2.0", labels={"x": {"labels": ["p", "q"]}})
    folder = str(tmp_path / "set")
    counts = conversion.to_shards(spark, path, str(media), folder, per_shard=2)
    assert counts == {"num_samples": 3, "num_shards": 2, "input_files_added": 3, "missing_input_files": 0}
    meta = {r.sample_index: r for r in spark.read.parquet(folder + "/metadata.parquet").collect()}
    assert [meta[k].sample_id for k in range(3)] == ["first", "sample_000001", "bare"]
    assert [meta[k].num_inputs for k in range(3)] == [2, 1, 0]
    assert json.loads(meta[0].sample_payload) == data[0] and json.loads(meta[0].header) == {"version": "2.0", "labels": {"x": {"labels": ["p", "q"]}}}
    with tarfile.open(tmp_path / "set" / "shards" / "shard-000000.tar") as tar:
        assert tar.getnames() == ["000000000.json", "000000000.0.mp4", "000000000.1.parquet", "000000001.json", "000000001.0.bin"]
        assert tar.extractfile("000000000.json").read() == json.dumps(data[0], ensure_ascii=False, indent=2).encode()

    out = tmp_path / "back" / "out.json"
    back = conversion.from_shards(spark, folder, str(out), str(tmp_path / "back"))
    assert back == {"num_samples": 3, "extracted_input_files": 3}
    restored = json.loads(out.read_text(encoding="utf-8"))
    assert restored == {"version": "2.0", "labels": {"x": {"labels": ["p", "q"]}}, "data": [data[0], {**data[1], "id": "sample_000001"}, {"id": "bare", "inputs": []}]}
    for name in ("halves/one.MP4", "halves/one.parquet", "halves/plain"):
        assert (tmp_path / "back" / name).read_bytes() == (media / name).read_bytes()
    (tmp_path / "back" / "halves" / "plain").write_bytes(b"kept")
    assert conversion.from_shards(spark, folder, str(out), str(tmp_path / "back"))["extracted_input_files"] == 3
    assert (tmp_path / "back" / "halves" / "plain").read_bytes() == b"kept"


def test_missing_files_and_existing_folders(spark, tmp_path):
    media = tmp_path / "media"
    _media(media, there_dot_mp4=b"x")
    path = _document(tmp_path, [{"id": "s", "inputs": [{"type": "video", "path": "there.mp4"}, {"type": "video", "path": "gone.mp4"}]}])
    with pytest.raises(FileNotFoundError, match="gone.mp4"):
        conversion.to_shards(spark, path, str(media), str(tmp_path / "set"))
    counts = conversion.to_shards(spark, path, str(media), str(tmp_path / "set"), missing="skip", relative=False)
    assert (counts["input_files_added"], counts["missing_input_files"]) == (1, 1)
    rows = {r.relative_path: r for r in spark.read.parquet(str(tmp_path / "set" / "shard_manifest.parquet")).collect()}
    assert (rows["gone.mp4"].status, rows["gone.mp4"].resolved_path, rows["gone.mp4"].wds_member) == ("missing", None, None)
    assert (rows["there.mp4"].status, rows["there.mp4"].wds_member, rows["there.mp4"].input_type) == ("ok", "000000000.0.mp4", "video")
    payload = json.loads(spark.read.parquet(str(tmp_path / "set" / "metadata.parquet")).first().sample_payload)
    assert [i["path"] for i in payload["inputs"]] == [str(media / "there.mp4"), "gone.mp4"]
    with pytest.raises(FileExistsError):
        conversion.to_shards(spark, path, str(media), str(tmp_path / "set"), missing="skip")
    assert conversion.to_shards(spark, path, str(media), str(tmp_path / "set"), missing="skip", overwrite=True)["num_shards"] == 1
    with pytest.raises(ValueError):
        conversion.to_shards(spark, path, str(media), str(tmp_path / "other"), missing="perhaps")


def test_shards_by_size(spark, tmp_path):
    media = tmp_path / "media"
    _media(media, **{f"clips__{k}_dot_bin": b"x" * 3000 for k in range(5)})
    path = _document(tmp_path, [{"id": f"s{k}", "inputs": [{"path": f"clips/{k}.bin"}]} for k in range(5)])
    counts = conversion.to_shards(spark, path, str(media), str(tmp_path / "set"), shard_size=15_000)
    names = [r.shard_name for r in spark.read.parquet(str(tmp_path / "set" / "metadata.parquet")).orderBy("sample_index").collect()]
    assert names == ["shard-000000.tar", "shard-000000.tar", "shard-000001.tar", "shard-000001.tar", "shard-000002.tar"]
    assert counts["num_shards"] == 3
    for name in set(names):
        assert (tmp_path / "set" / "shards" / name).stat().st_size <= 15_000


def test_empty_document(spark, tmp_path):
    media = tmp_path / "media"
    _media(media, a_dot_bin=b"x")
    counts = conversion.to_shards(spark, _document(tmp_path, []), str(media), str(tmp_path / "set"))
    assert counts == {"num_samples": 0, "num_shards": 0, "input_files_added": 0, "missing_input_files": 0}
    with pytest.raises(ValueError):
        conversion.from_shards(spark, str(tmp_path / "set"), str(tmp_path / "out.json"))
