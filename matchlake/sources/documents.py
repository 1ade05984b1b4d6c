"""Reading annotation documents, raw event and tracking files, feature matrices, archives and shards.

Files are read by Spark's readers, so paths may lie in any store Spark reaches. Every scan keeps
an ordinal, as the order in a file is data.
"""

from __future__ import annotations

import io
import json
import re
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INPUT = "struct<type: string, path: string, fps: double>"
EVENT = "struct<label: string, position_ms: long, gameTime: string, half: string, frame: long, confidence: double>"
DOCUMENT = f"version string, date string, task string, labels map<string, struct<type: string, labels: array<string>>>, data array<struct<id: string, metadata: map<string, string>, inputs: array<{INPUT}>, labels: map<string, struct<label: string, confidence: double>>, events: array<{EVENT}>>>"
TRACKING = "videoTimeMs double, frameNum long, period long, game_event struct<game_event_type: string, player_name: string, player_id: string, team_id: string, home_team: boolean, video_url: string>, homePlayers array<struct<jerseyNum: string, x: double, y: double>>, awayPlayers array<struct<jerseyNum: string, x: double, y: double>>, balls array<struct<x: double, y: double, z: double>>"


def annotations(spark: SparkSession, *paths: str) -> DataFrame:
    """A row for each sample of the documents: file, sample_index, classes (of each task), id, metadata, inputs, labels, events."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(list(paths))
    each = docs.select(F.input_file_name().alias("file"), F.transform_values("labels", lambda _, v: v["labels"]).alias("classes"), F.posexplode("data").alias("sample_index", "s"))
    return each.select("file", "sample_index", "classes", "s.*")


def class_lists(samples: DataFrame) -> int:
    """How many different class lists the files of ``samples`` have; files read together must share one."""
    return samples.select(F.to_json("classes")).distinct().count()


def has_events(samples: DataFrame) -> bool:
    return not samples.where(F.size(F.coalesce("events", F.array())) > 0).isEmpty()


def json_lines(spark: SparkSession, path: str, schema: str = TRACKING) -> DataFrame:
    """Line-delimited JSON, plain, gzip or bz2; malformed lines go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, vector) of .npy matrices."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = np.load(io.BytesIO(content), allow_pickle=False)
                rows = rows.reshape(-1, rows.shape[-1])
                yield pd.DataFrame({"path": name, "frame": range(len(rows)), "vector": list(rows.astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, frame long, vector array<float>")


def zip_member(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, text) of one member of each zip file."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [zipfile.ZipFile(io.BytesIO(c)).read(member).decode() for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    plain = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), plain.rstrip("/")) if plain.startswith("/") else fs.FileSystem.from_uri(path.rstrip("/"))


def tar_members(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(path, member, content) of the members of the tar files of a path or folder whose names match ``pattern``; a file is read as a stream, so a task holds one member at a time."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(pattern)
        for frame in frames:
            for name in frame["path"]:
                store, place = located(name)
                with store.open_input_stream(place) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
                    for m in tar:
                        if m.isfile() and wanted.search(m.name):
                            yield pd.DataFrame({"path": [name], "member": [m.name], "content": [tar.extractfile(m).read()]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path).select("path").mapInPandas(read, "path string, member string, content binary")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of a written data set (sample_id, sample_index, shard_name, header, payload): the payload overlaid by the shard's sidecar."""
    meta = spark.read.parquet(f"{folder}/metadata.parquet")
    missing = {"sample_id", "sample_index", "shard_name", "header"} - set(meta.columns)
    if missing:
        raise ValueError(f"metadata lacks {', '.join(sorted(missing))}; older layouts are not read")
    sidecars = tar_members(spark, f"{folder}/shards", r"^\d{9}\.json$")
    side = sidecars.select(F.regexp_extract("member", r"^(\d{9})", 1).cast("long").alias("sample_index"), F.decode("content", "UTF-8").alias("sidecar"))

    @F.pandas_udf("string")
    def overlay(names: pd.Series, payloads: pd.Series, sides: pd.Series) -> pd.Series:
        out = []
        for name, payload, sidecar in zip(names, payloads, sides, strict=True):
            if payload is None and sidecar is None:
                raise ValueError(f"sample {name} has neither payload nor sidecar; older layouts are not read")
            out.append(json.dumps({**json.loads(payload or "{}"), **json.loads(sidecar or "{}")}, separators=(",", ":"), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    payload = F.col("sample_payload") if "sample_payload" in meta.columns else F.lit(None).cast("string")
    return meta.join(side, "sample_index", "left").select("sample_id", "sample_index", "shard_name", "header", overlay("sample_id", payload, "sidecar").alias("payload"))
