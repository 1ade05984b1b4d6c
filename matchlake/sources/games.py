"""Games of two halves: feature matrices read by ranges of rows, and labels by half.

A folder holds a folder for each game, in it ``1_<features>`` and ``2_<features>``, .npy matrices of a row for
each frame, and a label file. Matrices go through a data source of their own, ``npy_rows``, whose partitions are ranges of
rows, so a long matrix is read by many tasks and none holds more than a range.
"""

from __future__ import annotations

import ast
import posixpath
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import timing
from .documents import located

#: The label file and the number of classes of each version of the data.
LABEL_FILES = {1: "Labels.json", 2: "Labels-v2.json"}
CLASSES = {1: 3, 2: 17}
LABELS = "UrlLocal string, annotations array<struct<gameTime: string, label: string, position: string, team: string, visibility: string>>"


@dataclass
class RowRange(InputPartition):
    path: str
    offset: int
    dtype: str
    width: int
    first: int
    count: int


def _header(store: fs.FileSystem, path: str) -> tuple[int, np.dtype, int, int]:
    """Where the data of a .npy file begin, their type, rows and columns; more dimensions than two count as rows."""
    with store.open_input_file(path) as source:
        if source.read(6) != b"\x93NUMPY":
            raise ValueError(f"{path} is no .npy file")
        major = source.read(2)[0]
        size = int.from_bytes(source.read(2 if major == 1 else 4), "little")
        told = ast.literal_eval(source.read(size).decode("latin1" if major < 3 else "utf-8"))
        offset = source.tell()
    dtype, shape = np.dtype(told["descr"]), told["shape"]
    if dtype.hasobject or (told["fortran_order"] and len(shape) > 1 and min(shape) > 1):
        raise ValueError(f"{path} holds objects or goes by columns")
    width = shape[-1] if shape else 1
    rows = int(np.prod(shape[:-1], dtype=np.int64)) if len(shape) > 1 else 1
    return offset, dtype, rows if width else 0, width


class NpyRows(DataSource):
    """Rows (path, frame, vector) of the .npy files under a folder whose names end in ``suffix``; ``rowsPerPartition`` bounds a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "path string, frame long, vector array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.suffix = options["path"], options.get("suffix", ".npy")
        self.rows = int(options.get("rowsPerPartition", 50_000))

    def partitions(self) -> list[RowRange]:
        store, place = located(self.root)
        info = store.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix))
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(lambda p: _header(store, p), paths))
        parts = [RowRange(p, offset, dtype.str, width, k, min(self.rows, rows - k)) for p, (offset, dtype, rows, width) in zip(paths, headers, strict=True) for k in range(0, rows, self.rows)]
        return parts or [RowRange("", 0, "<f4", 0, 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        store, _ = located(self.root)
        dtype = np.dtype(part.dtype)
        step = max(1, (4 << 20) // (dtype.itemsize * part.width))
        with store.open_input_file(part.path) as source:
            for first in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - first)
                source.seek(part.offset + first * part.width * dtype.itemsize)
                rows = np.frombuffer(source.read(n * part.width * dtype.itemsize), dtype).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(first, first + n)), vectors], ["path", "frame", "vector"])


def npy_rows(spark: SparkSession, path: str, suffix: str = ".npy", rows_per_partition: int = 50_000) -> DataFrame:
    """(path, frame, vector) of the matrices under a folder, or of one."""
    spark.dataSource.register(NpyRows)
    return spark.read.format("npy_rows").option("suffix", suffix).option("rowsPerPartition", rows_per_partition).load(path)


def _of_game(path, root: str):
    """A file's game: its folder under the root, blanks as underscores."""
    start = len(located(root)[1]) + 2
    return F.replace(F.regexp_replace(F.substring(F.regexp_replace(path, "^file:/+", "/"), start, 1 << 20), "/?[^/]*$", ""), F.lit(" "), F.lit("_"))


def half_features(spark: SparkSession, root: str, features: str, rows_per_partition: int = 50_000) -> DataFrame:
    """(game, half, frame, vector) of the two matrices of each game; a half without a file has no rows."""
    rows = npy_rows(spark, root, f"_{features}", rows_per_partition)
    half = F.regexp_extract("path", r"/([12])_[^/]*$", 1).try_cast("int")
    return rows.select(_of_game(F.col("path"), root).alias("game"), half.alias("half"), "frame", "vector").where("half IS NOT NULL")


def halves(features: DataFrame) -> DataFrame:
    """(game, half, frames) of feature rows."""
    return features.groupBy("game", "half").agg((F.max("frame") + 1).alias("frames"))


def game_labels(spark: SparkSession, root: str, version: int = 2, rate: int = 2) -> DataFrame:
    """(game, ord, label, half, frame, visible) of the annotations of each game's label file, in its order; ``rate`` frames a second."""
    read = spark.read.schema(LABELS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", LABEL_FILES[version]).json(root)
    each = read.select(_of_game(F.input_file_name(), root.replace(" ", "%20")).alias("game"), F.posexplode("annotations").alias("ord", "a"))
    return each.select(
        F.replace("game", F.lit("%20"), F.lit("_")).alias("game"), F.col("ord").cast("long").alias("ord"), "a.label", timing.half_of(F.col("a.gameTime")).alias("half"), (timing.seconds_of(F.col("a.gameTime")) * rate).alias("frame"),
        F.coalesce(F.col("a.visibility") != "not shown", F.lit(True)).alias("visible"),
    )


def half_frame_labels(labels: DataFrame, lengths: DataFrame) -> DataFrame:
    """(game, half, frame, label, value): 1 where a label lies, -1 where it is not shown; labels behind a half's end lie on its last frame, the last in order wins. lengths: game, half, frames."""
    placed = labels.join(lengths.where("frames > 0"), ["game", "half"]).withColumn("frame", F.least("frame", F.col("frames") - 1))
    return placed.groupBy("game", "half", "frame", "label").agg(F.max_by(F.when(F.col("visible"), 1).otherwise(-1), "ord").alias("value"))


def half_clip_labels(labels: DataFrame, lengths: DataFrame, size: int, background: str = "background") -> DataFrame:
    """(game, half, clip, label): the labels in each clip of ``size`` frames, or the background; labels behind the last clip are dropped.

    Clips begin every ``size`` frames below the last frame, so a half of one frame has none.
    """
    n = F.ceil((F.col("frames") - 1) / size).cast("long")
    clips = lengths.where("frames > 1").select("game", "half", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("clip"))
    inside = labels.select("game", "half", F.floor(F.col("frame") / size).alias("clip"), "label").distinct()
    return clips.join(inside, ["game", "half", "clip"], "left").fillna(background, ["label"])
