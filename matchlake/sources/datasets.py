"""Data sets of many files, written by tasks and made whole by one commit.

Two sinks for ``df.write``: ``committed_files`` appends the rows of a path (path, content) to one file, and ``committed_parquet``
writes the rows of a path as one Parquet file. Tasks write drafts; a task that fails removes its own, the
driver moves those of the tasks that succeeded when all have, and else removes them. So a failed job leaves what was
there before, and a repeated or speculative task leaves nothing. Rows have to come sorted by path, as ``by_path`` lays them.

``replaced`` does the same for a whole folder: a set is built beside the old one and takes its place when it is whole.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.ranks import ranked
from .documents import located


@dataclass
class Drafts(WriterCommitMessage):
    """What a task wrote: drafts and the names they are to have."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Drafts of the files that a task's rows name, one open at a time."""

    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, uuid.uuid4().hex

    def _drafts(self) -> str:
        return f"{located(self.folder)[1]}/.drafts-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        store, place = located(self.folder)
        store.create_dir(self._drafts(), recursive=True)
        files: list[tuple[str, str]] = []
        current, out = None, None
        try:
            for batch in iterator:
                paths = batch.column("path").to_pylist()
                start = 0
                while start < len(paths):
                    stop = start + 1
                    while stop < len(paths) and paths[stop] == paths[start]:
                        stop += 1
                    if paths[start] != current:
                        if out is not None:
                            self.close(out)
                        current = paths[start]
                        if current is None or current.startswith("/") or ".." in current.split("/"):
                            raise ValueError(f"{current} lies outside the folder")
                        files.append((f"{self._drafts()}/{uuid.uuid4().hex}", f"{place}/{current}"))
                        out = self.open(store, files[-1][0], batch.schema)
                    self.append(out, batch.slice(start, stop - start))
                    start = stop
            if out is not None:
                self.close(out)
        except BaseException:
            with contextlib.suppress(Exception):
                if out is not None:
                    self.close(out)
            for draft, _ in files:
                with contextlib.suppress(OSError):
                    store.delete_file(draft)
            raise
        return Drafts(files)

    def commit(self, messages: list[Drafts | None]) -> None:
        store, _ = located(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one path came to two tasks")

        def move(one: tuple[str, str]) -> None:
            store.create_dir(one[1].rsplit("/", 1)[0], recursive=True)
            store.move(*one)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, files))
        self.abort(messages)

    def abort(self, messages: list[Drafts | None]) -> None:
        store, _ = located(self.folder)
        if store.get_file_info(self._drafts()).type == fs.FileType.Directory:
            store.delete_dir(self._drafts())

    def open(self, store: fs.FileSystem, path: str, schema: pa.Schema):
        return store.open_output_stream(path)

    def append(self, out, rows: pa.RecordBatch) -> None:
        for content in rows.column("content"):
            out.write(content.as_py() or b"")

    def close(self, out) -> None:
        out.close()


class _ParquetWriter(_Writer):
    def open(self, store: fs.FileSystem, path: str, schema: pa.Schema):
        sink = store.open_output_stream(path)
        inner = pa.schema([f for f in schema if f.name != "path"])
        return sink, pq.ParquetWriter(sink, inner, compression="zstd")

    def append(self, out, rows: pa.RecordBatch) -> None:
        out[1].write_batch(rows.select([n for n in rows.schema.names if n != "path"]))

    def close(self, out) -> None:
        out[1].close()
        out[0].close()


class CommittedFiles(DataSource):
    """Files of the rows (path, content)."""

    kind = _Writer

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return self.kind(self.options["path"])


class CommittedParquet(CommittedFiles):
    """A Parquet file of the rows of each path."""

    kind = _ParquetWriter

    @classmethod
    def name(cls) -> str:
        return "committed_parquet"


def by_path(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with all of a path in one task, and in order there."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", *order)


def save(rows: DataFrame, folder: str, *order: str, parquet: bool = False) -> None:
    """Writes the files that ``rows`` name below a folder: text or bytes of (path, content), or Parquet of the columns besides ``path`` and ``order``."""
    kind = CommittedParquet if parquet else CommittedFiles
    rows.sparkSession.dataSource.register(kind)
    laid = by_path(rows, *order)
    laid = laid.drop(*[c for c in order if parquet and c.startswith("_")]) if parquet else laid.select("path", F.col("content").cast("binary"))
    laid.write.format(kind.name()).mode("append").save(folder)


@contextlib.contextmanager
def replaced(folder: str) -> Iterator[str]:
    """A place to build what is to stand in ``folder``; it takes the place of what stands there if nothing fails, else it goes."""
    store, place = located(folder)
    mark = uuid.uuid4().hex
    made, old = f"{place}.new-{mark}", f"{place}.old-{mark}"
    address = folder.rstrip("/")
    try:
        yield f"{address}.new-{mark}"
        if store.get_file_info(place).type != fs.FileType.NotFound:
            store.move(place, old)
        try:
            store.move(made, place)
        except BaseException:
            if store.get_file_info(old).type != fs.FileType.NotFound:
                store.move(old, place)
            raise
    except BaseException:
        if store.get_file_info(made).type != fs.FileType.NotFound:
            store.delete_dir(made)
        raise
    if store.get_file_info(old).type != fs.FileType.NotFound:
        store.delete_dir(old)


def documents(entries: DataFrame, header: Column, order: list[str], field: str = "data") -> DataFrame:
    """(path, part, content) of a JSON document for each path: the members of ``header`` (JSON), then the entries (JSON) in order as ``field``."""
    placed = entries.withColumn("part", F.row_number().over(Window.partitionBy("path").orderBy(*order)))
    each = placed.select("path", F.col("part").cast("long").alias("part"), F.concat(F.when(F.col("part") > 1, ",\n    ").otherwise("\n    "), F.col("entry")).alias("content"))
    heads = entries.select("path", header.alias("_h")).distinct().select("path", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("part"), F.concat(F.regexp_replace("_h", r"\}\s*$", ""), F.when(F.col("_h").rlike(r"^\s*\{\s*\}\s*$"), "").otherwise(","), F.lit(f'\n  "{field}": [')).alias("content")),
        F.struct(F.lit((1 << 63) - 1).alias("part"), F.lit("\n  ]\n}\n").alias("content")),
    )).alias("x")).select("path", "x.*")
    return each.unionByName(heads)


def _header(dataset: Column, task: str, labels: list[str], date: str, **more: Column) -> Column:
    own = F.struct(F.lit("single_label").alias("type"), F.array(*map(F.lit, labels)).alias("labels"))
    return F.to_json(F.struct(F.lit("2.0").alias("version"), F.lit(date).alias("date"), F.lit(task).alias("task"), dataset.alias("dataset_name"), *[c.alias(k) for k, c in more.items()], F.struct(own.alias("action")).alias("labels")))


def clip_names(clips: DataFrame, *order: str) -> DataFrame:
    """``clips`` (split, ...) with ``index`` from 0 in the split, ``id`` and ``tracking_path``."""
    each = ranked(clips, "split", *order)
    first = each.groupBy("split").agg(F.min("rank").alias("_first"))
    index = (F.col("rank") - F.col("_first")).alias("index")
    return each.join(F.broadcast(first), "split").select(*clips.columns, index).withColumns(
        {"id": F.format_string("%s_%06d", "split", "index"), "tracking_path": F.format_string("%s/clip_%06d.parquet", "split", "index")}
    )


def clip_entries(named: DataFrame) -> DataFrame:
    """(path, index, split, entry) of named clips (game_id, game_time, position_ms, team, label, source_fps, frame_interval, window_size): an annotation for each."""
    effective = F.when((F.col("source_fps") > 0) & (F.col("frame_interval") > 0), F.col("source_fps") / F.col("frame_interval"))
    meta = F.struct("game_id", "game_time", "position_ms", "team", "source_fps", effective.alias("effective_fps"), "window_size", "frame_interval")
    inputs = F.array(F.struct(F.lit("tracking_parquet").alias("type"), F.col("tracking_path").alias("path")))
    entry = F.to_json(F.struct("id", inputs.alias("inputs"), F.struct(F.struct("label").alias("action")).alias("labels"), meta.alias("metadata")), {"ignoreNullFields": "false"})
    return named.select(F.format_string("annotations_%s.json", "split").alias("path"), "index", "split", entry.alias("entry"))


def save_clips(clips: DataFrame, tracking: DataFrame, folder: str, labels: list[str], date: str, key: str = "clip") -> None:
    """Writes a classification data set: a Parquet file of tracking rows for each clip and a document for each split.

    clips: ``key`` (unique), split and the columns of ``clip_entries``; tracking: ``key``, ``slot`` and the columns to write, by slot. An old set stays until the new one is whole.
    """
    named = clip_names(clips, key)
    with replaced(folder) as place:
        rows = tracking.join(named.select(key, F.col("tracking_path").alias("path")), key).drop(key).withColumnRenamed("slot", "_slot")
        save(rows, place, "_slot", parquet=True)
        header = _header(F.concat(F.lit("soccernet_gar_tracking_"), "split"), "action_classification", labels, date, modalities=F.array(F.lit("tracking_parquet")))
        save(documents(clip_entries(named), header, ["index"]), place, "part")


def spotting_entries(events: DataFrame, media: DataFrame, kind: str, fps: float) -> tuple[DataFrame, DataFrame]:
    """Entries (path, game_id, split, entry) of the games whose media there are, their events by position; and the games (split, game_id) left out.

    events: split, game_id, label, position_ms, game_time, team, ord; media: game_id, path.
    """
    there = events.join(media.withColumnRenamed("path", "_media"), "game_id", "left")
    event = F.struct("position_ms", "ord", F.struct("label", "position_ms", F.col("game_time").alias("gameTime"), "team").alias("e"))
    games = there.where("_media IS NOT NULL").groupBy("split", "game_id", "_media").agg(F.transform(F.array_sort(F.collect_list(event)), lambda x: x["e"]).alias("events"))
    inputs = F.array(F.struct(F.lit(kind).alias("type"), F.col("_media").alias("path"), F.lit(fps).alias("fps")))
    entries = games.select(F.format_string("annotations_%s.json", "split").alias("path"), "game_id", "split", F.to_json(F.struct(inputs.alias("inputs"), "events"), {"ignoreNullFields": "false"}).alias("entry"))
    return entries, there.where("_media IS NULL").select("split", "game_id").distinct()


def save_spotting(events: DataFrame, tracking: DataFrame, folder: str, labels: list[str], fps: float, date: str) -> DataFrame:
    """Writes a spotting data set: a Parquet file of each game's tracking rows, without repeated ones and by time, and a document for each split; the games left out for lack of rows.

    tracking: game_id, videoTimeMs, frameNum and more; of rows with equal time and frame one is kept.
    """
    split = events.select("game_id", "split").distinct()
    name = F.format_string("%s/%s.parquet", "split", "game_id").alias("path")
    media = tracking.select("game_id").distinct().join(split, "game_id").select("game_id", "split", name)
    entries, lost = spotting_entries(events, media.select("game_id", "path"), "tracking", fps)
    with replaced(folder) as place:
        rows = tracking.dropDuplicates(["game_id", "videoTimeMs", "frameNum"]).join(media.select("game_id", "path"), "game_id").drop("game_id")
        save(rows, place, "videoTimeMs", "frameNum", parquet=True)
        header = _header(F.concat(F.lit("SoccerNet GAR Spotting ("), "split", F.lit(")")), "action_spotting", labels, date, metadata=F.struct("split"))
        save(documents(entries, header, ["game_id"]), place, "part")
    return lost


def manifest_entries(games: DataFrame, annotations: DataFrame, kind: str, fps: float) -> DataFrame:
    """(path, game_id, split, entry) of each game (game_id, split): its video and, where there are any, its annotations (game_id, ord and their fields) in order."""
    fields = [c for c in annotations.columns if c not in ("game_id", "ord")]
    noted = annotations.groupBy("game_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("annotations"))
    ending = ".parquet" if kind == "parquet" else ".mp4"
    video = [F.concat(F.lit("videos/"), "game_id", F.lit(ending)).alias("path"), F.lit(kind).alias("input_type"), F.lit(fps).alias("source_fps"), F.col("game_id").alias("gameId"), "annotations"]
    return games.join(noted, "game_id", "left").select(F.format_string("%s/%s.json", "split", "split").alias("path"), "game_id", "split", F.to_json(F.struct(*video)).alias("entry"))


def save_manifests(games: DataFrame, annotations: DataFrame, folder: str, kind: str, fps: float, labels: list[str]) -> None:
    """Writes ``<split>/<split>.json`` for each split that has games."""
    header = F.to_json(F.struct(F.lit(1).alias("version"), F.lit(kind).alias("format"), F.array(*map(F.lit, labels)).alias("labels")))
    save(documents(manifest_entries(games, annotations, kind, fps), header, ["game_id"], "videos"), folder, "part")
