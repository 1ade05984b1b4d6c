"""A document of samples with media files into Parquet metadata and tar shards, and back.

Media never pass through the driver or a shuffle: tasks read files and write archives as streams,
through the file systems pyarrow knows. Files are written under a name of their own and moved,
so a repeated or speculative task does no harm.
"""

from __future__ import annotations

import io
import json
import re
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sizes
from ..functions.ranks import cut_lineage
from ..operators import packing
from . import large_json
from .datasets import replaced
from .documents import located, shards
from .sinks import dataset_rows, write_through

SAMPLE = "header string, sample_index long, sample_id string, payload string, sidecar_bytes long, inputs array<struct<type: string, path: string>>"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(header, sample_index, sample_id, payload, sidecar_bytes, inputs) of a document; inputs without a path are left out.

    The document is read by ranges of its bytes; ``payload`` is the sample as it stands, in compact JSON.
    """
    header, rows = large_json.elements(spark, path)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compact = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        for frame in frames:
            out = []
            for k, value in zip(frame["element"].tolist(), frame["value"], strict=True):
                sample = json.loads(value)
                inputs = [{"type": str(i.get("type", "")).strip(), "path": str(i["path"])} for i in _named_inputs(sample)]
                out.append((header, k, sample.get("id", f"sample_{k:06d}"), compact(sample), len(_sidecar(sample)), inputs))
            yield pd.DataFrame(out, columns=["header", "sample_index", "sample_id", "payload", "sidecar_bytes", "inputs"])

    return rows.mapInPandas(read, SAMPLE)


def _sidecar(sample: dict) -> bytes:
    return json.dumps(sample, ensure_ascii=False, indent=2).encode()


def _named_inputs(sample: dict) -> list[dict]:
    """The inputs that have a path."""
    listed = sample.get("inputs")
    return [i for i in listed if isinstance(i, dict) and i.get("path")] if isinstance(listed, list) else []


def media_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, full, length) of those of ``paths`` (path, relative to ``root``) that are files; empty ones too, which Spark's file scan leaves out."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = located(root)
        for frame in frames:
            full = [f"{start}/{p}" for p in frame["path"]]
            infos = store.get_file_info([located(p)[1] for p in full])
            rows = [(p, f, i.size) for p, f, i in zip(frame["path"], full, infos, strict=True) if i.type == fs.FileType.File]
            yield pd.DataFrame(rows, columns=["path", "full", "length"])

    start = re.sub(r"^file:/+", "/", root).rstrip("/")
    return paths.select("path").distinct().mapInPandas(look, "path string, full string, length long")


def to_shards(
    spark: SparkSession, document: str, media: str, folder: str, *, shard_size: int = 1_000_000_000, per_shard: int | None = None, missing: str = "raise", relative: bool = True, overwrite: bool = False, compression: str = "zstd"
) -> dict[str, int]:
    """Writes metadata.parquet, shard_manifest.parquet and shards/*.tar into ``folder``; returns counts.

    Shards hold ``per_shard`` samples, or as many as fit ``shard_size`` bytes (a larger sample has one of its own).
    A missing file raises FileNotFoundError, or with missing="skip" is left out and listed as missing.
    With relative=False the payloads of the metadata name the resolved files.
    An existing folder is refused unless ``overwrite``; the new set takes its place when it is whole.
    """
    if missing not in ("raise", "skip"):
        raise ValueError("missing must be raise or skip")
    if shard_size < 1 or (per_shard is not None and per_shard < 1):
        raise ValueError("a shard holds one byte and one sample at least")
    store, place = located(folder)
    there = store.get_file_info(place).type != fs.FileType.NotFound
    if there and not overwrite:
        raise FileExistsError(folder)
    read = cut_lineage(samples(spark, document))
    each = read.select("sample_index", "sample_id", F.posexplode("inputs").alias("input_index", "i")).select("sample_index", "sample_id", "input_index", "i.*")
    found = cut_lineage(each.join(media_files(each, media), "path", "left"))
    lost = found.where("length IS NULL")
    if missing == "raise" and not lost.isEmpty():
        raise FileNotFoundError(", ".join(r.path for r in lost.select("path").limit(5).collect()))
    held = found.groupBy("sample_index").agg(F.sum(sizes.tar_member(F.col("length"))).alias("media"))
    sized = read.join(held, "sample_index", "left").select("sample_index", (sizes.tar_member(F.col("sidecar_bytes")) + F.coalesce("media", F.lit(0))).cast("long").alias("bytes"))
    if per_shard is not None:
        packed = sized.withColumn("shard", F.floor(F.col("sample_index") / per_shard))
    else:
        packed = packing.pack_by_size(sized.withColumn("_all", F.lit(0)), "_all", "sample_index", "bytes", shard_size)
    packed = cut_lineage(packed.select("sample_index", "shard"))

    suffix = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    member = F.format_string("%09d.%d.%s", "sample_index", "input_index", F.when(suffix == "", "bin").otherwise(suffix))
    name = F.format_string("shard-%06d.tar", "shard")
    ok = F.col("length").isNotNull()
    members = found.join(packed, "sample_index").select(
        "sample_index", "sample_id", name.alias("shard_name"), "input_index", F.col("type").alias("input_type"), F.col("path").alias("relative_path"),
        F.when(ok, "path" if relative else F.col("full")).alias("resolved_path"), F.when(ok, "ok").otherwise("missing").alias("status"), F.when(ok, member).alias("wds_member"), "full",
    )
    members = cut_lineage(members)
    files = members.where("status = 'ok'").groupBy("sample_index").agg(F.array_sort(F.collect_list(F.struct("input_index", F.col("wds_member").alias("member"), F.col("full").alias("path")))).alias("files"))
    whole = cut_lineage(read.join(packed, "sample_index").join(files, "sample_index", "left"))
    rows = whole if relative else _resolved(whole)
    meta = dataset_rows(rows, F.col("header")).withColumn("suggested_shard_pattern", F.lit("shard-%06d.tar"))
    with replaced(folder) as made:
        written = _write_tars(whole.select(name.alias("shard_name"), "sample_index", "payload", "files"), f"{made}/shards")
        meta.write.option("compression", compression).parquet(f"{made}/metadata.parquet")
        members.drop("full", "sample_index").write.option("compression", compression).parquet(f"{made}/shard_manifest.parquet")
    done = members.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("lost")).first()
    return {"num_samples": read.count(), "num_shards": written, "input_files_added": done.ok, "missing_input_files": done.lost}


def _write_tars(rows: DataFrame, folder: str) -> int:
    """Writes the shards of (shard_name, sample_index, payload, files) and returns how many there are."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, place = located(folder)
        current, tar, out, draft = None, None, None, None

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()
                store.move(draft, f"{place}/{current}")

        for frame in frames:
            names = []
            for name, index, payload, files in zip(frame["shard_name"], frame["sample_index"], frame["payload"], frame["files"], strict=True):
                if name != current:
                    close()
                    current, draft = name, f"{place}/.{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                    tar = tarfile.open(fileobj=out, mode="w|")
                    names.append(name)
                side = _sidecar(json.loads(payload))
                info = tarfile.TarInfo(f"{index:09d}.json")
                info.size = len(side)
                tar.addfile(info, io.BytesIO(side))
                for one in files if files is not None else ():
                    source, path = located(one["path"])
                    info = tarfile.TarInfo(one["member"])
                    info.size = source.get_file_info(path).size
                    with source.open_input_stream(path) as content:
                        tar.addfile(info, content)
            yield pd.DataFrame({"shard_name": names})
        close()

    store, place = located(folder)
    store.create_dir(place, recursive=True)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "shard_name").sortWithinPartitions("shard_name", "sample_index").mapInPandas(write, "shard_name string").count()


def _resolved(rows: DataFrame) -> DataFrame:
    """``rows`` with the resolved files' names in their payloads."""

    @F.pandas_udf("string")
    def rewrite(payloads: pd.Series, files: pd.Series) -> pd.Series:
        out = []
        for payload, found in zip(payloads, files, strict=True):
            sample, paths = json.loads(payload), {f["input_index"]: f["path"] for f in (found if found is not None else ())}
            for k, one in enumerate(_named_inputs(sample)):
                one["path"] = paths[k] if k in paths else one["path"]
            out.append(json.dumps(sample, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    return rows.withColumn("payload", rewrite("payload", "files"))


def from_shards(spark: SparkSession, folder: str, document: str, media: str | None = None, overwrite: bool = False) -> dict[str, int]:
    """Writes the document of a data set of shards, samples in order, and with ``media`` its media files there; returns counts.

    Files that exist are counted, and written again only with ``overwrite``. The document is one file,
    so one task writes it: sorted outside memory if need be, a sample at a time.
    """
    rows = cut_lineage(shards(spark, folder))
    head = rows.select("header").limit(1).collect()
    if not head:
        raise ValueError("the data set has no samples")
    header = json.loads(head[0].header)
    if not isinstance(header, dict):
        raise ValueError("the header must be a JSON object")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = located(document)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft, n = f"{path}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(draft) as out:
            opening = json.dumps({k: v for k, v in header.items() if k != "data"}, ensure_ascii=False, indent=2)[:-1].rstrip()
            out.write((opening + ("," if len(opening) > 1 else "") + '\n  "data": [').encode())
            for frame in frames:
                for name, payload in zip(frame["sample_id"], frame["payload"], strict=True):
                    sample = json.loads(payload)
                    sample.setdefault("id", name)
                    if not isinstance(sample.setdefault("inputs", []), list):
                        raise ValueError(f"the inputs of sample {name} are no list")
                    text = json.dumps(sample, ensure_ascii=False, indent=2).replace("\n", "\n    ")
                    out.write((("," if n else "") + "\n    " + text).encode())
                    n += 1
            out.write(b"\n  ]\n}\n")
        store.move(draft, path)
        yield pd.DataFrame({"n": [n]})

    count = rows.select("sample_index", "sample_id", "payload").repartition(1).sortWithinPartitions("sample_index").mapInPandas(write, "n long").first().n
    return {"num_samples": count, "extracted_input_files": 0 if media is None else _extract(rows, folder, media, overwrite)}


def _extract(rows: DataFrame, folder: str, media: str, overwrite: bool) -> int:
    """Writes the media of the shards to the paths their samples name; a shard's paths are one group."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        paths = {f"{i:09d}.{k}": one["path"] for i, payload in zip(group["sample_index"], group["payload"], strict=True) for k, one in enumerate(_named_inputs(json.loads(payload)))}
        source, tar_path = located(f"{folder.rstrip('/')}/shards/{group['shard_name'].iloc[0]}")
        store, place = located(media)
        n = 0
        with source.open_input_stream(tar_path) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
            for m in tar:
                path = paths.get(".".join(m.name.split(".")[:2])) if m.isfile() else None
                if path is None:
                    continue
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} lies outside the media folder")
                n += 1
                if overwrite or store.get_file_info(f"{place}/{path}").type == fs.FileType.NotFound:
                    write_through(store, f"{place}/{path}", tar.extractfile(m))
        return pd.DataFrame({"n": [n]})

    plan = rows.select("shard_name", "sample_index", "payload")
    return plan.groupBy("shard_name").applyInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
