"""Writing prediction documents, data sets of Parquet metadata and tar shards, and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spotting import game_time


def prediction_documents(pred: DataFrame, head: str, fps: float) -> DataFrame:
    """(video, document): the JSON of each video's predictions by frame. pred: video, label, frame, position_ms, confidence."""
    event = F.struct("frame", F.lit(head).alias("head"), "label", game_time(F.col("position_ms")).alias("gameTime"), "position_ms", "confidence")
    events = F.array_sort(F.collect_list(event)).alias("events")
    source = F.array(F.struct(F.lit("video").alias("type"), F.col("video").cast("string").alias("path"), F.lit(fps).alias("fps")))
    doc = F.struct(F.lit("2.0").alias("version"), F.lit("action_spotting").alias("task"), F.array(F.struct(source.alias("inputs"), "events")).alias("data"))
    return pred.groupBy("video").agg(events).select("video", F.to_json(doc).alias("document"))


def write_documents(docs: DataFrame, folder: str, compression: str = "none") -> None:
    """One folder a video with its document as text."""
    docs.select("video", F.col("document").alias("value")).write.partitionBy("video").option("compression", compression).text(folder)


def dataset_rows(samples: DataFrame, header: str | Column) -> DataFrame:
    """Metadata rows of samples (sample_index, sample_id, payload JSON, inputs, shard); a sample without id gets one from its index."""
    kept = F.filter(F.coalesce("inputs", F.array()), lambda x: F.coalesce(x["path"], F.lit("")) != "")
    name = F.coalesce("sample_id", F.format_string("sample_%06d", "sample_index"))
    return samples.select(name.alias("sample_id"), F.col("sample_index").cast("long").alias("sample_index"), F.size(kept).cast("long").alias("num_inputs"), F.col("payload").alias("sample_payload"), F.format_string("shard-%06d.tar", "shard").alias("shard_name"), (F.lit(header) if isinstance(header, str) else header).alias("header"))


def write_through(store, path: str, content) -> None:
    """A stream's bytes as a file, under another name until it is whole."""
    folder, draft = path.rsplit("/", 1)[0], f"{path}.{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(draft) as out:
        while piece := content.read(1 << 20):
            out.write(piece)
    store.move(draft, path)


def report(classes: DataFrame, labels: list[str]) -> DataFrame:
    """(metric, one column a label) with two decimals, from per-class rows (label, precision, recall, f1)."""
    long = classes.select("label", F.explode(F.create_map(*[x for m in ("precision", "recall", "f1") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    return long.groupBy("metric").pivot("label", labels).agg(F.format_number(F.first(F.col("value") * 100), 2))
