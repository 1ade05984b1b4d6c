"""Window suppression of a stream of predictions, by keyed state and event-time timeouts.

Keys are dealt to buckets, whose predictions are decided together, as a call for each key costs more than its few rows.
A bucket's state holds its keys' predictions that may still be decided or still decide others. A prediction
at a frame is decided once the watermark has passed the end of its window: nothing can come any
more that lies in it. It is emitted then, if it survives, and kept as long as it reaches into windows
that are undecided. So a state spans two windows and the watermark's delay, however long the stream.

What lies within a window of the stream's end stays undecided until the watermark moves on; a
closing event of any key, far enough ahead, settles all. Events behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is held of a bucket, as bytes; ``key`` is the place in the list of its keys.
HELD = np.dtype([("key", "<i8"), ("frame", "<i8"), ("confidence", "<f8"), ("ord", "<i8"), ("decided", "?")])


def _settled(held: np.ndarray, window: int, open_from: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Of some keys' predictions: those that survive now, those still to hold, and the frame that the watermark has to pass next.

    ``open_from``: the first frame at which something may still come.
    """
    held = held[np.lexsort((held["frame"], held["key"]))]
    frames = held["frame"]
    due = ~held["decided"] & (frames + window < open_from)
    kept = np.zeros(len(held), bool)
    if due.any():
        # places: a window around a prediction is a range of them, within its key
        new = np.append(True, np.diff(held["key"]) != 0)
        steps = np.where(new, window + 1, np.append(0, np.diff(frames)))
        at = np.cumsum(np.minimum(steps, window + 1))  # further apart than a window is all the same
        strength = np.unique(held["confidence"], return_inverse=True)[1]  # NaN is the greatest
        most, asked = _range_maxima(strength), at[due]
        before = most(np.searchsorted(at, asked - window, "left"), np.searchsorted(at, asked, "left"))
        after = most(np.searchsorted(at, asked, "right"), np.searchsorted(at, asked + window, "right"))
        kept[due] = strength[due] >= np.maximum(before, after)
    held["decided"] |= due
    found, held = held[kept], held[frames + 2 * window >= open_from]
    waiting = held["frame"][~held["decided"]]
    target = int(waiting.min()) + window if len(waiting) else int(held["frame"].min()) + 2 * window if len(held) else None
    return found, held, target


def _range_maxima(values: np.ndarray):
    """A function for the greatest of each values[a:b], -1 for none, of values from 0. Tables of maxima over powers of two."""
    tables = [values]
    while len(tables[-1]) > (step := 1 << (len(tables) - 1)):
        tables.append(np.maximum(tables[-1][:-step], tables[-1][step:]))

    def most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1)
        power = np.frexp(np.maximum(b - a, 0).astype(float))[1] - 1
        for k, table in enumerate(tables):
            rows = np.flatnonzero(power == k)
            out[rows] = np.maximum(table[a[rows]], table[b[rows] - (1 << k)])
        return out

    return most


def suppress_stream(pred: DataFrame, window: int, frame_ms: float, late: str, *keys: str, buckets: int = 1024) -> DataFrame:
    """Survivors (keys, frame, confidence, ord) of a stream of predictions, as ``suppress_window`` has them.

    ``frame_ms`` milliseconds of event time to a frame, from 0, as a watermark begins at time 0; predictions may come ``late`` behind the newest. Those
    without a frame or a confidence are left out. Keys are plain values, not structs; a stream keeps its number of ``buckets`` as it keeps its checkpoint.
    """
    name = F.to_json(F.struct(F.lit("").alias("_"), *[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    rows = pred.where("frame IS NOT NULL AND confidence IS NOT NULL")
    timed = rows.select(name.alias("_name"), F.col("frame").cast("long"), F.col("confidence").cast("double"), F.col("ord").cast("long"), F.timestamp_millis(((F.col("frame") + 1) * frame_ms).cast("long")).alias("_time"))

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        names, parts = [], []
        if state.exists:
            names, parts = bytes(state.get[0]).decode().split("\n"), [np.frombuffer(bytes(state.get[1]), HELD)]
        if not state.hasTimedOut:
            known = {n: k for k, n in enumerate(names)}
            for frame in rows:
                part = np.zeros(len(frame), HELD)
                part["key"] = [known.setdefault(n, len(known)) for n in frame["_name"]]
                for column in ("frame", "confidence", "ord"):
                    part[column] = frame[column].to_numpy()
                parts.append(part)
            names = list(known)
        found, held, target = _settled(np.concatenate(parts), window, int(watermark // frame_ms))
        told = [names[k] for k in found["key"]]
        if target is None:
            state.remove()
        else:
            left, held["key"] = np.unique(held["key"], return_inverse=True)
            state.update(("\n".join(names[k] for k in left).encode(), held.tobytes()))
            state.setTimeoutTimestamp(max(int((target + 1) * frame_ms) - 1, watermark + 1))
        if len(found):
            yield pd.DataFrame({"_name": told, **{column: found[column] for column in ("frame", "confidence", "ord")}})

    dealt = timed.withColumn("_bucket", F.pmod(F.xxhash64("_name"), F.lit(buckets)))
    found = dealt.withWatermark("_time", late).groupBy("_bucket").applyInPandasWithState(step, "_name string, frame long, confidence double, ord long", "names binary, held binary", "append", GroupStateTimeout.EventTimeTimeout)
    types, read = dict(pred.dtypes), F.from_json("_name", ", ".join(["_ string", *(f"k{i} string" for i in range(len(keys)))]))
    return found.select(*[read[f"k{i}"].cast(types[k]).alias(k) for i, k in enumerate(keys)], "frame", F.coalesce("confidence", F.lit(math.nan)).alias("confidence"), "ord")  # pandas has no NaN beside null


def write_epochs(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes each micro-batch to a folder of its own, by its number; a batch that is run again replaces what it wrote before."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
