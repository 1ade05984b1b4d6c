"""Nearest-time alignment, clip windows and label shaping over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, ordinal: str, value: str, tolerance: float | None = None) -> DataFrame:
    """``left`` with the ``value`` and ``nearest_time`` of the nearest row of ``right`` of the same key, the earlier on ties.

    Of rows with one time the last counts before it and the first after it. Beyond the tolerance
    the row goes; a difference that is not a number is not beyond it. Both sides are laid in one
    order and read with windows, so each key is sorted once and nothing is paired.
    """
    marks = right.select(key, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(ordinal).cast("long").alias("_o"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_m"))
    asked = left.select(key, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_o"), F.struct(*left.columns).alias("_row"))
    both = marks.unionByName(asked, allowMissingColumns=True)
    # A left row stands before the rows of its own time, as those count as after it.
    by = Window.partitionBy(key).orderBy(F.col("_t"), F.col("_row").isNull(), "_o")
    before = F.last("_m", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The other way round, so that the frame grows: one that shrinks would be read anew for each row.
    back = Window.partitionBy(key).orderBy(F.desc("_t"), F.col("_row").isNull().desc(), F.desc("_o"))
    after = F.last("_m", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.select("_row", "_t", before.alias("_b"), after.alias("_a")).where("_row is not null")
    first = F.col("_a.t").isNull() | (F.col("_t") - F.col("_b.t") <= F.col("_a.t") - F.col("_t"))
    chosen = found.select("_row.*", F.when(first & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("_a")).alias("_c"), "_t")
    gap = F.abs(F.col("_c.t") - F.col("_t"))
    if tolerance is not None:
        chosen = chosen.where((gap <= tolerance) | F.isnan(gap.cast("double")))
    return chosen.select(*left.columns, F.col("_c.t").alias("nearest_time"), F.col("_c.v").alias(value))


def around(events: DataFrame, frame: Column, length: int, interval: int = 1) -> DataFrame:
    """A row for each frame of the window centred on an event: (..., slot, frame)."""
    offsets = F.sequence(F.lit(0), F.lit(length - 1))
    return events.select("*", F.explode(offsets).alias("slot")).withColumn("frame", frame + (F.col("slot") - length // 2) * interval)


def frame_lookup(wanted: DataFrame, frames: DataFrame, keys: list[str], value: str, ordinal: str, default) -> DataFrame:
    """``wanted`` with the ``value`` of the first row of its frame, or the default where there is none."""
    first = frames.groupBy(*keys).agg(F.min_by(value, ordinal).alias(value))
    return wanted.join(first, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def position_map(rows: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """The last value that is not null of each key."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, ordinal).alias(value))


def clip_windows(videos: DataFrame, frames: str, stride: int, length: int, before: int = 0, end_clip: bool = False) -> DataFrame:
    """(..., clip, slot, frame): clips start every ``stride`` below frames - 1; slots beyond the ends repeat the end frames.

    With ``end_clip`` the last clip is the last ``length`` frames.
    """
    n = F.col(frames)
    starts = videos.where(n > 1).select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), n - 2, F.lit(stride).cast("long"))).alias("clip", "start"))
    if end_clip:
        last = F.floor((n - 2) / stride)
        starts = starts.withColumn("start", F.when(F.col("clip") == last, n - length + before).otherwise(F.col("start")))
    cells = starts.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("slot"))
    return cells.withColumn("frame", F.greatest(F.lit(0), F.least(F.col("start") + F.col("slot") - before, n - 1))).drop("start")


def clip_starts(videos: DataFrame, frames: str, length: int, overlap: int, pad: int, stride: int = 1, partial_end: bool = False) -> DataFrame:
    """(..., start): every (length - overlap) strides from pad strides before the video, while before max(0, frames - overlap strides).

    With ``partial_end`` starts go on to the video's end. A video that gives no clip, as it is no longer than the overlap and nothing is padded, has no rows.
    """
    if overlap >= length:
        raise ValueError("clips have to be longer than their overlap")
    end = F.greatest(F.lit(0), F.col(frames) - (0 if partial_end else overlap * stride)).cast("long")
    first = F.lit(-pad * stride).cast("long")
    return videos.select("*", F.explode(F.when(end > first, F.sequence(first, end - 1, F.lit((length - overlap) * stride).cast("long")))).alias("start"))


def deltas(rows: DataFrame, keys: list[str], time: str, values: list[str], missing: float) -> DataFrame:
    """``rows`` with d<value>: the change since the row before where both are known; 0 in the first row, ``missing`` where the row itself is."""
    by = Window.partitionBy(*keys).orderBy(time)
    for v in values:
        last = F.lag(v).over(by)
        change = F.when(F.col(v) == missing, F.lit(missing)).when(last.isNull() | (last == missing), F.lit(0.0)).otherwise(F.col(v) - last)
        rows = rows.withColumn(f"d{v}", change)
    return rows


def frame_labels(events: DataFrame, dilate: int = 0) -> DataFrame:
    """(video, frame, label) of frames under an event or within ``dilate`` of it; the last event wins."""
    spread = events.select("video", "label", "ord", F.explode(F.sequence(F.col("frame") - dilate, F.col("frame") + dilate)).alias("frame"))
    return spread.where("frame >= 0").groupBy("video", "frame").agg(F.max_by("label", "ord").alias("label"))


def tumbling_labels(events: DataFrame, size: int) -> DataFrame:
    """(video, clip, label) of the labels that occur in each tumbling window; windows without any are background."""
    return events.select("video", F.floor(F.col("frame") / size).alias("clip"), "label").distinct()


Bounds = tuple[int, int, int, int]


def _by_label(of: dict[str, Bounds] | Bounds, k: int) -> Column:
    """The k-th bound, of the row's label if each has its own; the labels are few, as the caller lists them."""
    if not isinstance(of, dict):
        return F.lit(of[k])
    return F.create_map(*[F.lit(x) for label, bounds in of.items() for x in (label, bounds[k])])[F.col("label")]


def shift_labels(frames: DataFrame, events: DataFrame, k: dict[str, Bounds] | Bounds) -> DataFrame:
    """(video, label, frame, shift): the signed distance to the last or the next event, by four bounds k1 < k2 <= 0 < k3 < k4, the same for all labels or by label.

    No event: k1 everywhere. One event: the plain offset. Otherwise the last event holds while it
    is nearer than k3; up to k4 it holds while the next is k1 away or more, or while its part of
    the way from k3 to k4 is less than the next one's from k2 to k1; then the next one holds.
    Before the first event the last is taken to be k4 before the video, after the last event the
    next is taken to be k1 behind its end. A label without bounds is an error.
    """
    if isinstance(k, dict):
        frames = frames.where(F.when(F.col("label").isin(list(k)), True).otherwise(F.raise_error(F.concat(F.lit("no bounds for "), "label")).cast("boolean")))
    k1, k2, k3, k4 = (_by_label(k, j) for j in range(4))
    spots = events.select("video", "label", "frame").distinct().withColumn("e", F.col("frame"))
    spine = frames.join(spots, ["video", "label", "frame"], "left")
    by, whole = Window.partitionBy("video", "label").orderBy("frame"), Window.partitionBy("video", "label")
    last = F.last("e", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy("video", "label").orderBy(F.desc("frame"))  # the frame grows this way
    after = F.last("e", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    read = spine.select("video", "label", "frame", last.alias("last"), after.alias("after"), F.count("e").over(whole).alias("n"), (F.max("frame").over(whole) + 1).alias("frames"))
    a = F.col("frame") - F.coalesce("last", -k4)
    b = F.col("frame") - F.coalesce(F.col("after"), F.col("frames") - k1)
    holds = (a < k3) | ((a < k4) & ((b <= k1) | ((a - k3) / (k4 - k3).cast("double") < (k2 - b) / (k2 - k1).cast("double"))))
    one = F.col("frame") - F.coalesce("last", "after")
    return read.select("video", "label", "frame", F.when(F.col("n") == 0, k1).when(F.col("n") == 1, one).otherwise(F.when(holds, a).otherwise(b)).cast("long").alias("shift"))


def quiet_islands(shifts: DataFrame, low: dict[str, int] | int, high: dict[str, int] | int, least: int) -> DataFrame:
    """(video, start, stop): maximal runs of frames where every label's shift is at or beyond a bound, the same for all or by label, at least so long."""
    bound = lambda of: _by_label({x: (v,) for x, v in of.items()} if isinstance(of, dict) else (of,), 0)
    quiet = shifts.groupBy("video", "frame").agg(F.bool_and((F.col("shift") <= bound(low)) | (F.col("shift") >= bound(high))).alias("quiet")).where("quiet")
    run = quiet.withColumn("run", F.col("frame") - F.row_number().over(Window.partitionBy("video").orderBy("frame")))
    found = run.groupBy("video", "run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"))
    return found.where(F.col("stop") - F.col("start") >= least).select("video", "start", "stop")


def anchors(shifts: DataFrame, islands: DataFrame, background: str) -> DataFrame:
    """(video, label, start, stop): frames with shift 0 of each label, and the islands under the background's name."""
    hits = shifts.where("shift = 0").select("video", "label", F.col("frame").alias("start"), (F.col("frame") + 1).alias("stop"))
    return hits.unionByName(islands.select("video", F.lit(background).alias("label"), "start", "stop"))


def timestamp_targets(shifts: DataFrame, n: int, length: int) -> DataFrame:
    """(video, slot, label, at): the first ``n`` cells with shift 0 in the order of time and label; at is in parts of the length."""
    by = Window.partitionBy("video").orderBy("frame", "label")
    return shifts.where("shift = 0").withColumn("slot", F.row_number().over(by) - 1).where(F.col("slot") < n).select("video", F.col("slot").cast("long").alias("slot"), "label", (F.col("frame") / float(length)).alias("at"))


def stitch(chunks: DataFrame, length: int, margin: int) -> DataFrame:
    """(video, frame, value) of overlapping chunks (video, chunk, start, offset, value): each gives its middle, the first and last also their outer edge; later chunks win."""
    by = Window.partitionBy("video")
    rows = chunks.withColumn("_first", F.min("start").over(by)).withColumn("_last", F.max("start").over(by))
    inner = F.col("offset").between(margin, length - margin - 1)
    edge = ((F.col("start") == F.col("_first")) & (F.col("offset") < margin)) | ((F.col("start") == F.col("_last")) & (F.col("offset") >= length - margin))
    owned = rows.where(inner | edge).withColumn("frame", F.col("start") + F.col("offset"))
    return owned.groupBy("video", "frame").agg(F.max_by("value", "start").alias("value"))
