"""Suppression, matching and metrics of timed predictions (video, label, frame, confidence, ord).

Matching and greedy suppression never cross a key, and a row is touched only by rows within a
reach of it. So keys are cut into chunks of time, and each chunk settles what the rows around it
leave no doubt about; what is left goes to another round. Ranks by label run over sorted ranges.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import cut_lineage, in_ranges

#: Rows of a chunk, where they do not lie closer than a reach; and how many times as many it may hold in later rounds.
CHUNK_ROWS = 100_000
CHUNK_GROWTH = 16

#: Rows up to which a task settles small chunks together.
TOGETHER_ROWS = 20_000


def suppress_window(pred: DataFrame, window: int, *keys: str) -> DataFrame:
    """Predictions without those that have a stronger one of their key at another frame within ``window``.

    A suppressed prediction still suppresses others; predictions of one frame leave each other be. Those without a
    frame are kept, those without a confidence are not.

    Frames are cut into blocks of window width, which also split a hot key. A window around a frame is the rest of its
    block on either side, and the end of the block before and the beginning of the one after; a prediction
    asks for the last two where they are. So all maxima run from a block's border, and none slides.
    """
    if window < 1:
        return pred.where("confidence IS NOT NULL")
    row = F.struct(*[F.col(f"`{c}`") for c in pred.columns])
    none = F.lit(None).cast(pred.select(row.alias("_row")).schema["_row"].dataType)
    asked = F.array(*[F.struct(F.lit(side).alias("side"), (row if side == 0 else none).alias("row")) for side in (0, -1, 1)])
    own = [F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(keys))]
    laid = pred.select(*own, F.col("frame").cast("long").alias("_frame"), F.col("confidence").alias("_confidence"), F.explode(asked).alias("_a")).select(
        *names, "_frame", F.col("_a.side").alias("_side"), F.col("_a.row").alias("_row"), (F.col("_frame") + window * F.col("_a.side")).alias("_at"), F.when(F.col("_a.side") == 0, F.col("_confidence")).alias("_value")
    )
    block = F.call_function("div", F.col("_at") - F.pmod("_at", F.lit(window)), F.lit(window))
    up = Window.partitionBy(*names, "_block").orderBy("_at")
    down = Window.partitionBy(*names, "_block").orderBy(F.desc("_at"))
    reach = lambda by, to: F.max("_value").over(by.rangeBetween(Window.unboundedPreceding, to))
    beside = F.when(F.col("_side") == 0, F.greatest(reach(up, -1), reach(down, -1))).when(F.col("_side") < 0, reach(down, 0)).otherwise(reach(up, 0))
    near = laid.where("_frame IS NOT NULL").withColumn("_block", block).withColumn("_near", beside)
    strongest = F.max("_near").over(Window.partitionBy(*names, "_frame"))
    kept = near.withColumn("_near", strongest).where("_side = 0").where("_row.confidence >= coalesce(_near, double('-infinity'))")
    return kept.select("_row.*").union(pred.where("frame IS NULL AND confidence IS NOT NULL"))


def suppress_greedy(pred: DataFrame, window: int, least: float, *keys: str) -> DataFrame:
    """Greedy suppression: the strongest prediction of a key stays and blanks the frames from half a window (rounded up) before it to half a window (rounded down, excluded) after it; again, while one reaches ``least``."""
    if window < 2:
        raise ValueError("a window under 2 frames never blanks the prediction it stands on")
    back, ahead = (window + 1) // 2, window // 2

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["confidence", "frame"], ascending=[False, True], kind="stable")
        near: dict[int, list[tuple[int, bool]]] = {}  # kept and doubtful frames, by cells of a window
        states = []
        for frame, core, state in zip(rows["frame"].tolist(), rows["_core"].tolist(), rows["_state"].tolist(), strict=True):
            cell = frame // window
            sure = [s for c in (cell - 1, cell, cell + 1) for f, s in near.get(c, ()) if f - back <= frame < f + ahead]
            if state == OPEN:
                state = LOST if any(sure) else KEPT if core and not sure else OPEN
            if state != LOST:
                near.setdefault(cell, []).append((frame, state == KEPT))
            states.append(state)
        return rows.assign(_state=states)

    # Of one frame only the strongest can stay: what blanks it blanks the others.
    named = _named(pred)
    strong = named.where((F.col("confidence") >= least) & ~F.isnan("confidence"))
    best = strong.groupBy(*keys, "frame").agg(F.max_by(F.struct("confidence", "_id"), F.struct("confidence", -F.col("ord"), -F.col("_id"))).alias("b"))
    left = best.select(*keys, "frame", "b.*")
    left = cut_lineage(left.withColumn("_state", F.lit(OPEN)))
    done = 0
    while not left.where(F.col("_state") == OPEN).isEmpty():
        width, done = _chunk_width(left, keys, max(back, ahead), done), done + 1
        left = cut_lineage(_by_chunk(left, keys, width, max(back, ahead), settle).where(F.col("_state") != LOST))
    return named.join(left.select("_id"), "_id", "left_semi").drop("_id")


OPEN, KEPT, LOST = 0, 1, 2


def _chunk_width(rows: DataFrame, keys: tuple[str, ...], halo: int, done: int = 0) -> int | None:
    """Frames of a chunk: as many halos as hold CHUNK_ROWS rows where they lie closest, at least one; None if every key is small enough for one chunk.

    With each round that is done chunks double, up to CHUNK_GROWTH times: where each chunk waits for the next one, as with
    strengths that rise over time, so much fewer rounds are needed, and a task's rows stay bounded.
    """
    size = CHUNK_ROWS * min(1 << done, CHUNK_GROWTH)
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= size:
        return None
    cell = max(1, halo)
    most = rows.groupBy(*keys, F.floor(F.col("frame") / cell).alias("_cell")).count().agg(F.max("count")).first()[0] or 1
    return cell * max(1, size // most)


def _by_chunk(rows: DataFrame, keys: tuple[str, ...], width: int | None, halo: int, settle: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """``settle`` on chunks of rows and those within ``halo`` of them (``_core`` false); by default core rows are returned, with the ``_state`` it gives them.

    A task settles many small chunks in one call. They are laid on one axis of time, more than a halo apart, so no row touches one of another chunk.
    ``settle`` sees the numbers of the rows, not their keys' texts.
    """
    at = lambda shift: F.floor((F.col("frame") + shift) / width)
    rows = rows.where("frame IS NOT NULL")
    by = list(keys) if width is None else [*keys, "_chunk"]
    if width is None:
        laid = rows.withColumn("_core", F.lit(True))
    else:
        laid = rows.withColumn("_chunk", F.explode(F.sequence(at(-halo), at(halo)))).withColumn("_core", F.col("_chunk") == at(0))
    # A number given keeps small bytes of dear Python work from being put together in one task.
    laid = laid.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("frame"))
    laid = laid.withColumn("_new", place == 1).drop("_chunk")
    numbers = [f.name for f in laid.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return laid.mapInArrow(_settle_together(settle, numbers, halo, None if schema is not None else rows.columns), schema if schema is not None else rows.schema)


def _settle_together(settle: Callable[[pd.DataFrame], pd.DataFrame], numbers: list[str], halo: int, names: list[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part of ``_by_chunk``: chunks come one after the other, ``_new`` marks the first row of each, and their rows are in the order of frames."""
    together = TOGETHER_ROWS

    def settled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts)
        x = pd.DataFrame({c: whole.column(c).to_numpy() for c in numbers})
        first = np.flatnonzero(x["_new"].to_numpy(bool))
        frames, last = x["frame"].to_numpy(), np.append(first[1:], len(x)) - 1
        spans = frames[last].astype(float) - frames[first].astype(float)
        if len(first) == 1 or frames.dtype.kind in "iu" and spans.sum() + len(first) * (halo + 1.0) < 2**52:
            if len(first) > 1:
                low, high = frames[first].astype(np.int64), frames[last].astype(np.int64)
                shift = np.append(0, np.cumsum(high - low + halo + 1)[:-1]) - low
                x["frame"] = frames + np.repeat(shift, last - first + 1)
            yield from told(whole, x)
        else:
            for a, b in zip(first, last + 1, strict=True):
                yield from told(whole.slice(a, b - a), x.iloc[a:b].reset_index(drop=True))

    def told(whole: pa.Table, x: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        y = settle(x)
        if names is None:
            yield pa.RecordBatch.from_pandas(y, preserve_index=False)
            return
        y = y[y["_core"]]
        out = whole.select(names).take(pa.array(y.index.to_numpy()))
        k = names.index("_state")
        out = out.set_column(k, out.schema.field(k), pa.chunked_array([pa.array(y["_state"].to_numpy(), out.schema.field(k).type)]))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column("_new").to_numpy(zero_copy_only=False))
            if len(starts) and n + starts[-1] >= together:
                cut = int(starts[-1])
                yield from settled([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from settled(held)

    return run


class _Free:
    """The places 0 to n - 1 that are not taken yet, found from either side in near constant time."""

    def __init__(self, n: int) -> None:
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # down is shifted by one; 0 is none

    @staticmethod
    def _root(links: list[int], k: int) -> int:
        top = k
        while links[top] != top:
            top = links[top]
        while links[k] != top:
            links[k], k = top, links[k]
        return top

    def at_or_after(self, k: int) -> int:
        return self._root(self.up, k)

    def at_or_before(self, k: int) -> int:
        return self._root(self.down, k + 1) - 1

    def take(self, k: int) -> None:
        self.up[k], self.down[k + 1] = k + 1, k


def _matched(takers: DataFrame, goods: DataFrame, reach: float, choose: Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray]], *more: str) -> DataFrame:
    """(taker, good) ids of the pairs that sequential matching of each (video, label, more) makes; both sides: those, frame, confidence, ord, _id."""
    keys, halo = (*more, "video", "label"), math.ceil(2 * reach)
    rows = takers.withColumn("_good", F.lit(False)).unionByName(goods.withColumn("_good", F.lit(True)))
    pairs, done = None, 0

    def settle(x: pd.DataFrame) -> pd.DataFrame:
        t, g = x[~x["_good"]].reset_index(drop=True), x[x["_good"]].reset_index(drop=True)
        state, took = choose(t, g)
        sure = (state != OPEN) & t["_core"].to_numpy(bool)
        ids = np.append(g["_id"].to_numpy(np.int64), 0)[took[sure]]
        return pd.DataFrame({"taker": t["_id"].to_numpy(np.int64)[sure], "good": pd.arrays.IntegerArray(ids, took[sure] < 0)})

    answer = T.StructType([T.StructField("taker", T.LongType()), T.StructField("good", T.LongType())])
    while True:
        width, done = _chunk_width(rows, keys, halo, done), done + 1
        now = cut_lineage(_by_chunk(rows, keys, width, halo, settle, answer))
        made = now.where("good IS NOT NULL")
        if pairs is None and now.count() == takers.count():
            return made
        pairs = made if pairs is None else cut_lineage(pairs.unionByName(made)) if done % 8 == 0 else pairs.unionByName(made)
        gone = now.select(F.col("taker").alias("_id"), F.lit(False).alias("_good")).unionByName(now.where("good IS NOT NULL").select(F.col("good").alias("_id"), F.lit(True).alias("_good")))
        rows = cut_lineage(rows.join(gone, ["_id", "_good"], "left_anti"))
        if rows.where("NOT _good").isEmpty():
            return pairs


def _named(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))


def _plain(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, "video", "label", "frame", F.col("confidence").cast("double").alias("confidence"), "ord", "_id").where("frame IS NOT NULL")


def _with_hits(named: DataFrame, hits: DataFrame) -> DataFrame:
    found = hits.toDF("_id").withColumn("_hit", F.lit(True))
    return named.join(found, "_id", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_id", "_hit")


def match_nearest(pred: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """Predictions with ``hit``: strongest first, each takes its nearest truth of the same (video, label) not taken yet, if within the tolerance."""
    return match_nearest_each(pred, truth, [tolerance]).drop("tolerance")


def match_nearest_each(pred: DataFrame, truth: DataFrame, tolerances: list[int]) -> DataFrame:
    """The rows of ``match_nearest`` for each tolerance, with ``tolerance``: all are matched in the same rounds."""

    def choose(t: pd.DataFrame, g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        state, took = np.full(len(t), OPEN), np.full(len(t), -1)
        g = g.sort_values(["frame", "ord"], kind="stable")
        places, ords = g.index.tolist(), g["ord"].tolist()
        at, first, count = np.unique(g["frame"].to_numpy(), return_index=True, return_counts=True)
        frames, nexts, ends, free, doubt = at.tolist(), first.tolist(), (first + count).tolist(), _Free(len(at)), np.zeros(len(at), bool)
        t = t.sort_values(["confidence", "ord"], ascending=[False, True], kind="stable")
        own, reach, core = t["frame"].to_numpy(), t["tolerance"].to_numpy(), t["_core"].to_numpy(bool)
        lows, mids, highs = np.searchsorted(at, own - reach), np.searchsorted(at, own), np.searchsorted(at, own + reach, "right")
        near = lows < highs
        state[t.index.to_numpy()[core & ~near]] = LOST
        for row, frame, core, low, right, high in zip(*[x[near].tolist() for x in (t.index.to_numpy(), own, core, lows, mids, highs)], strict=True):
            if not core:  # it may take any truth in its reach
                doubt[low:high] = True
                continue
            left, doubtful = right - 1, False
            while True:
                right, left = free.at_or_after(right), free.at_or_before(left) if left >= 0 else -1
                best = left if left >= low else None
                level = [] if best is None else [left]
                if right < high:
                    further = -1 if best is None else (frames[right] - frame) - (frame - frames[left])
                    if further < 0 or further == 0 and ords[nexts[right]] < ords[nexts[left]]:
                        best = right
                    if further <= 0:
                        level = [right] if further < 0 else [left, right]
                if best is None or not any(doubt[k] for k in level):
                    break
                doubtful = True
                right, left = right + (right in level), left - (left in level)
                doubt[level] = True
            if doubtful:  # it takes one of the doubtful truths passed or this one
                if best is not None:
                    doubt[level] = True
                continue
            state[row] = LOST if best is None else KEPT
            if best is not None:
                took[row] = places[nexts[best]]
                nexts[best] += 1
                if nexts[best] == ends[best]:
                    free.take(best)
        return state, took

    each = F.explode(F.array(*[F.lit(t) for t in tolerances])).alias("tolerance")
    named = _named(pred.select("*", each))
    pairs = _matched(_plain(named, "tolerance"), _plain(_named(truth.select("*", each)), "tolerance"), max(tolerances), choose, "tolerance")
    return _with_hits(named, pairs.select("taker"))


def match_strongest(pred: DataFrame, truth: DataFrame, delta: float) -> DataFrame:
    """Predictions with ``hit``: truths in time order each take the strongest unused prediction within delta / 2."""
    return match_strongest_each(pred, truth, [delta]).drop("delta")


def match_strongest_each(pred: DataFrame, truth: DataFrame, deltas: list[float]) -> DataFrame:
    """The rows of ``match_strongest`` for each delta, with ``delta``: all deltas are matched in the same rounds."""

    def choose(t: pd.DataFrame, g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        state, took = np.full(len(t), OPEN), np.full(len(t), -1)
        if t.empty:
            return state, took
        g = g.sort_values(["frame", "ord"], kind="stable")
        places, frames = g.index.to_numpy(), g["frame"].to_numpy()
        strength = np.empty(len(g), np.int64)
        strength[np.lexsort((np.arange(len(g)), -g["confidence"].to_numpy(float)))] = np.arange(len(g))
        places, strength = places.tolist(), strength.tolist()
        strong, doubt, free, behind = [], np.zeros(len(g), bool), np.ones(len(g), bool), 0
        t = t.sort_values(["frame", "ord"], kind="stable")
        own, half, core = t["frame"].to_numpy(), t["delta"].to_numpy() / 2, t["_core"].to_numpy(bool)
        lows, highs = np.searchsorted(frames, own - half), np.searchsorted(frames, own + half, "right")
        near = lows < highs
        state[t.index.to_numpy()[core & ~near]] = LOST
        # predictions that no truth reaches never enter
        asked = np.flatnonzero(np.cumsum(np.bincount(lows, minlength=len(g) + 1) - np.bincount(highs, minlength=len(g) + 1))[: len(g)] > 0).tolist()
        for row, core, low, high in zip(*[x[near].tolist() for x in (t.index.to_numpy(), core, lows, highs)], strict=True):
            if not core:
                doubt[low:high] = True
                continue
            while behind < len(asked) and asked[behind] < high:  # truths come in time order, so predictions enter once and leave once
                heapq.heappush(strong, (strength[asked[behind]], asked[behind]))
                behind += 1
            passed = []
            while strong and (strong[0][1] < low or not free[strong[0][1]] or doubt[strong[0][1]]):
                one = heapq.heappop(strong)
                if one[1] >= low and free[one[1]]:
                    passed.append(one)
            best = strong[0][1] if strong else None
            for one in passed:
                heapq.heappush(strong, one)
            if passed:
                if best is not None:
                    doubt[best] = True
                continue
            state[row] = LOST if best is None else KEPT
            if best is not None:
                took[row], free[best] = places[best], False
        return state, took

    each = F.explode(F.array(*[F.lit(float(d)) for d in deltas])).alias("delta")
    named = _named(pred.select("*", each))
    pairs = _matched(_plain(_named(truth.select("*", each)), "delta"), _plain(named, "delta"), max(deltas) / 2, choose, "delta")
    return _with_hits(named, pairs.select("good"))


def average_precision(matched: DataFrame, truth: DataFrame, order: list[Column], *more: str) -> DataFrame:
    """(more, label, ap): precision at each hit, raised to the greatest at any later one, over the number of truths.

    Rows are sorted by ranges; what a label has in the ranges before or after is added by range.
    """
    keys = [*more, "label"]
    laid = in_ranges(matched, *[F.col(k) for k in keys], *order).select(*keys, F.coalesce(F.col("hit").cast("int"), F.lit(0)).alias("hit"), "_part", "_at")
    ranges, place = Window.partitionBy(*keys).orderBy("_part"), Window.partitionBy("_part", *keys).orderBy("_at")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("_part", *keys).agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    starts = sizes.select("_part", *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h"))
    places = laid.select("*", F.row_number().over(place).alias("rank"), F.sum("hit").over(place.rowsBetween(Window.unboundedPreceding, 0)).alias("found")).where("hit = 1")
    points = places.join(starts, ["_part", *keys]).select("_part", *keys, "_at", ((F.col("found") + F.col("h")) / (F.col("rank") + F.col("n"))).alias("precision"))
    tops = points.groupBy("_part", *keys).agg(F.max("precision").alias("top"))
    after = tops.select("_part", *keys, F.max("top").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    backwards = Window.partitionBy("_part", *keys).orderBy(F.desc("_at"))  # a frame that grows is added to, one that shrinks is read anew for each row
    later = F.max("precision").over(backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    raised = points.withColumn("later", later).join(after, ["_part", *keys]).select(*keys, F.greatest("later", "after").alias("p"))
    area = raised.groupBy(*keys).agg(F.sum("p").alias("area"))
    totals = truth.groupBy(*keys).agg(F.count("*").alias("n"))
    return totals.join(area, keys, "left").select(*keys, (F.coalesce("area", F.lit(0.0)) / F.col("n")).alias("ap"))


def mean_average_precision(pred: DataFrame, truth: DataFrame, tolerances: list[int]) -> DataFrame:
    """(tolerance, mean_ap) over the labels of the truth."""
    each = F.explode(F.array(*[F.lit(t) for t in tolerances])).alias("tolerance")
    found = average_precision(match_nearest_each(pred, truth, tolerances), truth.select("label", each), [F.desc("confidence"), F.col("ord")], "tolerance")
    return found.groupBy("tolerance").agg(F.avg("ap").alias("mean_ap"))


def precision_recall(matched: DataFrame, truth: DataFrame, steps: int = 200) -> DataFrame:
    """(label, threshold, precision, recall) at evenly spaced confidences from 0 to 1; nothing over nothing is 0.

    Confidences fall into steps first, so each prediction is counted once and not once a threshold.
    """
    return _curves(matched, truth.groupBy("label").agg(F.count("*").alias("truths")), ["label"], steps)


def _curves(matched: DataFrame, totals: DataFrame, keys: list[str], steps: int = 200) -> DataFrame:
    """The points of ``precision_recall`` for each row of ``totals`` (keys, truths)."""
    step = F.least(F.floor(F.col("confidence") * (steps - 1) + 1e-9), F.lit(steps - 1)).cast("int")
    counts = matched.where("confidence >= 0").groupBy(*keys, step.alias("k")).agg(F.count("*").alias("n"), F.count_if("hit").alias("tp"))
    grid = totals.select(*keys, "truths", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"))
    above = Window.partitionBy(*keys).orderBy(F.desc("k"))
    filled = grid.join(counts, [*keys, "k"], "left")
    summed = filled.select(*keys, "k", "truths", F.sum(F.coalesce("n", F.lit(0))).over(above).alias("n"), F.sum(F.coalesce("tp", F.lit(0))).over(above).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return summed.select(*keys, (F.col("k") / float(steps - 1)).alias("threshold"), ratio("tp", "n").alias("precision"), ratio("tp", "truths").alias("recall"))


def eleven_points(curve: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, ap): the mean, over recalls 0, 0.1, ..., 1, of the best precision at that recall or more."""
    points = [F.coalesce(F.max(F.when(F.col("recall") >= j / 10, F.col("precision"))), F.lit(0.0)) for j in range(11)]
    return curve.groupBy(*keys, "label").agg((sum(points[1:], points[0]) / 11).alias("ap"))


def trapezoid_mean(rows: DataFrame, keys: str | list[str], x: str, y: str) -> DataFrame:
    """(keys, area): the mean height of the trapezoids between values of ``y`` in the order of ``x``; a single one is itself."""
    keys = [keys] if isinstance(keys, str) else keys
    after = F.lead(y).over(Window.partitionBy(*keys).orderBy(x))
    parts = rows.select(*keys, y, ((F.col(y) + after) / 2).alias("part"))
    return parts.groupBy(*keys).agg(F.coalesce(F.avg("part"), F.first(y)).alias("area"))


#: The seconds of tolerance of each named metric.
TOLERANCES = {"loose": list(range(5, 65, 5)), "tight": [1, 2, 3, 4, 5], "at1": [1], "at2": [2], "at3": [3], "at4": [4], "at5": [5]}

#: Fixed value: the mean over unshown actions is stretched from all 17 classes to the 13 that have such.
UNSHOWN_SCALE = 17 / 13

KINDS = ("any", "visible", "unshown")


def performances(pred: DataFrame, truth: DataFrame, metric: str, classes: list[str], fps: int = 2) -> DataFrame:
    """(label, any, visible, unshown): the average over the metric's tolerances of the eleven-point precision of each class, and a row "Average mAP" over the classes.

    pred: video, label, frame, confidence, ord; truth: video, label, frame, ord, visible (null counts as
    visible), each with one row a cell. A prediction counts as visible or unshown as its closest truth is; as unshown where
    its video has none of the label. A class without truths has 0. Of several tolerances the mean of
    the trapezoids is taken; the unshown mean over classes is scaled by UNSHOWN_SCALE then.
    """
    if metric not in TOLERANCES:
        raise ValueError(f"unknown metric {metric}; known are {', '.join(TOLERANCES)}")
    deltas = [float(d * fps) for d in TOLERANCES[metric]]
    shown = truth.withColumn("visible", F.coalesce("visible", F.lit(True)))
    marks = shown.select("video", "label", F.col("frame").alias("closest"), "visible")
    near = closest_event(pred.select("video", "label", "frame"), truth).distinct().join(marks, ["video", "label", "closest"], "left")
    kind = lambda visible: F.when(visible, "visible").otherwise("unshown")
    told = pred.join(near.select("video", "label", "frame", kind(F.col("visible")).alias("_kind")), ["video", "label", "frame"])
    events = shown.withColumn("confidence", F.lit(0.0)).select("video", "label", "frame", "confidence", "ord")
    matched = match_strongest_each(told, events, deltas).select("delta", "label", "confidence", "hit", F.explode(F.array(F.lit("any"), "_kind")).alias("kind"))
    counts = shown.select("label", F.explode(F.array(F.lit("any"), kind(F.col("visible")))).alias("kind")).groupBy("label", "kind").agg(F.count("*").alias("truths"))
    every = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    cells = truth.sparkSession.range(1).select(every(classes, "label")).select("*", every(deltas, "delta")).select("*", every(KINDS, "kind"))
    totals = cells.join(counts, ["label", "kind"], "left").fillna(0, ["truths"])
    ap = cut_lineage(eleven_points(_curves(matched, totals, ["delta", "kind", "label"]), "delta", "kind"))
    means = ap.groupBy("delta", "kind").agg(F.avg("ap").alias("ap")).withColumn("label", F.lit("Average mAP"))
    area = trapezoid_mean(ap.unionByName(means), ["label", "kind"], "delta", "ap")
    scale = F.when((F.col("label") == "Average mAP") & (F.col("kind") == "unshown"), UNSHOWN_SCALE if len(deltas) > 1 else 1.0).otherwise(1.0)
    return area.groupBy("label").agg(*[F.max(F.when(F.col("kind") == k, F.col("area") * scale)).alias(k) for k in KINDS])


def frame_averages(scores: DataFrame) -> DataFrame:
    """(video, frame, label, score, support): the mean of the overlapping clips' scores."""
    return scores.groupBy("video", "frame", "label").agg(F.avg("score").alias("score"), F.count("*").alias("support"))


def frame_classes(averages: DataFrame) -> DataFrame:
    """(video, frame, label, score): the best class of each frame, the first label on ties."""
    return averages.groupBy("video", "frame").agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), "label")).alias("b")).select("video", "frame", "b.*")


def game_time(position_ms: Column) -> Column:
    seconds = F.floor(position_ms / 1000)
    return F.concat(F.lpad(F.floor(seconds / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def foreground_f1(rows: DataFrame, truth: str, predicted: str, background: str) -> DataFrame:
    """(label, tp, fp, fn, f1) of each class and of 'any' (foreground or not)."""
    t, p = F.col(truth), F.col(predicted)
    pairs = rows.groupBy(t.alias("t"), p.alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))
    each = pairs.select("t", "p", "n", F.explode(sides).alias("s")).select("s.label", "s.side", "n", (F.col("t") == F.col("p")).alias("same"), (F.col("t") != background).alias("ft"), (F.col("p") != background).alias("fp"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    side_t, side_p = F.col("side") == "t", F.col("side") == "p"
    one = each.where(F.col("label") != background).groupBy("label").agg(total(side_t & F.col("same")).alias("tp"), total(side_p & ~F.col("same")).alias("fp"), total(side_t & ~F.col("same")).alias("fn"))
    both = each.where(side_t).agg(total(F.col("ft") & F.col("fp")).alias("tp"), total(~F.col("ft") & F.col("fp")).alias("fp"), total(F.col("ft") & ~F.col("fp")).alias("fn")).select(F.lit("any").alias("label"), "tp", "fp", "fn")
    return one.unionByName(both).withColumn("f1", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")), F.lit(0.0)))


def closest_event(frames: DataFrame, truth: DataFrame) -> DataFrame:
    """(video, label, frame, closest): the frame of the nearest truth, the later from the middle on; -1 where the label has none."""
    by = Window.partitionBy("video", "label").orderBy("event")
    events = truth.select("video", "label", F.col("frame").alias("event")).distinct()
    spans = events.select("video", "label", "event", F.floor((F.lag("event").over(by) + F.col("event")) / 2).alias("from"))
    marks = spans.select("video", "label", F.coalesce("from", F.lit(-(1 << 62))).alias("frame"), "event", F.lit(0).alias("side"))
    asked = frames.select("video", "label", "frame", F.lit(None).cast("long").alias("event"), F.lit(1).alias("side"))
    last = F.last("event", ignorenulls=True).over(Window.partitionBy("video", "label").orderBy("frame", "side"))
    return marks.unionByName(asked).withColumn("closest", F.coalesce(last, F.lit(-1))).where("side = 1").select("video", "label", "frame", "closest")


def dense_grid(rows: DataFrame, frame: Column, value: Column, size: int) -> DataFrame:
    """(video, label, frame, value): the last value written to each cell; frames beyond the grid fall on its last."""
    return rows.groupBy("video", "label", F.least(frame, F.lit(size - 1)).alias("frame")).agg(F.max_by(value, "ord").alias("value"))


def in_batches(rows: DataFrame, infer, schema: str) -> DataFrame:
    """A model's function (pandas frame to pandas frame) over Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield infer(frame)

    return rows.mapInPandas(run, schema)
