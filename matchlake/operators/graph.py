"""Frame graphs: edges between observed nodes, neighbours in feature space, pooling and normalisation.

Nodes: (clip, frame, slot, x, y, ...). Edges are pairs within one frame, whose nodes are few (a
side has at most so many players), so joins on (clip, frame) stay small whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["clip", "frame"]


def _pairs(nodes: DataFrame) -> DataFrame:
    a = nodes.select(*KEYS, F.col("slot").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("team").alias("at"))
    b = nodes.select(*KEYS, F.col("slot").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("team").alias("bt"))
    apart = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return a.join(b, KEYS).where("src <> dst").withColumn("distance", apart)


def full_edges(nodes: DataFrame) -> DataFrame:
    return _pairs(nodes).select(*KEYS, "src", "dst")


def distance_edges(nodes: DataFrame, radius: float) -> DataFrame:
    return _pairs(nodes).where(F.col("distance") <= radius).select(*KEYS, "src", "dst")


def knn_edges(nodes: DataFrame, k: int) -> DataFrame:
    """Each node and its ``k`` nearest (the lower slot on ties), both ways, each edge once."""
    by = Window.partitionBy(*KEYS, "src").orderBy("distance", "dst")
    near = _pairs(nodes).withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))  # a union would make the pairs twice, and deal them out again
    return near.select(*KEYS, F.explode(ways).alias("e")).select(*KEYS, "e.src", "e.dst").distinct()


def ball_edges(nodes: DataFrame, ball: int, k: int | None = None, radius: float | None = None) -> DataFrame:
    """The ball and its nearest players (k of them, or those within a radius) both ways, and among these the pairs of one team."""
    from_ball = _pairs(nodes).where(F.col("src") == ball)
    if k is not None:
        by = Window.partitionBy(*KEYS).orderBy("distance", "dst")
        from_ball = from_ball.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    if radius is not None:
        from_ball = from_ball.where(F.col("distance") <= radius)
    near = from_ball.select(*KEYS, F.col("dst").alias("slot"), F.col("bt").alias("team"))
    spokes = near.select(*KEYS, F.lit(ball).cast("long").alias("src"), F.col("slot").alias("dst"))
    other = near.select(*KEYS, F.col("slot").alias("dst"), "team")
    mates = near.withColumnRenamed("slot", "src").join(other, [*KEYS, "team"]).where("src <> dst").select(*KEYS, "src", "dst")
    return spokes.union(spokes.select(*KEYS, "dst", "src")).union(mates).distinct()


def line_edges(nodes: DataFrame, line: str, linked: list[tuple[int, int]], ball: int) -> DataFrame:
    """Pairs of one team whose lines are linked, both ways, and the ball with every node."""
    a = nodes.where(F.col("slot") != ball).select(*KEYS, F.col("slot").alias("src"), "team", F.col(line).alias("la"))
    b = nodes.where(F.col("slot") != ball).select(*KEYS, F.col("slot").alias("dst"), "team", F.col(line).alias("lb"))
    ok = F.lit(False)
    for p, q in linked:
        ok = ok | ((F.col("la") == p) & (F.col("lb") == q)) | ((F.col("la") == q) & (F.col("lb") == p))
    mates = a.join(b, [*KEYS, "team"]).where((F.col("src") != F.col("dst")) & ok).select(*KEYS, "src", "dst")
    have = nodes.where(F.col("slot") == ball).select(*KEYS)
    spokes = nodes.where(F.col("slot") != ball).join(have, KEYS, "left_semi").select(*KEYS, F.lit(ball).cast("long").alias("src"), F.col("slot").alias("dst"))
    return mates.union(spokes).union(spokes.select(*KEYS, "dst", "src")).distinct()


def feature_knn(queries: DataFrame, points: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(id, neighbour, distance, rank): the ``k`` nearest points (itself included; the lower id on ties) of each query row.

    The queries are a stated set. They go out in blocks, each broadcast as one matrix; a task reads
    its points in small slices and keeps k a query of the block, and the last ranking sees those alone.
    Candidates are told by |a|^2 + |b|^2 - 2ab with a margin for rounding; distances that count are summed up in full.
    """
    spark, found = points.sparkSession, None
    asked = queries.select("id", "v").toLocalIterator(prefetchPartitions=False)
    while some := list(islice(asked, block)):
        shared = spark.sparkContext.broadcast((np.array([r.id for r in some]), np.array([r.v for r in some], float)))
        part = points.select("id", "v").mapInArrow(_nearest_points(shared, k), "id long, neighbour long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return points.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
    by = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _nearest_points(shared: Broadcast, k: int, slice_rows: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's ``k`` nearest points of each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, a = shared.value
        squares = (a * a).sum(axis=1)
        query, point, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bound = np.full(len(a), np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                ids, b = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().astype(float).reshape(part.num_rows, -1)
                near = squares[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
                limit = np.minimum(bound, np.partition(near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1])
                rows, columns = np.nonzero(near <= (limit + 1e-9 * (1 + squares + np.where(np.isfinite(limit), np.abs(limit), 0.0)))[:, None])
                query, point = np.concatenate([query, rows]), np.concatenate([point, ids[columns]])
                distance = np.concatenate([distance, ((a[rows] - b[columns]) ** 2).sum(axis=1)])
                order = np.lexsort((point, distance, query))
                query, point, distance = query[order], point[order], distance[order]
                first = np.searchsorted(query, query)
                kept = np.arange(len(query)) - first < k
                query, point, distance = query[kept], point[kept], distance[kept]
                last = np.flatnonzero(np.bincount(query, minlength=len(a)) >= k)
                bound[last] = distance[np.searchsorted(query, last, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(names[query], pa.int64()), pa.array(point, pa.int64()), pa.array(distance)], names=["id", "neighbour", "distance"])

    return run


def neighbour_features(found: DataFrame, points: DataFrame, style: str = "offset") -> DataFrame:
    """(id, rank, feature) of neighbours (id, neighbour, rank): the neighbour's vector less the own and then the own ("offset"), the neighbour's and the own ("both"), or the neighbour's ("neighbour")."""
    theirs = found.join(points.select(F.col("id").alias("neighbour"), F.col("v").alias("_theirs")), "neighbour")
    own = points.select("id", F.col("v").alias("_own"))
    parts = {"offset": F.concat(F.zip_with("_theirs", "_own", lambda x, y: x - y), "_own"), "both": F.concat("_theirs", "_own"), "neighbour": F.col("_theirs")}
    return theirs.join(own, "id").select("id", "rank", parts[style].alias("feature"))


def attention_pooled(vectors: DataFrame, keys: list[str], vector: str, score: str) -> DataFrame:
    """(keys, dim, value): the rows of a key added up, weighted by the softmax of their scores in it. A row without a score weighs nothing."""
    most = F.max(score).over(Window.partitionBy(*keys))
    weighed = vectors.where(F.col(score).isNotNull()).withColumn("_w", F.exp(F.col(score) - most))
    each = weighed.select(*keys, "_w", F.posexplode(vector).alias("dim", "x"))
    return each.groupBy(*keys, "dim").agg((F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("value"))


def vlad_pooled(vectors: DataFrame, keys: list[str], vector: str, centres: DataFrame, residual: bool = True) -> DataFrame:
    """(keys, centre, dim, value): soft assignments of the rows of a key to given centres, summed, of length 1 for each centre and then for the key.

    centres: (centre, w, b, c), whose assignment scores are w x + b and, softmaxed over the centres, weigh x - c, or x
    without ``residual``. They are a model's parameters and go to every task; sums are added up by batch before they are shuffled.
    """
    rows = centres.select("centre", "w", "b", "c").orderBy("centre").collect()
    names, w, b, c = [r["centre"] for r in rows], np.array([r["w"] for r in rows], float), np.array([r["b"] for r in rows], float), np.array([r["c"] for r in rows], float)
    types = dict(vectors.dtypes)
    own = [f"_k{i}" for i in range(len(keys))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(len(own)).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
            scores = x @ w.T + b
            share = np.exp(scores - scores.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            table = pa.Table.from_batches([batch.select(own)]).append_column("_at", pa.array(np.arange(batch.num_rows)))
            groups = table.group_by(own).aggregate([("_at", "list")])
            sums = []
            for at in groups["_at_list"].to_pylist():
                part = share[at].T @ x[at]
                sums += list(part - share[at].sum(axis=0)[:, None] * c if residual else part)
            which = np.repeat(np.arange(groups.num_rows), len(names))
            out = [groups[k].combine_chunks().take(pa.array(which)) for k in own]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.tile(np.arange(len(names)), groups.num_rows)), pa.array(sums, pa.list_(pa.float64()))], [*own, "_c", "part"])

    schema = ", ".join([*(f"{o} {types[k]}" for o, k in zip(own, keys, strict=True)), "_c long, part array<double>"])
    laid = vectors.where(F.col(vector).isNotNull()).select(*[F.col(k).alias(o) for o, k in zip(own, keys, strict=True)], vector).mapInArrow(add, schema)
    summed = laid.select(*own, "_c", F.posexplode("part").alias("dim", "x")).groupBy(*own, "_c", "dim").agg(F.sum("x").alias("x"))
    length = lambda *by: F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*by)))
    inner = summed.withColumn("x", F.coalesce(F.try_divide("x", length(*own, "_c")), F.lit(0.0)))
    whole = inner.withColumn("value", F.coalesce(F.try_divide("x", length(*own)), F.lit(0.0)))
    named = F.element_at(F.array(*map(F.lit, names)), (F.col("_c") + 1).cast("int")).alias("centre")
    return whole.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], named, "dim", "value")


def pooled(vectors: DataFrame, keys: list[str], vector: str, how: str) -> DataFrame:
    """(keys, dim, value): elementwise mean or max over the rows of a key."""
    each = vectors.select(*keys, F.posexplode(vector).alias("dim", "value"))
    return each.groupBy(*keys, "dim").agg((F.avg if how == "mean" else F.max)(F.col("value").cast("double")).alias("value"))


def shifted_channels(rows: DataFrame, keys: list[str], time: str, vector: str, fold: int) -> DataFrame:
    """(keys, time, dim, value): the first ``fold`` channels from the step after, the next from the step before, 0 beyond the ends."""
    each = rows.select(*keys, time, F.posexplode(vector).alias("dim", "value"))
    by = Window.partitionBy(*keys, "dim").orderBy(time)
    value = F.when(F.col("dim") < fold, F.lead("value", 1, 0.0).over(by)).when(F.col("dim") < 2 * fold, F.lag("value", 1, 0.0).over(by)).otherwise(F.col("value"))
    return each.withColumn("value", value)


def normalised(value: Column, scale: float, missing: float, missing_out: float) -> Column:
    return F.when(value == missing, F.lit(missing_out)).otherwise(value / scale)


def flipped(value: Column, missing: float, draw: Column) -> Column:
    """The value negated where known and drawn."""
    return F.when(draw & (value != missing), -value).otherwise(value)


def slots_of(players: Column, first: int, many: int) -> Column:
    """Players (struct with jersey, x, y) by jersey number, as many as there are slots, with their slot."""
    placed = F.transform(players, lambda p, i: F.struct(F.coalesce(p["jersey"].try_cast("int"), F.lit(0)).alias("n"), i.alias("i"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(placed), 1, many), lambda e, i: F.struct((i + first).alias("slot"), e["p"].alias("p")))
