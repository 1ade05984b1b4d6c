"""Shards of samples by size and by count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import cut_lineage, in_ranges, ranked


#: Full shards' bytes in a block. More make fewer blocks to link, and more samples for a task to hold.
BLOCK_SHARDS = 64


def pack_by_size(samples: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """``samples`` with ``shard`` from 0 within each group: in order, a sample opens a new shard where the tar file would pass the limit.

    Sizes: tar member bytes. A sample's place is the sum of sizes before it in its group, added up by ranges. Groups are
    cut into blocks of places. Wherever a block is entered, which is at one of its first samples, a task
    knows where its last shard begins; that is linked to where the block behind it is entered. The entries that the group's first
    sample leads to are found by doubling the links, and then each block numbers its shards. So a
    group of any size is spread over tasks, and rounds grow with the logarithm of its blocks.

    Samples of equal order come in any order. A group of null is a group; null sizes count as 0.
    """
    capacity = limit // 10240 * 10240 - 1024
    width = BLOCK_SHARDS * max(1, capacity)
    laid = in_ranges(samples.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0))), group, order)
    parts = laid.groupBy("_part", F.col(group).alias("_g")).agg(F.sum("_size").alias("_sum"))
    parts = parts.select("_part", "_g", F.coalesce(F.sum("_sum").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    parts = parts.withColumnRenamed("_part", "_p")
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = laid.withColumn("_inside", inside).join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    placed = placed.withColumn("_place", F.col("_before") + F.col("_inside")).drop("_p", "_before", "_inside")
    placed = cut_lineage(placed.withColumn("_block", F.floor(F.col("_place") / width)))
    keys = placed.select("_g").schema["_g"].dataType.simpleString()
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def together(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition(tasks, "_g", "_block").sortWithinPartitions("_g", "_block", *order)

    def following(place: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the shard after the one that begins at each sample begins, in this block or behind it."""
        return np.maximum(np.searchsorted(end, place + capacity, "right"), np.searchsorted(place, place, "right"))

    def entries(block: pd.DataFrame) -> pd.DataFrame:
        """For each sample at which a block may be entered: where its last shard begins then, and how many begin."""
        place = block["_place"].to_numpy()
        end = place + block["_size"].to_numpy()
        n, after = len(place), following(place, end)
        last, count = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
        while (last[last] != last).any():
            count, last = count + count[last], last[last]
        few = np.arange(min(n, int(np.searchsorted(place, block["_block"].iloc[0] * width + capacity, "right")) + 1 or 1))
        return pd.DataFrame({"_g": block["_g"].iloc[0], "_block": block["_block"].iloc[0], "at": few, "place": place[few], "end": end[few], "last": place[last[few]], "n": count[few] + 1, "next": end[-1] // width})

    found = cut_lineage(together(placed.select("_g", "_block", "_part", "_at", "_place", "_size"), "_part", "_at").mapInPandas(_by_block(entries), f"_g {keys}, _block long, at long, place long, end long, last long, n long, next long"))

    def links(block: pd.DataFrame) -> pd.DataFrame:
        """Where those that lead to a block enter it; null if it ends before."""
        here, come = block[~block["asks"]], block[block["asks"]]
        at = np.maximum(np.searchsorted(here["end"].to_numpy(), come["last"].to_numpy() + capacity, "right"), np.searchsorted(here["place"].to_numpy(), come["last"].to_numpy(), "right"))
        return pd.DataFrame({"_g": come["_g"], "from_block": come["from_block"], "at": come["at"], "n": come["n"], "_block": come["_block"], "to": pd.array(np.where(at < len(here), at, -1), "Int64")})

    ask = found.select("_g", F.col("next").alias("_block"), "at", "place", "end", "last", "n", F.lit(True).alias("asks"), F.col("_block").alias("from_block")).where("_block > from_block")
    both = found.select("_g", "_block", "at", "place", "end", "last", "n", F.lit(False).alias("asks"), F.col("_block").alias("from_block")).union(ask)
    linked = together(both, "asks", "at").mapInPandas(_by_block(links), f"_g {keys}, from_block long, at long, n long, _block long, to long")
    linked = cut_lineage(linked.select(F.struct("_g", F.col("from_block").alias("b"), "at").alias("source"), F.struct("_g", F.col("_block").alias("b"), F.col("to").alias("at")).alias("target"), "n"))

    reached = cut_lineage(found.where("_block = 0 AND at = 0").select(F.struct("_g", F.col("_block").alias("b"), "at").alias("node"), F.lit(0).cast("long").alias("base")))
    jumps = linked
    while True:
        new = reached.join(jumps, F.col("node") == F.col("source")).select(F.col("target").alias("node"), (F.col("base") + F.col("n")).alias("base"))
        new = cut_lineage(new)
        if new.isEmpty():
            break
        reached = cut_lineage(reached.union(new))
        onward = jumps.select(F.col("source").alias("middle"), F.col("target").alias("far"), F.col("n").alias("m"))
        jumps = cut_lineage(jumps.join(onward, F.col("target") == F.col("middle")).select("source", F.col("far").alias("target"), (F.col("n") + F.col("m")).alias("n")))
    known = reached.select(F.col("node._g").alias("_k"), F.col("node.b").alias("_b"), F.col("node.at").alias("_entry"), F.col("base").alias("_base"))

    def number(block: pd.DataFrame) -> pd.DataFrame:
        place = block["_place"].to_numpy()
        after = following(place, place + block["_size"].to_numpy())
        begins, at = np.zeros(len(block), np.int64), int(block["_entry"].iloc[0])
        while 0 <= at < len(block):
            begins[at] = 1
            at = int(after[at])
        return block[names].assign(shard=int(block["_base"].iloc[0]) - 1 + np.cumsum(begins))

    names = samples.columns
    schema = T.StructType([*samples.schema.fields, T.StructField("shard", T.LongType())])
    whole = placed.join(known, F.col("_g").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).drop("_k", "_b")
    return together(whole, "_part", "_at").mapInPandas(_by_block(number), schema)


def _by_block(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``f`` on the rows of each (_g, _block), which come one after the other; a block may go over batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            group, block = frame["_g"], frame["_block"].to_numpy()
            same = (group == group.shift()) | (group.isna() & group.shift().isna())
            cuts = [0, *(np.flatnonzero(~same.to_numpy(bool)[1:] | (np.diff(block) != 0)) + 1).tolist(), len(frame)]
            done = [f(frame.iloc[a:b].reset_index(drop=True)) for a, b in zip(cuts, cuts[1:-1], strict=False)]
            rest = frame.iloc[cuts[-2] :].reset_index(drop=True)
            if done:
                yield pd.concat(done, ignore_index=True)
        if rest is not None and len(rest):
            yield f(rest)

    return run


def pack_by_count(samples: DataFrame, per_shard: int, *order: str) -> DataFrame:
    """``samples`` with ``shard``: so many each, in the order given, over the whole table."""
    return ranked(samples, *order).withColumn("shard", F.floor(F.col("rank") / per_shard))


def manifest(samples: DataFrame, inputs: str, listing: DataFrame) -> DataFrame:
    """(sample_id, shard, input_index, path, status, member): one row an input with a path; missing ones have no member."""
    kept = F.filter(inputs, lambda x: F.coalesce(x["path"], F.lit("")) != "")
    each = samples.select("sample_id", "sample_index", "shard", F.posexplode(kept).alias("input_index", "i")).select("*", F.col("i.path").alias("path")).drop("i")
    found = each.join(listing.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    member = F.format_string("%09d.%d.%s", F.col("sample_index"), F.col("input_index"), F.when(suffix == "", "bin").otherwise(suffix))
    return found.select("sample_id", "shard", "input_index", "path", F.when(F.col("_there"), "ok").otherwise("missing").alias("status"), F.when(F.col("_there"), member).alias("member"))
