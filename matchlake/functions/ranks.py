"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a local session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="matchlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder that the session names."""
    context, folder = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def in_ranges(rows: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
    """``rows`` sorted by ranges, checkpointed, with the number of the range (``_part``) and the place in it (``_at``)."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut_lineage(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def ranked(rows: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order given, which must be total.

    Rows are sorted by ranges; a rank is the place in its range plus the sizes of the ranges
    before, of which there are as many as partitions.
    """
    laid = in_ranges(rows, *order, partitions=partitions)
    sizes = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return laid.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
