"""Shared views of the given tables for the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where a query makes many rows of each that it reads.
TASK_ROWS = 250_000


def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks to deal so many rows to: as many as the session has, and more where they would hold over TASK_ROWS each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed predictions: (video, label, frame in minutes, position_ms, confidence, ord)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("video"), F.col("event_type").alias("label"), F.floor(micros() / 60_000_000).cast("long").alias("frame"),
        F.floor(micros() / 1000).cast("long").alias("position_ms"), F.col("value").cast("double").alias("confidence"), F.col("event_id").cast("long").alias("ord"),
    )


#: The same in SQL, to stand before a query.
PREDICTIONS = """WITH pred AS (
  SELECT user_id::BIGINT AS video, event_type AS label, (epoch_us(ts) // 60000000)::BIGINT AS frame,
         (epoch_us(ts) // 1000)::BIGINT AS position_ms, value::DOUBLE AS confidence, event_id::BIGINT AS ord FROM events)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with the SQL for the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
