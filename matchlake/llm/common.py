"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..functions.ranks import cut_lineage, shared_folder

__all__ = ["cut_lineage", "fresh", "per_slice", "shared_folder", "slices", "table", "utf8", "written"]

#: Rows that a Python task turns into Python objects at a time; bounds the memory of a worker.
ROWS_AT_A_TIME = 1000
#: And so many bytes of text, as some operators hold arrays of eighty bytes a character.
TEXT_AT_A_TIME = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder: smaller than a checkpoint, for larger tables."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int = ROWS_AT_A_TIME, text_bytes: int = TEXT_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of so many rows and bytes of text at most, of one row at least."""
    import numpy as np

    ends = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            ends += np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    ends = np.cumsum(ends)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + text_bytes, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def per_slice(f: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = ROWS_AT_A_TIME, text_bytes: int = TEXT_AT_A_TIME) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` on slices of each Arrow batch, as mapInArrow takes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, text_bytes):
                yield f(part)

    return run


def utf8(column: pa.Array) -> tuple:
    """The bytes of a string column, end to end, and where each row starts; nulls are empty."""
    import numpy as np

    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
