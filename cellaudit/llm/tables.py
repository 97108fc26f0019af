"""Tables in the folder that all machines share, and rows as Arrow hands them over.

``spark.checkpoint.dir`` names the folder.  A table written there and read back cuts
the lineage, survives lost executors and shows the optimizer its true size.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """The shared folder; only a local session without one (tests) gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    location = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: Column, folds: int, number: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false where the key is null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == number, F.lit(False))


def in_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one row that is longer."""
    ends = np.cumsum(np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in _binary(batch.column(column))), np.int64, batch.num_rows))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array and where each row starts; nulls are empty."""
    values = _binary(column)
    if values.null_count:
        values = values.fill_null(b"")
    _, offsets, data = values.buffers()
    starts = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8), starts - starts[0]
