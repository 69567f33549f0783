"""Helpers shared by the corpus operators: row identity, slices of Arrow batches, staging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decklens import session

#: A join side is broadcast up to this size, which is measured first; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

#: Text bytes that a Python task works on at once.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch on its way to a Python task. Spark's own bound (64 MB, 10,000 rows) counts
#: several times over in an executor: in the JVM's buffers, in the stream, and in the worker.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session hold about BATCH_BYTES."""
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, with Arrow batches of about BATCH_BYTES."""
    spark = df.sparkSession
    before = spark.conf.get(_BATCH_SETTING)
    bound_batches(spark)
    try:
        return session.staged(df)
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def measured(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """``df`` staged, and marked for broadcast if the sum of ``row_bytes`` is within BROADCAST_BYTES."""
    rows = staged(df)
    total = rows.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


def pieces(column: pa.Array, size: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.Array]:
    """A string column cut so that each piece holds about ``size`` bytes (or one long text), and ``rows`` at most."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > size or rows and i - start == rows:
            yield column.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if len(column):
        yield column.slice(start)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut in the same way by one of their columns."""
    for batch in batches:
        start = 0
        for piece in pieces(batch.column(column), size, rows):
            yield batch.slice(start, len(piece))
            start += len(piece)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Texts of a string column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: the same byte of all of them side by side, so that what is small or alike shrinks."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()
