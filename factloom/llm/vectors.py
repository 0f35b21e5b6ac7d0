"""Vectors of whole numbers: which rows of an embedding table take part, and numpy matrices of their Arrow batches.

A vector takes part if it is not null and none of its entries is null, NaN or infinite. Entry c becomes
``floor(1024 * c)``, c as double, held within +-2^40. A shorter vector counts as filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Beyond this, in size, an entry counts as this; sums over any table then stay exact.
MOST = 1 << 40
#: Numbers of a matrix that a task works on at a time.
CELLS = 1 << 19


def whole(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns (id, x) of the rows that take part; all other columns are left unread."""
    entries = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    held = lambda c: F.greatest(F.least(F.floor(c * F.lit(float(SCALE))), F.lit(MOST)), F.lit(-MOST))
    return entries.where(F.col("v").isNotNull() & finite).select("id", F.transform("v", held).alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Rows by dimensions (default: of the longest) of a list column without nulls, zeros where a list is shorter."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    long = np.diff(at)
    if dims is None:
        dims = int(long.max(initial=0))
    flat = column.values.to_numpy()[at[0] : at[-1]] if len(long) else np.zeros(0, np.int64)
    if (long == dims).all():
        return flat.reshape(len(long), dims)
    out = np.zeros((len(long), dims), np.int64)
    out[np.repeat(np.arange(len(long)), long), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], long)] = flat
    return out


def chunks(batches: Iterator[pa.RecordBatch], dims: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their matrix, about ``CELLS`` numbers each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = dims or int(np.diff(batch.column("x").offsets.to_numpy()).max(initial=0))
        step = max(1, CELLS // max(width, 1))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, matrix(part.column("x"), dims)
