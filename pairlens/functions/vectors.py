"""Vector arithmetic on array columns, and Arrow views of them inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def negate(v: Column) -> Column:
    return F.transform(v, lambda x: -x)


def matrix_of(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of a list column as a 2-D array, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(dtype, copy=False) if rows else np.zeros((0, 0), dtype)


def list_column(matrix: np.ndarray, value_type: pa.DataType) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=value_type))
