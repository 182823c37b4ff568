"""Vectors of an Arrow batch as rows of a matrix, and reductions of small rows that tasks make."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component times 1024 stays within these bounds, so that sums and squares of whole numbers keep to 64 bits.
LARGEST = 2**27


def whole(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): the rows that have exactly `dim` entries, none null or non-finite, and floor(1024 * entry) of each as int64.

    Entries beyond LARGEST / 1024 are refused: their squared distances have no 64-bit value.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    entries = pc.list_flatten(column)
    values = np.asarray(pc.fill_null(entries.cast(pa.float64()), float("nan")))
    ends = np.cumsum(np.maximum(sizes, 0))
    fits = np.flatnonzero(sizes == dim)
    if not len(fits):
        return fits, np.empty((0, dim), np.int64)
    m = values[(ends[fits] - dim)[:, None] + np.arange(dim)] if dim else np.empty((len(fits), 0))
    good = np.isfinite(m).all(axis=1)
    m = np.floor(1024 * m[good])
    if m.size and np.abs(m).max() > LARGEST:
        raise ValueError(f"vector entries lie within {LARGEST // 1024} of zero")
    return fits[good], m.astype(np.int64)


def finite_vector(c: Column) -> Column:
    """Whether a vector is there, and all its entries are there and finite."""
    return c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))


def long_list(m: np.ndarray) -> pa.Array:
    """The rows of a matrix of whole numbers as lists."""
    m = np.ascontiguousarray(m, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def summed(column: str, dim: int) -> Column:
    """Entrywise exact sums of a column of long lists, as one array of decimals."""
    return F.array(*(F.sum(F.col(column)[i].cast("decimal(38,0)")) for i in range(dim)))
