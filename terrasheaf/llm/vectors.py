"""Vector columns in Arrow batches, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether an array column is there and holds neither nulls nor NaN nor infinities; never null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values in double precision, offsets) of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    return values, offsets - offsets[0]


def fitted(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of the first `width` components of each row, zeros where a row has fewer."""
    values, offsets = rows_of(column)
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(size), width))
    take = np.minimum(size, width)
    row = np.repeat(np.arange(len(size)), take)
    place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    out[row, place] = values[np.repeat(offsets[:-1], take) + place]
    return out


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a to all rows of b; exact for whole numbers below 2**53."""
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
