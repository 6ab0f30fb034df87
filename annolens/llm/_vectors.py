"""Vectors of an Arrow column as a numpy matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, lambda x: number(x.cast("double"))), F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The lists of ``column``, none of them null, as rows of ``d`` doubles; shorter ones end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) == len(column) * d:
        return values.reshape(-1, d)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), d))
    out[np.arange(d) < sizes[:, None]] = values
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's doubles as bytes."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows, "<f8")], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 0))
