"""Arrow arrays of a batch as flat numpy arrays, and back: what array columns are computed with inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each element, length of each row, elements) of a list array; a null list is empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    return np.repeat(np.arange(len(lists)), n), n, lists.flatten()


def _field(elements: pa.Array, name: str | None) -> pa.Array:
    if name is None:
        return elements
    return pa.array(elements.flatten()[elements.type.get_field_index(name)]) if elements.null_count else elements.field(name)


def doubles(elements: pa.Array, name: str | None = None) -> np.ndarray:
    """A field of structs, or the elements themselves, as doubles; null is NaN."""
    return _field(elements, name).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def longs(elements: pa.Array, name: str | None = None) -> np.ndarray:
    return _field(elements, name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def order(values: pa.Array) -> np.ndarray:
    """Numbers in the order of ``values``, equal for equal ones."""
    if pa.types.is_integer(values.type):
        return longs(values)
    return np.unique(values.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]


def listed(row: np.ndarray, rows: int, values: np.ndarray | None = None, **fields) -> pa.Array:
    """A list array of ``rows`` rows from elements sorted by ``row``: plain ``values`` or structs of ``fields``."""
    ends = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=ends[1:]) if rows else None
    as_array = lambda v: v if isinstance(v, pa.Array) else pa.array(v)
    each = as_array(values) if values is not None else pa.StructArray.from_arrays([as_array(v) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(ends), each)


def steps(start: np.ndarray, end: int, size: int) -> Iterator[slice]:
    """Slices of about ``size`` elements that begin at ``start`` positions only."""
    at = 0
    while at < end:
        k = np.searchsorted(start, at + size)
        to = int(start[k]) if k < len(start) else end
        yield slice(at, to)
        at = to


def once(f, returns: str):
    """An Arrow function that is computed once a row, however often its column is used."""
    return F.arrow_udf(f, returns).asNondeterministic()
