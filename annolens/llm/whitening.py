"""Whitening of embeddings from a compensated covariance.

Entries become whole numbers x = floor(scale * c) + offset, so that a dimension's sum S is exact and
n * x - S, an entry centred and taken n-fold, is exact too. Each task forms the outer products of its
centred rows with an error-free product (high and low part) and adds them in double-double, chunk by
chunk as a tree; it hands on one row of high and low parts. These rows are merged by tasks, FAN at a
time, again in double-double; the driver sees at most FAN of them, each of d * (d + 1) numbers. The
eigen-solve is LAPACK's syevd as numpy gives it: Householder reduction to tridiagonal form, then
divide and conquer.

Cases: rows whose vector is null or has null or non-finite entries are left out; shorter vectors count
as ended by zeros; rows with equal or null ids are rows of their own; a component along which the
vectors do not vary has a null ``whitened``; ``deviation`` is null where it passes a long; no usable row
gives no row; extra columns are ignored. A value of scale * c beyond 2^40 ends the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm._vectors import matrix, usable

FAN = 16
LARGEST = 1 << 40
_CELLS = 1 << 16
_SPLIT = float((1 << 27) + 1)


def two_sum(a, b):
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b and its rounding error."""
    p = a * b
    c, d = _SPLIT * a, _SPLIT * b
    ah, bh = c - (c - a), d - (d - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(a, b):
    """The sum of two double-doubles (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    high = s + e
    return high, e - (high - s)


def dd_total(high: np.ndarray, low: np.ndarray):
    """The double-double sum over the rows of two matrices, halves added to halves."""
    while len(high) > 1:
        half, odd = len(high) // 2, len(high) % 2
        h, l = dd_add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))  # noqa: E741
        high, low = (np.concatenate([h, high[-1:]]), np.concatenate([l, low[-1:]])) if odd else (h, l)
    return high[0], low[0]


@dataclass
class Model:
    """n vectors with sums S by dimension; components in columns, by falling eigenvalue."""

    scale: int
    offset: int
    n: int
    sums: list[int]
    largest: int
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0

    def whole(self, column: pa.Array) -> np.ndarray:
        return _whole(column, len(self.sums), self.scale, self.offset)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit integers where they fit, else as Python's."""
        if self.n * self.largest < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def along(self, d: np.ndarray, k: int) -> np.ndarray:
        """Centred rows ``d`` on the first ``k`` components, over the root of their eigenvalues; nan where there is no variance."""
        root = np.sqrt(np.where(self.varies(k), self.values[:k], np.nan))
        return (d.astype(np.float64) / self.n) @ self.vectors[:, :k] / root

    def varies(self, k: int) -> np.ndarray:
        return self.values[:k] > max(self.trace, 0.0) * len(self.sums) * 2.0**-50


def _whole(column: pa.Array, d: int, scale: int, offset: int) -> np.ndarray:
    x = np.floor(scale * matrix(column, d))
    if len(x) and np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"an entry times {scale} is beyond {LARGEST}")
    return x.astype(np.int64) + offset


def _parts(d: np.ndarray):
    """Integers as a double and the rest that it leaves out."""
    high = d.astype(np.float64)
    if d.dtype == object:
        rest = [int(v) - int(h) for v, h in zip(d.ravel(), high.ravel())]
        return high, np.array(rest, np.float64).reshape(d.shape)
    return high, (d - high.astype(np.int64)).astype(np.float64)


def sums(vectors: DataFrame, vector: str, scale: int, offset: int) -> Model | None:
    """The number of usable vectors and the exact sums of their whole entries."""
    some = vectors.where(usable(vector)).select(vector)
    d = some.agg(F.max(F.size(vector))).first()[0]
    if not d:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest, total = 0, 0, [0] * d
        for b in batches:
            x = _whole(b.column(0), d, scale, offset)
            if len(x):
                n, largest = n + len(x), max(largest, int(np.abs(x).max()))
                total = [t + s for t, s in zip(total, x.sum(axis=0).tolist())]
        if n:
            cells = pa.array(map(Decimal, [n, largest, *total]), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-2, d), pa.int32()), cells], names=["dim", "v"])

    rows = some.mapInArrow(run, "dim int, v decimal(38,0)").groupBy("dim").agg(F.sum("v").alias("s"), F.max("v").alias("m")).collect()
    found = {r.dim: r for r in rows}
    return Model(scale, offset, int(found[-2].s), [int(found[i].s) for i in range(d)], int(found[-1].m))


def covariance(vectors: DataFrame, vector: str, model: Model) -> np.ndarray:
    """The covariance of the whole entries, divisor n."""
    d = len(model.sums)
    i, j = np.triu_indices(d)
    step = max(1, _CELLS // len(i))
    out = "high binary, low binary"

    def row(high, low) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (high, low)], names=["high", "low"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            high, low = _parts(model.centred(model.whole(b.column(0))))
            for k in range(0, len(high), step):
                h, l = high[k : k + step], low[k : k + step]  # noqa: E741
                p, e = two_product(h[:, i], h[:, j])
                if l.any():
                    e = e + (h[:, i] * l[:, j] + l[:, i] * h[:, j])
                part = dd_total(p, e)
                total = part if total is None else dd_add(total, part)
        if total is not None:
            yield row(*total)

    def unpack(cells) -> np.ndarray:
        return np.array([np.frombuffer(c, "<f8") for c in cells])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = dd_total(unpack(b.column(0).to_pylist()), unpack(b.column(1).to_pylist()))
                total = part if total is None else dd_add(total, part)
        if total is not None:
            yield row(*total)

    some = vectors.where(usable(vector)).select(vector)
    parts, left = some.mapInArrow(products, out), some.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(merge, out)
    rows = parts.collect()
    high, low = dd_total(unpack(r.high for r in rows), unpack(r.low for r in rows))
    v = np.zeros((d, d))
    v[i, j] = v[j, i] = (high + low) / float(model.n) ** 3
    return v


def fit(vectors: DataFrame, vector: str = "embedding", scale: int = 1024, offset: int = 100_000) -> Model | None:
    """The components of all usable vectors; None without any."""
    model = sums(vectors, vector, scale, offset)
    if model:
        v = covariance(vectors, vector, model)
        values, found = np.linalg.eigh(v)
        found = found[:, ::-1]
        at = np.abs(found).argmax(axis=0)
        model.values, model.vectors = values[::-1], found * np.sign(found[at, range(len(at))])
        model.trace = float(np.trace(v))
    return model


def identity_error(vectors: DataFrame, vector: str, model: Model, k: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors less the identity.

    Centred entries sum to zero exactly, so what is multiplied here has been centred before.
    """
    use = np.flatnonzero(model.varies(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(use), len(use)))
        for b in batches:
            w = model.along(model.centred(model.whole(b.column(0))), k)[:, use]
            total += w.T @ w
        cells = pa.array(range(total.size), pa.int32())
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], names=["cell", "v"])

    if not len(use):
        return None
    rows = vectors.where(usable(vector)).select(vector).mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    found = np.array([r.v for r in sorted(rows, key=lambda r: r.cell)]).reshape(len(use), -1) / model.n
    return float(np.abs(found - np.eye(len(use))).max())


def whiten(vectors: DataFrame, model: Model | None, components: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error for every usable row and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    k = min(components, len(model.sums))
    error = identity_error(vectors, vector, model, k)
    explained = model.values[:k] / model.trace if model.trace > 0 else np.full(k, np.nan)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    reals = lambda x: pa.array(x, pa.float64(), from_pandas=True)  # noqa: E731  not a number: null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, rows = model.centred(model.whole(b.column(1))), b.num_rows
            wide = d.dtype == object or rows and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62
            squares = (d.astype(object) if wide else d) ** 2
            deviation = [v if v < 1 << 63 else None for v in map(int, squares.sum(axis=1))]
            again = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, model.n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(pa.array(again)),
                    reals(model.along(d, k).ravel()),
                    reals(np.tile(explained, rows)),
                    reals(np.full(rows * k, np.nan if error is None else error)),
                ],
                names=names,
            )

    return vectors.where(usable(vector)).select(id_col, vector).mapInArrow(run, out)
