"""Chunks of vectors against chunks of queries: matrix products name the candidates, whose values are then added up exactly as the expressions do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.operators import arrays
from annolens.sources.folders import shipped

VECTORS, QUERIES, STEP = 2048, 1024, 256


def chunked(vectors: DataFrame, count: int, key: str, vector: str, size: int) -> DataFrame:
    """``rows``: arrays of (key, v) of about ``size`` vectors each, dealt by the hash of the key; ``count`` is about their number."""
    shipped(vectors).sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    n = max(1, -(-count // size))
    one = F.struct(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    dealt = vectors.withColumn("__chunk", F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(n))).repartition(min(n, 2000), "__chunk")
    return dealt.groupBy("__chunk").agg(F.collect_list(one).alias("rows")).select("rows")


def chunked_by(df: DataFrame, by: str, size: int, name: str, key: str, vector: str, *more: str) -> DataFrame:
    """(``by``, ``name``): arrays of (key, v, ``more``) of about ``size`` rows of one ``by`` each."""
    shipped(df).sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    n = df.groupBy(by).agg(F.ceil(F.count("*") / size).alias("__n"))
    one = F.struct(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"), *more)
    dealt = df.join(F.broadcast(n), by).withColumn("__chunk", F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.col("__n")))
    return dealt.groupBy(by, "__chunk").agg(F.collect_list(one).alias(name)).select(by, name)


def _matrix(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    v = arrays.doubles(rows.field("v").flatten())
    return rows.field("key"), v.reshape(len(rows), -1)


def exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Values of row pairs, added from the first entry to the last."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * v[:, j] if metric == "dot" else (q[:, j] - v[:, j]) ** 2
    return total if metric == "dot" else np.sqrt(total)


def candidates(q: np.ndarray, v: np.ndarray, order: np.ndarray, k: int, metric: str, digits: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, value) of every pair that may be among a query's ``k`` nearest by the rounded value, then ``order``.

    Of one query's vectors with the very same value the first ``k`` by ``order`` are enough.
    """
    slack = 2.0 * 10.0**-digits
    big_q, big_v = (q * q).sum(axis=1), (v * v).sum(axis=1)
    near = q @ v.T
    if metric == "dot":
        error = 1e-14 * q.shape[1] * np.sqrt(big_q.max(initial=0) * big_v.max(initial=0))
        low, high = -near, -near
    else:
        square, off = big_q[:, None] + big_v - 2 * near, 1e-14 * q.shape[1] * (big_q.max(initial=0) + big_v.max(initial=0))
        low, high, error = np.sqrt(np.maximum(square - off, 0)), np.sqrt(np.maximum(square + off, 0)), 0.0
    if allowed is not None:
        low, high = np.where(allowed, low, np.inf), np.where(allowed, high, np.inf)
    if v.shape[0] > k:
        limit = np.partition(high, k - 1, axis=1)[:, k - 1]
        keep = low <= (limit + slack + 2 * error)[:, None]
    else:
        keep = np.ones(low.shape, bool)
    a, b = np.nonzero(keep & np.isfinite(low))
    value = exact(q[a], v[b], metric)
    at = np.lexsort((order[b], value, a))
    a, b, value = a[at], b[at], value[at]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (value[1:] != value[:-1])
    place = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else np.empty(0, int)
    few = place < k
    return a[few], b[few], value[few]


def _ranked(keys: pa.Array) -> np.ndarray:
    return np.argsort(np.asarray(pa.compute.sort_indices(keys)), kind="stable")


def nearest(k: int, metric: str, digits: int, key_type, query_type, ring: bool = False):
    """An Arrow function of (rows, asked): the candidates (query, key, value) of a chunk of vectors for each query of a chunk.

    With ``ring`` a vector is looked at if its angle is at most limit from to (fields of both rows).
    """

    def found(rows: pa.Array, asked: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401

        n, out = [], []
        for i in range(len(rows)):
            keys, v = _matrix(rows[i].values)
            names, q = _matrix(asked[i].values)
            order, count = _ranked(keys), 0
            angle, to, limit = (arrays.doubles(x.values, c) for x, c in ((rows[i], "angle"), (asked[i], "to"), (asked[i], "limit"))) if ring else (None, None, None)
            for at in range(0, len(q), STEP):
                allowed = np.abs(angle - to[at : at + STEP, None]) <= limit[at : at + STEP, None] if ring else None
                a, b, value = candidates(q[at : at + STEP], v, order, k, metric, digits, allowed)
                out.append(pa.StructArray.from_arrays([names.take(pa.array(a + at)), keys.take(pa.array(b)), pa.array(value)], ["query", "key", "value"]))
                count += len(a)
            n.append(count)
        ends = pa.array(np.cumsum([0, *n]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.concat_arrays(out))

    return arrays.once(found, f"array<struct<query:{query_type.simpleString()},key:{key_type.simpleString()},value:double>>")
