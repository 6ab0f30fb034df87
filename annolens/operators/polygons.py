"""Polygons in Arrow functions, a batch of rings at a time: smallest rectangles, and the shares of polygons inside boxes.

Lambdas over arrays are interpreted element by element; here all corners of a batch are one numpy array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from annolens.operators import arrays

#: Elements of one step's arithmetic.
STEP = 2_000_000
RECTANGLE = "struct<x:double,y:double,w:double,h:double,r:double>"


def _chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, number of corners) of the lower chain of each row's points, which are sorted."""
    rows, size = x.shape
    held, n, at = np.zeros((rows, size), np.int64), np.zeros(rows, np.int64), np.arange(rows)
    for j in range(size):
        some = at[n > 1]
        while len(some):
            o, a = held[some, n[some] - 2], held[some, n[some] - 1]
            ox, oy = x[some, o], y[some, o]
            left = (x[some, a] - ox) * (y[some, j] - oy) - (y[some, a] - oy) * (x[some, j] - ox) > 0
            some = some[~left]
            n[some] -= 1
            some = some[n[some] > 1]
        held[at, n] = j
        n += 1
    return held, n


def _hulls(row: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y) of the corners of each row's convex hull, in order; fewer than three distinct points stay as they are, sorted."""
    order = np.lexsort((y, x, row))
    row, x, y = row[order], x[order], y[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    row, x, y = row[new], x[new], y[new]
    of, start, n = np.unique(row, return_index=True, return_counts=True)
    small = (n < 3)[np.repeat(np.arange(len(of)), n)]
    parts = [(row[small], np.zeros(small.sum(), np.int64), x[small], y[small])]
    for size in np.unique(n[n > 2]):
        some = np.flatnonzero(n == size)
        px, py = (v[start[some][:, None] + np.arange(size)] for v in (x, y))
        for k, (a, b) in enumerate(((px, py), (px[:, ::-1], py[:, ::-1]))):
            held, m = _chain(a, b)
            i, j = np.nonzero(np.arange(size) < (m - 1)[:, None])  # the last is the other chain's first
            parts.append((of[some][i], np.full(len(i), k), a[i, held[i, j]], b[i, held[i, j]]))
    row, half, x, y = (np.concatenate(v) for v in zip(*parts))
    order = np.lexsort((half, row))
    return row[order], x[order], y[order]


def smallest_rectangles(points: pa.Array) -> pa.Array:
    """The rectangle of least area around each row's points, one side along an edge of their hull."""
    row, _, each = arrays.flat(points)
    x, y = arrays.doubles(each, "x"), arrays.doubles(each, "y")
    good = ~np.isin(row, row[~np.isfinite(x + y)])
    row, x, y = _hulls(row[good], x[good], y[good])
    n = np.bincount(row, minlength=len(points))
    first = np.cumsum(n) - n
    after = np.arange(len(row)) + 1
    after[(first + n - 1)[n > 0]] = first[n > 0]
    dx, dy = x[after] - x, y[after] - y
    length = np.sqrt(dx * dx + dy * dy)
    apart = length > 0
    c, s = np.where(apart, dx / np.where(apart, length, 1), 1.0), np.where(apart, dy / np.where(apart, length, 1), 0.0)
    many, out = n[row], []
    for few in arrays.steps(np.cumsum(many) - many, int(many.sum()), STEP):
        e = np.arange(*np.searchsorted(np.cumsum(many) - many, (few.start, few.stop)))
        k = many[e]
        start = np.cumsum(k) - k
        at = np.arange(k.sum()) + np.repeat(first[row[e]] - start, k)
        ce, se = np.repeat(c[e], k), np.repeat(s[e], k)
        u, v = x[at] * ce + y[at] * se, y[at] * ce - x[at] * se
        out.append([f.reduceat(w, start) for w in (u, v) for f in (np.minimum, np.maximum)])
    u0, u1, v0, v1 = (np.concatenate(w) for w in zip(*out)) if out else np.empty((4, 0))
    w, h, cu, cv = u1 - u0, v1 - v0, (u0 + u1) / 2, (v0 + v1) / 2
    angle = np.arctan2(s, c) + np.where(w < h, np.pi / 2, 0.0)
    found = {"x": cu * c - cv * s, "y": cu * s + cv * c, "w": np.maximum(w, h), "h": np.minimum(w, h), "r": angle - np.pi * np.floor((angle + np.pi / 4) / np.pi)}
    order = np.lexsort((found["h"], found["w"], found["y"], found["x"], found["r"], np.round(w * h, 9), row))
    best = order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))] if len(order) else order
    at = np.zeros(len(points), np.int64)
    at[row[best]] = best
    none = n == 0
    return pa.StructArray.from_arrays([pa.array(np.where(none, np.nan, v[at] if len(v) else np.nan), mask=none) for v in found.values()], list(found))


def _before(row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The position of the corner before each corner of its ring."""
    before, first = np.arange(len(row)) - 1, np.cumsum(n) - n
    before[first[n > 0]] = (first + n - 1)[n > 0]
    return before


def _areas(row: np.ndarray, x: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
    n = np.bincount(row, minlength=rows)
    q = _before(row, n)
    twice = np.bincount(row, weights=x[q] * y - x * y[q], minlength=rows)
    return np.where(n < 3, 0.0, np.abs(twice) / 2)


def shares(points: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, least: float) -> pa.Array:
    """The area of each row's polygon inside its box over the whole area, which counts as ``least`` at least; null for a polygon with a coordinate that is no finite number."""
    rows = len(points)
    row, _, each = arrays.flat(points)
    x, y = arrays.doubles(each, "x"), arrays.doubles(each, "y")
    bad = np.zeros(rows, bool)
    bad[row[~np.isfinite(x + y)]] = True
    keep = ~bad[row]
    row, x, y = row[keep], x[keep], y[keep]
    whole = _areas(row, x, y, rows)
    sides = [arrays.doubles(v) for v in (x1, x2, y1, y2)]
    for k, side in enumerate(sides):
        q = _before(row, np.bincount(row, minlength=rows))
        at, sign = (x if k < 2 else y), 1 if k % 2 == 0 else -1
        b = sign * (at - side[row])
        a = b[q]
        crosses, stays = (a >= 0) != (b >= 0), b >= 0
        f = a / np.where(crosses, a - b, 1)
        many = crosses.astype(np.int64) + stays
        place = np.cumsum(many) - many
        total = int(many.sum())
        nx, ny = np.empty(total), np.empty(total)
        i = crosses
        nx[place[i]], ny[place[i]] = (x[q] + (x - x[q]) * f)[i], (y[q] + (y - y[q]) * f)[i]
        last = (place + crosses)[stays]
        nx[last], ny[last] = x[stays], y[stays]
        row, x, y = np.repeat(row, many), nx, ny
    return pa.array(_areas(row, x, y, rows) / np.maximum(whole, least), mask=bad)
