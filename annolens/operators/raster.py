"""Polygons as runs of pixels, column by column, and what is made of runs: areas, overlaps, run lengths, boxes.

A pixel belongs to a polygon if its centre does, by the even-odd rule. Polygons are image_id, det_id, points
in pixels; runs are image_id, det_id, px, y0, y1 (the pixels y0 to y1 - 1 of column px).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.operators import arrays
from annolens.sources.folders import shipped

#: Columns of pixels that ``owners`` looks at together, and the runs of one step of its arithmetic.
STRIP, STEP_RUNS = 8, 200_000
_RUN = "array<struct<px:bigint,y0:bigint,y1:bigint>>"
_MEASURES = "struct<area:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>"


def _crossed(points: pa.Array, width: int, height: int) -> pa.Array:
    """The runs of each polygon: its edges' crossings with the middle of every column, in order, two by two."""
    row, n, ring = arrays.flat(points)
    x, y = arrays.doubles(ring, "x"), arrays.doubles(ring, "y")
    first = np.cumsum(n) - n
    after = np.arange(len(x)) + 1
    last = first[n > 0] + n[n > 0] - 1
    after[last] = first[n > 0]
    bx, by = x[after] if len(x) else x, y[after] if len(x) else y
    good = np.isfinite(x + y + bx + by) & (n[row] >= 3)
    low, high = np.minimum(x, bx), np.maximum(x, bx)
    a = np.clip(np.ceil(np.where(good, low, 0) - 0.5), 0, width).astype(np.int64)
    b = np.clip(np.floor(np.where(good, high, -1) - 0.5), -1, width - 1).astype(np.int64)
    many = np.where(good, np.maximum(b - a + 1, 0), 0)
    edge = np.repeat(np.arange(len(x)), many)
    px = np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many) + a[edge]
    mid = px + 0.5
    cuts = (x[edge] > mid) != (bx[edge] > mid)
    edge, px, mid = edge[cuts], px[cuts], mid[cuts]
    at = y[edge] + (mid - x[edge]) * (by[edge] - y[edge]) / (bx[edge] - x[edge])
    order = np.lexsort((at, px, row[edge]))
    of, px, at = row[edge][order], px[order], np.clip(np.ceil(at[order] - 0.5), 0, height).astype(np.int64)
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (px[1:] != px[:-1])
    start = np.flatnonzero(new)
    place = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    i = np.flatnonzero((place[1:] % 2 == 1) & ~new[1:])  # the first of each two
    i = i[at[i + 1] > at[i]]
    return arrays.listed(of[i], len(points), px=px[i], y0=at[i], y1=at[i + 1])


def masks(polygons: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, det_id, runs array of (px, y0, y1)) of every polygon within an image of ``width`` x ``height``; one row a mask, none for a mask without pixels.

    Rows stay where they are: a table partitioned by image still is.
    """
    crossed = arrays.once(lambda points: _crossed(points, width, height), _RUN)
    return shipped(polygons).select("image_id", "det_id", crossed("points").alias("runs")).where(F.size("runs") > 0)


def each_run(masks: DataFrame) -> DataFrame:
    return masks.select("image_id", "det_id", F.explode("runs").alias("r")).select("image_id", "det_id", "r.*")


def gathered(runs: DataFrame) -> DataFrame:
    """Runs as masks: one row for each image_id, det_id."""
    return runs.groupBy("image_id", "det_id").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("px", "y0", "y1")])).alias("runs"))


def column_runs(polygons: DataFrame, width: int, height: int) -> DataFrame:
    """Runs of every polygon within an image of ``width`` x ``height``; one of fewer than three points has none."""
    return each_run(masks(polygons, width, height))


def areas(runs: DataFrame) -> DataFrame:
    """(image_id, det_id, area) in pixels."""
    return runs.groupBy("image_id", "det_id").agg(F.sum(F.col("y1") - F.col("y0")).alias("area"))


def _painted(items: pa.Array, det_type: pa.DataType) -> pa.Array:
    """For each row of masks (area, det_id, runs): the runs that are seen, painted from the largest to the smallest."""
    row, _, each = arrays.flat(items)
    item, n, runs = arrays.flat(each.field("runs"))
    area, det = arrays.longs(each, "area"), each.field("det_id")
    px, y0, y1 = (arrays.longs(runs, c) for c in ("px", "y0", "y1"))
    of = row[item]
    rank = np.empty(len(row), np.int64)
    rank[np.lexsort((arrays.order(det), -area))] = np.arange(len(row))
    order = np.lexsort((px, of))
    out = []
    new = np.ones(len(order), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (px[order][1:] != px[order][:-1])
    start = np.flatnonzero(new)
    for few in arrays.steps(start, len(order), STEP_RUNS):
        out.append(_paint(order[few], of, px, y0, y1, item, rank))
    who, of, px, low, high = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(5))
    return arrays.listed(of, len(items), det_id=det.take(pa.array(who)).cast(det_type), px=px, y0=low, y1=high)


def _paint(some, of, px, y0, y1, item, rank):
    new = np.ones(len(some), bool)
    new[1:] = (of[some][1:] != of[some][:-1]) | (px[some][1:] != px[some][:-1])
    column = np.cumsum(new) - 1
    ends = np.stack([np.concatenate([column, column]), np.concatenate([y0[some], y1[some]])])
    at = np.lexsort((ends[1], ends[0]))
    ends = ends[:, at]
    fresh = np.ones(ends.shape[1], bool)
    fresh[1:] = (ends[:, 1:] != ends[:, :-1]).any(axis=0)
    number = np.empty(len(at), np.int64)
    number[at] = np.cumsum(fresh) - 1
    where, y = ends[:, fresh]
    a, b = number[: len(some)], number[len(some) :]  # a run covers the spans a to b - 1 between ends of its column
    turn = np.argsort(rank[item[some]], kind="stable")
    many = (b - a)[turn]
    spans = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a[turn], many)
    owner = np.full(len(y), -1)
    owner[spans] = np.repeat(item[some][turn], many)  # of equal places the last stands
    seen = np.flatnonzero(owner >= 0)
    first = some[np.flatnonzero(new)[where[seen]]]
    return owner[seen], of[first], px[first], y[seen], y[seen + 1]


def owners(runs: DataFrame) -> DataFrame:
    """Runs in which each pixel belongs to the smallest of the polygons that cover it (ties: the larger det_id).

    ``runs`` may be masks. Masks meet by image and STRIP columns.
    """
    whole = shipped(runs) if "runs" in runs.columns else gathered(shipped(runs))
    area = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["y1"] - r["y0"])
    strip = lambda r: F.floor(r["px"] / STRIP)
    parts = whole.withColumn("area", area).select("image_id", "det_id", "area", "runs", F.explode(F.array_distinct(F.transform("runs", strip))).alias("strip"))
    parts = parts.select("image_id", "strip", F.struct("area", "det_id", F.filter("runs", lambda r: strip(r) == F.col("strip")).alias("runs")).alias("m"))
    kind = whole.schema["det_id"].dataType
    told = pa.int32() if kind.simpleString() == "int" else pa.string() if kind.simpleString() == "string" else pa.int64()
    painted = arrays.once(lambda items: _painted(items, told), f"array<struct<det_id:{kind.simpleString()},px:bigint,y0:bigint,y1:bigint>>")
    seen = parts.groupBy("image_id", "strip").agg(F.collect_list("m").alias("masks")).select("image_id", F.explode(painted("masks")).alias("s"))
    return seen.select("image_id", "s.*")


def _counted(runs: pa.Array, width: int, height: int) -> pa.Array:
    row, n, each = arrays.flat(runs)
    px, y0, y1 = (arrays.longs(each, c) for c in ("px", "y0", "y1"))
    # the whole masks one after another: touching and overlapping runs are one
    base = row * (width * height + 2)
    a, b = base + px * height + y0, base + px * height + y1
    order = np.argsort(a, kind="stable")
    a, b, row = a[order], b[order], row[order]
    far = np.maximum.accumulate(b) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > far[:-1]
    start = np.flatnonzero(new)
    low, of = a[start], row[start]
    high = far[np.append(start[1:], len(a)) - 1] if len(a) else far
    low, high = low - of * (width * height + 2), high - of * (width * height + 2)
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    before = np.where(np.append(True, last[:-1]) if len(of) else last, 0, np.append(0, high[:-1]) if len(of) else high)
    rest = np.where(last, width * height - high, 0)
    values = np.stack([low - before, high - low, rest], axis=1).ravel() if len(of) else np.empty(0, np.int64)
    keep = np.stack([np.ones(len(of), bool), np.ones(len(of), bool), rest > 0], axis=1).ravel() if len(of) else np.empty(0, bool)
    return arrays.listed(np.repeat(of, 3)[keep], len(runs), values[keep])


def run_counts(runs: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, det_id, counts): lengths of alternating runs, column after column, the first of pixels outside, as mask records have them. ``runs`` may be masks."""
    whole = shipped(runs) if "runs" in runs.columns else gathered(shipped(runs))
    counted = arrays.once(lambda r: _counted(r, width, height), "array<bigint>")
    return whole.select("image_id", "det_id", counted("runs").alias("counts"))


def _cut(counts: pa.Array, height: int) -> pa.Array:
    row, n, each = arrays.flat(counts)
    value = arrays.longs(each)
    end = np.cumsum(value)
    end -= np.repeat((end - value)[np.cumsum(n)[n > 0] - n[n > 0]], n[n > 0])
    odd = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) % 2 == 1
    at = odd & (value > 0)
    of, b, a = row[at], end[at], (end - value)[at]
    first, many = a // height, (b - 1) // height - a // height + 1
    i = np.repeat(np.arange(len(of)), many)
    px = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
    return arrays.listed(of[i], len(counts), px=px, y0=np.maximum(a[i], px * height) - px * height, y1=np.minimum(b[i], (px + 1) * height) - px * height)


def masks_of(records: DataFrame, height: int) -> DataFrame:
    """Masks given as ``counts`` (image_id, det_id, counts), their runs cut at the ends of columns."""
    cut = arrays.once(lambda counts: _cut(counts, height), _RUN)
    return shipped(records).select("image_id", "det_id", cut("counts").alias("runs")).where(F.size("runs") > 0)


def runs_of(records: DataFrame, height: int) -> DataFrame:
    """Runs of masks given as ``counts`` (image_id, det_id, counts), cut at the ends of columns."""
    return each_run(masks_of(records, height))


def _measured(runs: pa.Array) -> pa.Array:
    row, n, each = arrays.flat(runs)
    px, y0, y1 = (arrays.longs(each, c) for c in ("px", "y0", "y1"))
    start, none = (np.cumsum(n) - n)[n > 0], n == 0
    found = {"area": np.add.reduceat(y1 - y0, start), "x1": np.minimum.reduceat(px, start), "y1": np.minimum.reduceat(y0, start), "x2": np.maximum.reduceat(px, start) + 1, "y2": np.maximum.reduceat(y1, start)} if len(start) else dict.fromkeys(("area", "x1", "y1", "x2", "y2"), px)
    at = np.cumsum(~none) - 1
    wide = lambda v: v[np.maximum(at, 0)] if len(v) else np.zeros(len(n), np.int64)
    return pa.StructArray.from_arrays([pa.array(wide(v)) for v in found.values()], list(found), mask=pa.array(none))


def measured(masks: DataFrame) -> DataFrame:
    """(image_id, det_id, area, x1, y1, x2, y2) of each mask: its pixels and the box around them."""
    found = arrays.once(_measured, _MEASURES)
    return shipped(masks).select("image_id", "det_id", found("runs").alias("m")).where("m IS NOT NULL").select("image_id", "det_id", "m.*")


def through_counts(polygons: DataFrame, width: int, height: int) -> DataFrame:
    """``measured`` of the ``masks`` of polygons, by way of ``run_counts`` and ``masks_of``: the four steps in one Arrow function, so that no runs leave it."""
    steps = arrays.once(lambda points: _measured(_cut(_counted(_crossed(points, width, height), width, height), height)), _MEASURES)
    return shipped(polygons).select("image_id", "det_id", steps("points").alias("m")).where("m IS NOT NULL").select("image_id", "det_id", "m.*")


def boxes(runs: DataFrame) -> DataFrame:
    """(image_id, det_id, x1, y1, x2, y2) around each mask's pixels."""
    return runs.groupBy("image_id", "det_id").agg(F.min("px").alias("x1"), F.min("y0").alias("y1"), (F.max("px") + 1).alias("x2"), F.max("y1").alias("y2"))
