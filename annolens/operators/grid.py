"""Joins of boxes that overlap, by cells of a grid: no pair of boxes that are apart is looked at twice or in one task with all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolens.functions.geometry import columns, enclosing_box
from annolens.functions.overlap import overlaps
from annolens.operators import arrays, polygons
from annolens.operators.matching import CORNERS, named
from annolens.sources.folders import shipped

EPS, FEW = 1e-6, 64


def grid_pairs(a: DataFrame, b: DataFrame, keys: list[str], cell: float, few: int = 0) -> DataFrame:
    """Rows a_*, b_* of every two boxes (x1, y1, x2, y2) of equal ``keys`` that overlap, each pair once.

    Where ``a`` has ``few`` boxes of the same keys at most, every box of ``b`` looks at all of them: tables partitioned
    by ``keys`` stay where they are. Elsewhere a box is sent to the cells of side ``cell`` that it touches, about
    (w / cell + 1) * (h / cell + 1) of them; a pair comes out of the cell that holds the upper left corner of what both share.
    """

    def dealt(df: DataFrame, prefix: str) -> DataFrame:
        x1, y1, x2, y2 = columns(prefix, CORNERS)
        cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
        return named(df, prefix, tuple(keys)).withColumn("__x", cells(x1, x2)).withColumn("__y", cells(y1, y2))

    p, q = columns("a_", CORNERS), columns("b_", CORNERS)
    corner = lambda i: F.floor(F.greatest(p[i], q[i]) / cell)
    in_cells = lambda a, b: dealt(a, "a_").join(dealt(b, "b_"), [*keys, "__x", "__y"]).where(overlaps(p, q) & (F.col("__x") == corner(0)) & (F.col("__y") == corner(1))).drop("__x", "__y")
    if not few:
        return in_cells(a, b)
    counted = a.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    small, large = counted.where(F.col("__n") <= few).drop("__n"), counted.where(F.col("__n") > few).drop("__n")
    met = named(small, "a_", tuple(keys)).join(named(b, "b_", tuple(keys)), keys).where(overlaps(p, q))
    return met.unionByName(in_cells(large, b.join(large.select(*keys).distinct(), keys, "left_semi")))


def window_objects(windows: DataFrame, objects: DataFrame, least: float = 0.7, keep: tuple[str, ...] = ("det_id", "cls"), cell: float | None = None) -> DataFrame:
    """(image_id, x1, y1, x2, y2, ``keep``, iof): windows with the objects (image_id, points) of which they hold a share of at least ``least``.

    The share is the area of the polygon inside the window over its whole area, which counts as EPS at least; a polygon with a coordinate that is no finite number is in no window.
    ``cell`` is about the side of a window; without it, the mean side of all windows.
    """
    if cell is None:
        cell = windows.agg(F.avg(F.col("x2") - F.col("x1"))).first()[0] or 1.0
    boxed = objects.select("image_id", *keep, "points", *[c.alias(n) for c, n in zip(enclosing_box(F.col("points")), CORNERS.split())])
    near = grid_pairs(windows.select("image_id", *CORNERS.split()), boxed, ["image_id"], float(cell), FEW)
    share = arrays.once(lambda *v: polygons.shares(*v, EPS), "double")
    iof = share("b_points", *columns("a_", CORNERS))
    return shipped(near).withColumn("iof", iof).where(F.col("iof") >= least).select("image_id", *[F.col(f"a_{c}").alias(c) for c in CORNERS.split()], *[F.col(f"b_{c}").alias(c) for c in keep], "iof")
