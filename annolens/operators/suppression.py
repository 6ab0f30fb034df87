"""Suppression of overlapping detections and duplicate removal, within an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.functions.geometry import columns
from annolens.functions.overlap import iou, overlaps
from annolens.operators.grid import grid_pairs
from annolens.operators.matching import CORNERS, named


def suppress_greedy(boxes: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id",), id_col: str = "det_id") -> DataFrame:
    """(keys, id) of the boxes that stay: from the most confident on, a box goes if its IoU with a kept one is above ``threshold``.

    Each group's boxes are folded in order with one aggregate over an array.
    """
    one = F.struct((-F.col("conf")).alias("k"), F.col(id_col).alias("id"), *columns("", CORNERS))
    groups = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("all"))
    corners = lambda s: tuple(s[n] for n in CORNERS.split())

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(corners(k), corners(b)) > threshold), kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), step)
    return groups.select(*keys, F.explode(F.transform(kept, lambda k: k["id"])).alias(id_col))


def suppress_fast(boxes: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id",), id_col: str = "det_id") -> DataFrame:
    """Rows that no more confident box overlaps by ``threshold`` or more, whether that one stays or not: an anti join."""
    a, b = boxes, named(boxes.select(*keys, id_col, "conf", *CORNERS.split()), "o_", keys)
    ahead = (F.col("o_conf") > F.col("conf")) | ((F.col("o_conf") == F.col("conf")) & (F.col(f"o_{id_col}") < F.col(id_col)))
    x, y = columns("", CORNERS), columns("o_", CORNERS)
    left, right = a.alias("a"), b.withColumnsRenamed({k: f"o_{k}" for k in keys}).alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"o_{k}"))
    return left.join(right, same & ahead & overlaps(x, y) & (iou(x, y) >= threshold), "left_anti")


def top_per_group(boxes: DataFrame, k: int, keys: tuple[str, ...] = ("image_id",), order: tuple = ()) -> DataFrame:
    """The ``k`` most confident rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*(order or (F.desc("conf"), F.asc("det_id"))))
    return boxes.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def non_max_suppression(scored: DataFrame, conf: float = 0.25, threshold: float = 0.45, multi_label: bool = False, classes: list[int] | None = None, agnostic: bool = False, max_nms: int = 30000, max_det: int = 300) -> DataFrame:
    """The full pipeline over rows with an array ``scores``, one per class: candidates, classes, caps, suppression, caps."""
    long = scored.select("*", F.posexplode("scores").alias("cls", "conf")).where(F.col("conf") > conf)
    if not multi_label:
        w = Window.partitionBy("image_id", "det_id").orderBy(F.desc("conf"), "cls")
        long = long.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    if classes is not None:
        long = long.where(F.col("cls").isin(classes))
    order = (F.desc("conf"), F.asc("det_id"), F.asc("cls"))
    few = top_per_group(long.drop("scores"), max_nms, order=order)
    kept = suppress_greedy(few.withColumn("key", F.struct("det_id", "cls")), threshold, ("image_id",) if agnostic else ("image_id", "cls"), "key")
    back = kept.select("image_id", "key.det_id", "key.cls")
    return top_per_group(few.join(back, ["image_id", "det_id", "cls"]), max_det, order=order)


def merge_tiles(boxes: DataFrame, threshold: float = 0.3, name: str = "tile") -> DataFrame:
    """Boxes of tiles named ``image__..x___y`` moved to the image and suppressed fast, per class."""
    moved = boxes.withColumn("image_id", F.regexp_extract(name, "^(.*?)__", 1))
    x0, y0 = (F.regexp_extract(name, r"__(?:\d+__)?(\d+)___(\d+)$", k).cast("double") for k in (1, 2))
    shift = {"x1": x0, "y1": y0, "x2": x0, "y2": y0}
    return suppress_fast(moved.withColumns({c: F.col(c) + v for c, v in shift.items()}), threshold, ("image_id", "cls"))


def merge_slices(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes found in slices (with the slice's origin ox, oy) moved to the image and suppressed greedily by class: (image_id, cls, det_id)."""
    origin = {"x1": "ox", "x2": "ox", "y1": "oy", "y2": "oy"}
    return suppress_greedy(boxes.withColumns({c: F.col(c) + F.col(o) for c, o in origin.items()}), threshold, ("image_id", "cls"))


def remove_duplicates(boxes: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal ``keys`` the first by ``order`` stays."""
    return first_of(boxes, keys, order)


def first_of(boxes: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each ``keys``, the first by ``order``."""
    return boxes.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def union_by_id(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``a``, and those of ``b`` whose key ``a`` lacks."""
    return a.unionByName(b.join(a, key, "left_anti"))


def remove_duplicate_tracks(a: DataFrame, b: DataFrame, distance: float = 0.15, cell: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Of track pairs with IoU distance below ``distance`` (1 at most) the younger goes (ties: the one of ``b``); rows have stream, track_id, frames, corners.

    Tracks meet in cells of side ``cell``, about that of a box, so only those that overlap are compared.
    """
    near = grid_pairs(a, b, ["stream"], cell)
    close = near.where(1 - iou(columns("a_", CORNERS), columns("b_", CORNERS)) < distance)
    older = F.col("a_frames") > F.col("b_frames")
    drop_b = close.where(older | (F.col("a_frames") == F.col("b_frames"))).select("stream", F.col("b_track_id").alias("track_id"))
    drop_a = close.where(F.col("a_frames") < F.col("b_frames")).select("stream", F.col("a_track_id").alias("track_id"))
    return a.join(drop_a, ["stream", "track_id"], "left_anti"), b.join(drop_b, ["stream", "track_id"], "left_anti")
