"""One-to-one matching of truth boxes and predictions. The matchers differ in their tie rules on purpose.

Boxes are DataFrames with image_id, cls, det_id (their order within the image), conf and
x1, y1, x2, y2. Everything is partitioned by image; pairs are filtered in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.functions.geometry import columns
from annolens.functions.overlap import iou, keypoint_similarity, overlaps

CORNERS = "x1 y1 x2 y2"


def named(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def pairs(gt: DataFrame, pred: DataFrame, same_class: bool = True) -> DataFrame:
    """Overlapping truth-prediction pairs of each image with their iou."""
    keys = ("image_id", "cls") if same_class else ("image_id",)
    g, p = named(gt, "g_", keys), named(pred, "p_", keys)
    a, b = columns("g_", CORNERS), columns("p_", CORNERS)
    joined = g.join(p, list(keys)).where(overlaps(a, b))
    return joined.withColumn("iou", iou(a, b))


def keypoint_pairs(gt: DataFrame, pred: DataFrame, sigmas: list[float], least: float, share: float = 0.53, keypoints: str = "keypoints") -> DataFrame:
    """Pairs of one image and class whose keypoints (arrays of x, y, v) are at least ``least`` alike, the likeness as their iou.

    The truth's box (w, h) times ``share`` is the area that distances are measured by.
    """
    keys = ("image_id", "cls")
    joined = named(gt, "g_", keys).join(named(pred, "p_", keys), list(keys))
    alike = keypoint_similarity(F.col(f"g_{keypoints}"), F.col(f"p_{keypoints}"), sigmas, F.col("g_w") * F.col("g_h") * share)
    return joined.withColumn("iou", F.round(alike, 9)).where(F.col("iou") >= least)


def _first(df: DataFrame, by: list, order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def match_validator(found: DataFrame, thresholds: list[float]) -> DataFrame:
    """Pairs matched at each threshold: each prediction keeps its best truth, then each truth its most confident prediction.

    ``found`` holds pairs of one class; predictions are ranked by confidence, then order.
    """
    rank = [F.desc("p_conf"), F.asc("p_det_id")]
    steps = found.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where("iou >= threshold")
    best = _first(steps, ["image_id", "threshold", "p_det_id"], [F.desc("iou"), F.desc("g_det_id")])
    return _first(best, ["image_id", "threshold", "g_det_id"], rank)


def match_marks(found: DataFrame, thresholds: list[float]) -> DataFrame:
    """The pairs of ``match_validator`` at any threshold, once each: image_id, cls, p_det_id, g_det_id, marks (bit i is set if the pair is matched at the i-th threshold).

    A prediction's best truth is the same at every threshold that it reaches; a truth goes to the
    first of its predictions that reaches the threshold, so to those beyond all before them.
    """
    if len(thresholds) > 63:
        raise ValueError("more than 63 thresholds")
    one = F.struct("iou", "g_det_id", "cls", "p_conf")
    best = found.where(F.col("iou") >= min(thresholds)).groupBy("image_id", "p_det_id").agg(F.max(one).alias("b")).select("image_id", "p_det_id", "b.*")
    ahead = Window.partitionBy("image_id", "g_det_id").orderBy(F.desc("p_conf"), F.asc("p_det_id")).rowsBetween(Window.unboundedPreceding, -1)
    before = best.withColumn("before", F.coalesce(F.max("iou").over(ahead), F.lit(float("-inf"))))
    bits = [F.when((F.col("before") < t) & (F.col("iou") >= t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(thresholds)]
    marked = before.select("image_id", "cls", "p_det_id", "g_det_id", sum(bits[1:], bits[0]).alias("marks"))
    return marked.where("marks <> 0")


def match_confusion(found: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Class-agnostic pairs above ``threshold``: each prediction keeps its best truth, then each truth its best prediction."""
    close = found.where(F.col("iou") > threshold)
    best = _first(close, ["image_id", "p_det_id"], [F.desc("iou"), F.asc("g_det_id")])
    return _first(best, ["image_id", "g_det_id"], [F.desc("iou"), F.asc("p_det_id")])


def _list(df: DataFrame, name: str) -> DataFrame:
    one = F.struct(F.col("det_id"), F.col("conf"), *columns("", CORNERS))
    return df.groupBy("image_id", "cls").agg(F.collect_list(one).alias(name))


def match_greedy(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per image and class: (image_id, cls, matched array of (p_det_id, g_det_id), n_pred, n_gt).

    Predictions in order of confidence each take the free truth of largest (iou, order); a pair
    below ``threshold`` takes nothing.
    """
    both = _list(gt, "gts").join(_list(pred, "preds"), ["image_id", "cls"], "full")
    empty = F.array().cast(both.schema["gts"].dataType)
    ordered = F.transform(F.sort_array(F.transform(F.coalesce("preds", empty), lambda p: F.struct((-p["conf"]).alias("k"), p["det_id"].alias("d"), p.alias("p")))), lambda x: x["p"])
    gts = F.coalesce("gts", empty)
    corners = lambda s: tuple(s[n] for n in CORNERS.split())

    def step(taken: Column, p: Column) -> Column:
        free = F.filter(F.col("gts_"), lambda g: ~F.exists(taken, lambda t: t["g"] == g["det_id"]))
        best = F.array_max(F.transform(free, lambda g: F.struct(iou(corners(p), corners(g)).alias("iou"), g["det_id"].alias("g"))))
        pair = F.struct(p["det_id"].alias("p"), best["g"].alias("g"))
        return F.when(best["iou"] >= threshold, F.concat(taken, F.array(pair))).otherwise(taken)

    start = F.array().cast(f"array<struct<p:{gt.schema['det_id'].dataType.simpleString()},g:{gt.schema['det_id'].dataType.simpleString()}>>")
    lists = both.select("image_id", "cls", gts.alias("gts_"), ordered.alias("preds_"))
    return lists.select("image_id", "cls", F.aggregate("preds_", start, step).alias("matched"), F.size("preds_").cast("long").alias("n_pred"), F.size("gts_").cast("long").alias("n_gt"))


def best_overlap(boxes: DataFrame, others: DataFrame, same_class: bool = False) -> DataFrame:
    """For every row of ``boxes`` (image_id, det_id): best_iou and best_id among the ``others`` that overlap it, ties to the largest id; 0 and -1 without any.

    Only overlapping pairs leave the join; rows without one come back by a left join.
    """
    keys = ["image_id", "cls"] if same_class else ["image_id"]
    o = named(others.select(*dict.fromkeys([*keys, "cls", "det_id", *CORNERS.split()])), "o_", tuple(keys))
    mine, theirs = columns("", CORNERS), columns("o_", CORNERS)
    near = boxes.select(*dict.fromkeys([*keys, "det_id", *CORNERS.split()])).join(o, keys).where(overlaps(mine, theirs))
    value = F.struct(iou(mine, theirs).alias("iou"), F.col("o_det_id").alias("id"), F.col("cls" if same_class else "o_cls").alias("cls"))
    best = near.groupBy("image_id", "det_id").agg(F.max(value).alias("best"))
    found = boxes.join(best, ["image_id", "det_id"], "left")
    return found.select(*boxes.columns, F.coalesce("best.iou", F.lit(0.0)).alias("best_iou"), F.coalesce("best.id", F.lit(-1)).alias("best_id"), F.col("best.cls").alias("best_cls"))


def cause(missed: bool, threshold: float = 0.5, partial: float = 0.1) -> Column:
    """Why a box has no partner, from best_iou, best_cls and cls of ``best_overlap``."""
    other = F.col("best_cls") != F.col("cls")
    return F.when((F.col("best_iou") >= threshold) & other, "class confusion").when(F.col("best_iou") >= partial, "localization").otherwise("missed" if missed else "background")


def top_candidates(anchors: DataFrame, gt: DataFrame, k: int, overlap: Column) -> DataFrame:
    """Anchors (image_id, anchor_id, ax, ay, score) inside each truth box, the ``k`` of largest score; an anchor of several boxes keeps the one of largest ``overlap``, then smallest id."""
    inside = (F.col("ax") > F.col("x1")) & (F.col("ax") < F.col("x2")) & (F.col("ay") > F.col("y1")) & (F.col("ay") < F.col("y2"))
    close = anchors.join(gt, "image_id").where(inside).withColumn("overlap", overlap)
    w = Window.partitionBy("image_id", "det_id").orderBy(F.desc("score"), "anchor_id")
    top = close.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
    return _first(top, ["image_id", "anchor_id"], [F.desc("overlap"), F.asc("det_id")])
