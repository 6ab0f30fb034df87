"""Overlap and distance measures as Column expressions; boxes are xyxy tuples unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolens.functions.geometry import Box, area, let

EPS = 1e-7


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlaps(a: Box, b: Box) -> Column:
    """Interval test to put before an exact measure in a join condition."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    inter = intersection(a, b)
    union = area(*a) + area(*b) - inter
    return inter / (union + eps) if eps else F.when(union > 0, inter / union).otherwise(0.0)


def ioa(a: Box, b: Box, eps: float = EPS) -> Column:
    """Share of b's area that a covers."""
    return intersection(a, b) / (area(*b) + eps)


def _hull(a: Box, b: Box) -> tuple[Column, Column]:
    return F.greatest(a[2], b[2]) - F.least(a[0], b[0]), F.greatest(a[3], b[3]) - F.least(a[1], b[1])


def giou(a: Box, b: Box, eps: float = EPS) -> Column:
    w, h = _hull(a, b)
    union = area(*a) + area(*b) - intersection(a, b) + eps
    hull = w * h + eps
    return intersection(a, b) / union - (hull - union) / hull


def diou(a: Box, b: Box, eps: float = EPS) -> Column:
    w, h = _hull(a, b)
    apart = (F.pow(b[0] + b[2] - a[0] - a[2], 2) + F.pow(b[1] + b[3] - a[1] - a[3], 2)) / 4
    return iou(a, b, eps) - apart / (w * w + h * h + eps)


def ciou(a: Box, b: Box, eps: float = EPS) -> Column:
    """DIoU less an aspect-ratio term."""
    turn = lambda box: F.atan((box[2] - box[0]) / (box[3] - box[1] + eps))
    v = 4 / (F.pi() * F.pi()) * F.pow(turn(b) - turn(a), 2)
    return diou(a, b, eps) - v * (v / (v - iou(a, b, eps) + (1 + eps)))


def _covariance(w: Column, h: Column, r: Column) -> tuple[Column, Column, Column]:
    a, b, cos, sin = w * w / 12, h * h / 12, F.cos(r), F.sin(r)
    return a * cos * cos + b * sin * sin, a * sin * sin + b * cos * cos, (a - b) * cos * sin


def prob_iou(a: tuple, b: tuple, eps: float = EPS) -> Column:
    """Similarity of two rotated boxes (x, y, w, h, angle) as Gaussians: one less their Hellinger distance."""
    a1, b1, c1 = _covariance(*a[2:])
    a2, b2, c2 = _covariance(*b[2:])
    dx, dy = a[0] - b[0], a[1] - b[1]
    sa, sb, sc = a1 + a2, b1 + b2, c1 + c2
    det = sa * sb - sc * sc
    t1 = (sa * dy * dy + sb * dx * dx) / (det + eps) * 0.25
    t2 = sc * (b[0] - a[0]) * dy / (det + eps) * 0.5
    own = lambda p, q, c: F.greatest(p * q - c * c, F.lit(0.0))
    t3 = F.ln(det / (4 * F.sqrt(own(a1, b1, c1) * own(a2, b2, c2)) + eps) + eps) * 0.5
    distance = F.least(F.greatest(t1 + t2 + t3, F.lit(eps)), F.lit(100.0))
    return 1 - F.sqrt(1 - F.exp(-distance) + eps)


def keypoint_similarity(truth: Column, found: Column, sigmas: list[float], box_area: Column, eps: float = EPS) -> Column:
    """Object keypoint similarity of two arrays of points (x, y, v): the mean over the truth's visible points."""
    n, total, visible = len(sigmas), F.lit(0.0), F.lit(0)
    for i, s in enumerate(sigmas):  # written out: lambdas over arrays are interpreted
        t, p = F.get(truth, F.lit(i)), F.get(found, F.lit(i))
        far = F.pow(t["x"] - p["x"], 2) + F.pow(t["y"] - p["y"], 2)
        total = total + F.when(t["v"] != 0, F.exp(-far / (F.lit((2 * s) ** 2) * (box_area + eps) * 2))).otherwise(0.0)
        visible = visible + F.when(t["v"] != 0, 1).otherwise(0)
    # null without a truth, or where it has a visible point that no sigma is given for
    more = F.when(F.size(truth) <= n, False).otherwise(F.exists(F.slice(truth, n + 1, F.greatest(F.size(truth) - n, F.lit(0))), lambda p: p["v"] != 0))
    return F.when(truth.isNotNull() & ~F.coalesce(more, F.lit(False)), total / (visible + eps))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mask_iou(a: Column, b: Column, eps: float = EPS) -> Column:
    """IoU of two masks given as arrays of 0 and 1."""
    inter, total = dot(a, b), lambda m: F.aggregate(m, F.lit(0.0), lambda s, x: s + x)
    return inter / (total(a) + total(b) - inter + eps)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return let(F.when(norm(v) > 0, norm(v)).otherwise(1.0), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def embedding_distance(a: Column, b: Column) -> Column:
    """Cosine distance, at least 0; 2 if either vector is missing."""
    return F.coalesce(F.greatest(1 - cosine(a, b), F.lit(0.0)), F.lit(2.0))


def fuse_score(cost: Column, score: Column) -> Column:
    return 1 - (1 - cost) * score


def fuse_appearance(iou_distance: Column, embedding: Column, proximity: float = 0.5, appearance: float = 0.8) -> Column:
    """The smaller of the IoU distance and half the embedding distance where both gates pass."""
    half = embedding / 2
    gated = F.when((half > 1 - appearance) | (iou_distance > proximity), 1.0).otherwise(half)
    return F.least(iou_distance, gated)


def height_iou(a: Box, b: Box, eps: float = EPS) -> Column:
    """IoU scaled by the overlap of the vertical extents."""
    shared = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return iou(a, b, eps) * shared / (F.greatest(a[3], b[3]) - F.least(a[1], b[1]) + eps)


def direction_cost(vy: Column, vx: Column, dy: Column, dx: Column) -> Column:
    """Angle between a unit velocity and a unit displacement over pi."""
    return F.acos(F.least(F.greatest(vy * dy + vx * dx, F.lit(-1.0)), F.lit(1.0))) / F.pi()
