"""Queries over boxes: geometry, overlap, matching, suppression, metrics, datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions import geometry as geo
from annolens.functions import overlap
from annolens.operators import datasets, matching, metrics, suppression
from annolens.plans import views
from annolens.plans.views import BOXES, MATCHED, PAIRS, registry

QUERIES, ORACLE_SQL, query = registry()
XYXY, XYWH = "x1 y1 x2 y2", "x y w h"
KEY = ["image_id", "det_id"]


def box(names: str = XYXY, prefix: str = "") -> tuple:
    return geo.columns(prefix, names)


# --- geometry


@query("SELECT image_id, det_id, x1, y1, x2, y2 FROM boxes", BOXES)
def box_xywh_to_xyxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.boxes(spark, sf_dir).select(*KEY, *datasets.box_columns(geo.xywh_to_xyxy(*box(XYWH))))


@query("SELECT image_id, det_id, x, y, w, h, x1 AS l, y1 AS t FROM boxes", BOXES)
def box_layouts(spark, sf_dir):
    """xyxy to xywh and ltwh."""
    b = views.boxes(spark, sf_dir)
    return b.select(*KEY, *datasets.box_columns(geo.xyxy_to_xywh(*box()), XYWH), *datasets.box_columns(geo.xyxy_to_ltwh(*box())[:2], "l t"))


@query("SELECT image_id, det_id, 640 * x1 + 16 AS x1, 480 * y1 + 8 AS y1, 640 * x2 + 16 AS x2, 480 * y2 + 8 AS y2 FROM boxes", BOXES)
def box_denormalize(spark, sf_dir):
    return views.boxes(spark, sf_dir).select(*KEY, *datasets.box_columns(geo.denormalize(*box(XYWH), 640, 480, 16, 8)))


@query(
    """SELECT image_id, det_id, (a + c) / 2 AS x, (b + d) / 2 AS y, c - a AS w, d - b AS h FROM (SELECT *, least(greatest(x1, 0), 1) AS a, least(greatest(y1, 0), 1) AS b,
    least(greatest(x2, 0), 1) AS c, least(greatest(y2, 0), 1) AS d FROM boxes)""",
    BOXES,
)
def box_normalize_clip(spark, sf_dir):
    return views.boxes(spark, sf_dir).select(*KEY, *datasets.box_columns(geo.normalize(*box(), 1.0, 1.0, clip=True), XYWH))


@query(
    """SELECT image_id, det_id, least(greatest(round((640 * x1 - 0) / 0.5, 6), 0), 1280) AS x1, least(greatest(round((640 * y1 - 80) / 0.5, 6), 0), 960) AS y1,
    least(greatest(round((640 * x2 - 0) / 0.5, 6), 0), 1280) AS x2, least(greatest(round((640 * y2 - 80) / 0.5, 6), 0), 960) AS y2 FROM boxes""",
    BOXES,
)
def box_letterbox_inverse(spark, sf_dir):
    scaled = [c * 640 for c in box()]
    out = geo.letterbox_inverse(*scaled, 640, 640, 960, 1280)
    return views.boxes(spark, sf_dir).select(*KEY, *[F.round(c, 6).alias(n) for c, n in zip(out, XYXY.split())])


@query(
    """SELECT image_id, det_id, round(x + w / 2 * cos(r) - h / 2 * sin(r), 6) AS ax, round(y + w / 2 * sin(r) + h / 2 * cos(r), 6) AS ay,
    round(x - w / 2 * cos(r) - (-h / 2 * sin(r)), 6) AS cx, round(y - w / 2 * sin(r) - h / 2 * cos(r), 6) AS cy FROM (SELECT *, conf * 2 AS r FROM boxes)""",
    BOXES,
)
def obb_to_corners(spark, sf_dir):
    c = views.boxes(spark, sf_dir).withColumn("c", geo.rotated_corners(*box(XYWH), F.col("conf") * 2))
    return c.select(*KEY, *[F.round(F.col("c")[i][n], 6).alias(f"{p}{n}") for i, p in ((0, "a"), (2, "c")) for n in "xy"])


@query(
    """SELECT image_id, det_id, CASE WHEN swap THEN h ELSE w END AS w, CASE WHEN swap THEN w ELSE h END AS h, round(r % (pi() / 2), 6) AS r
    FROM (SELECT *, r % pi() >= pi() / 2 AS swap FROM (SELECT *, conf * 6 AS r FROM boxes))""",
    BOXES,
)
def obb_regularize(spark, sf_dir):
    _, _, w, h, r = geo.regularize_rotated(*box(XYWH), F.col("conf") * 6)
    return views.boxes(spark, sf_dir).select(*KEY, w.alias("w"), h.alias("h"), F.round(r, 6).alias("r"))


@query("SELECT image_id, cls, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM boxes GROUP BY ALL", BOXES)
def polygon_enclosing_box(spark, sf_dir):
    """The boxes' centres of an image and class as one polygon."""
    p = views.boxes(spark, sf_dir).groupBy("image_id", "cls").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    return p.select("image_id", "cls", *datasets.box_columns(geo.enclosing_box(F.col("p"))))


_CORNER = "(SELECT *, {x} AS u1, {y} AS v1, {x2} AS u2, {y2} AS v2 FROM boxes)"


@query(
    """SELECT image_id, det_id, round((a + c) / 2, 6) AS x, round((b + d) / 2, 6) AS y, round(c - a, 6) AS w, round(d - b, 6) AS h FROM (
    SELECT image_id, det_id, least(u1, u2, u3, u4) AS a, least(v1, v2, v3, v4) AS b, greatest(u1, u2, u3, u4) AS c, greatest(v1, v2, v3, v4) AS d FROM (
    SELECT image_id, det_id, f(x1, y1) AS u1, f(x2, y1) AS u2, f(x2, y2) AS u3, f(x1, y2) AS u4, g(x1, y1) AS v1, g(x2, y1) AS v2, g(x2, y2) AS v3, g(x1, y2) AS v4 FROM boxes)) WHERE c - a > 0.001 AND d - b > 0.001""".replace(
        "f(x1, y1)", "least(greatest(0.6 * x1 - 0.8 * y1 + 0.6, 0), 1)"
    )
    .replace("f(x2, y1)", "least(greatest(0.6 * x2 - 0.8 * y1 + 0.6, 0), 1)")
    .replace("f(x2, y2)", "least(greatest(0.6 * x2 - 0.8 * y2 + 0.6, 0), 1)")
    .replace("f(x1, y2)", "least(greatest(0.6 * x1 - 0.8 * y2 + 0.6, 0), 1)")
    .replace("g(x1, y1)", "least(greatest(0.8 * x1 + 0.6 * y1 - 0.2, 0), 1)")
    .replace("g(x2, y1)", "least(greatest(0.8 * x2 + 0.6 * y1 - 0.2, 0), 1)")
    .replace("g(x2, y2)", "least(greatest(0.8 * x2 + 0.6 * y2 - 0.2, 0), 1)")
    .replace("g(x1, y2)", "least(greatest(0.8 * x1 + 0.6 * y2 - 0.2, 0), 1)"),
    BOXES,
)
def label_rotate(spark, sf_dir):
    """Labels rotated about the image centre by the angle whose cosine is 0.6."""
    b = geo.transform_box(*box(XYWH), 0.6, -0.8, 0.8, 0.6, 0.6, -0.2)
    # a generator keeps the filter from being written out in terms of the table's columns, which would be too long a method to be compiled
    out = views.boxes(spark, sf_dir).select(*KEY, *XYWH.split()).select(*KEY, F.inline(F.array(F.struct(*datasets.box_columns(b, XYWH)))))
    return out.where("w > 0.001 AND h > 0.001").select(*KEY, *[F.round(c, 6).alias(c) for c in XYWH.split()])


@query("SELECT image_id, det_id, 1 - x AS x, y, w, h FROM boxes", BOXES)
def label_flip(spark, sf_dir):
    return views.boxes(spark, sf_dir).select(*KEY, (1 - F.col("x")).alias("x"), "y", "w", "h")


@query("SELECT image_id, det_id, 0.5 * x + 0.25 AS x, 0.5 * y + 0.125 AS y, 0.5 * w AS w, 0.5 * h AS h FROM boxes", BOXES)
def label_affine(spark, sf_dir):
    b = geo.transform_box(*box(XYWH), 0.5, 0, 0, 0.5, 0.25, 0.125, clip=False)
    return views.boxes(spark, sf_dir).select(*KEY, *datasets.box_columns(b, XYWH))


@query("SELECT image_id, det_id FROM boxes WHERE w * 16 > 2 AND h * 8 > 2 AND w * 16 * h * 8 / (w * h * 256 + 1e-16) > 0.1 AND greatest(w * 16 / (h * 8 + 1e-16), h * 8 / (w * 16 + 1e-16)) < 4", BOXES)
def survivor_filter(spark, sf_dir):
    keep = geo.survives(F.col("w") * 16, F.col("h") * 16, F.col("w") * 16, F.col("h") * 8, ratio=4)
    return views.boxes(spark, sf_dir).where(keep).select(*KEY)


# --- overlap

_OTHER = """other AS (SELECT a.image_id, a.det_id AS a, b.det_id AS b, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
  a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh, a.conf AS ac, b.conf AS bc,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i
  FROM gt a JOIN pred b ON a.image_id = b.image_id AND a.cls = b.cls)"""


def _other(spark, sf_dir) -> DataFrame:
    g = matching.named(views.truth(spark, sf_dir), "g_", ("image_id", "cls"))
    p = matching.named(views.predictions(spark, sf_dir), "p_", ("image_id", "cls"))
    return g.join(p, ["image_id", "cls"]).withColumnsRenamed({"g_det_id": "a", "p_det_id": "b"})


def _measured(spark, sf_dir, **measures) -> DataFrame:
    a, b = box(prefix="g_"), box(prefix="p_")
    return _other(spark, sf_dir).select("image_id", "a", "b", *[F.round(of(a, b), 6).alias(n) for n, of in measures.items()])


@query("SELECT image_id, g_det_id AS a, p_det_id AS b, round(iou, 6) AS iou FROM pairs WHERE g_cls = p_cls", BOXES, PAIRS)
def iou_pairs(spark, sf_dir):
    found = matching.pairs(views.truth(spark, sf_dir), views.predictions(spark, sf_dir))
    return found.select("image_id", F.col("g_det_id").alias("a"), F.col("p_det_id").alias("b"), F.round("iou", 6).alias("iou"))


@query("SELECT image_id, a, b, round(i / (bw * bh + 1e-7), 6) AS ioa FROM other", BOXES, _OTHER)
def ioa_pairs(spark, sf_dir):
    return _measured(spark, sf_dir, ioa=overlap.ioa)


@query(
    """SELECT image_id, a, b, round(i / u - (hw * hh + 1e-7 - u) / (hw * hh + 1e-7), 6) AS giou, round(o - apart / (hw * hw + hh * hh + 1e-7), 6) AS diou,
    round(o - apart / (hw * hw + hh * hh + 1e-7) - v * (v / (v - o + (1 + 1e-7))), 6) AS ciou FROM (
    SELECT *, i / u AS o FROM (SELECT *, aw * ah + bw * bh - i + 1e-7 AS u, greatest(ax2, bx2) - least(ax1, bx1) AS hw, greatest(ay2, by2) - least(ay1, by1) AS hh,
    (pow(bx1 + bx2 - ax1 - ax2, 2) + pow(by1 + by2 - ay1 - ay2, 2)) / 4 AS apart, 4 / (pi() * pi()) * pow(atan(bw / (bh + 1e-7)) - atan(aw / (ah + 1e-7)), 2) AS v FROM other))""",
    BOXES,
    _OTHER,
)
def giou_diou_ciou(spark, sf_dir):
    return _measured(spark, sf_dir, giou=overlap.giou, diou=overlap.diou, ciou=overlap.ciou)


_COV = "{w} * {w} / 12 * cos({r}) * cos({r}) + {h} * {h} / 12 * sin({r}) * sin({r}) AS {n}1, {w} * {w} / 12 * sin({r}) * sin({r}) + {h} * {h} / 12 * cos({r}) * cos({r}) AS {n}2, ({w} * {w} / 12 - {h} * {h} / 12) * cos({r}) * sin({r}) AS {n}3"


@query(
    f"""SELECT image_id, a, b, round(1 - sqrt(1 - exp(-least(greatest(t1 + t2 + t3, 1e-7), 100)) + 1e-7), 5) AS prob_iou FROM (
    SELECT *, ((p1 + q1) * pow(ay - by_, 2) + (p2 + q2) * pow(ax - bx, 2)) / (det + 1e-7) * 0.25 AS t1, (p3 + q3) * (bx - ax) * (ay - by_) / (det + 1e-7) * 0.5 AS t2,
    ln(det / (4 * sqrt(greatest(p1 * p2 - p3 * p3, 0) * greatest(q1 * q2 - q3 * q3, 0)) + 1e-7) + 1e-7) * 0.5 AS t3 FROM (
    SELECT *, (p1 + q1) * (p2 + q2) - (p3 + q3) * (p3 + q3) AS det FROM (SELECT *, {_COV.format(w="aw", h="ah", r="ac", n="p")}, {_COV.format(w="bw", h="bh", r="bc", n="q")} FROM other)))""",
    BOXES,
    _OTHER,
)
def probiou_pairs(spark, sf_dir):
    a, b = box("x y w h conf", "g_"), box("x y w h conf", "p_")
    return _other(spark, sf_dir).select("image_id", "a", "b", F.round(overlap.prob_iou(a, b), 5).alias("prob_iou"))


@query(
    """SELECT image_id, a, b, round((exp(-(pow(ax1 - bx1, 2) + pow(ay1 - by1, 2)) / (0.04 * (aw * ah * 0.53 + 1e-7) * 2)) + exp(-(pow(ax2 - bx2, 2) + pow(ay2 - by2, 2)) / (0.16 * (aw * ah * 0.53 + 1e-7) * 2))) / (2 + 1e-7), 6) AS oks FROM other""",
    BOXES,
    _OTHER,
)
def oks_pairs(spark, sf_dir):
    """The two corners as keypoints."""
    points = lambda p: F.array(*[F.struct(F.col(f"{p}x{i}").alias("x"), F.col(f"{p}y{i}").alias("y"), F.lit(1).alias("v")) for i in (1, 2)])
    return _measured(spark, sf_dir, oks=lambda a, b: overlap.keypoint_similarity(points("g_"), points("p_"), [0.1, 0.2], F.col("g_w") * F.col("g_h") * 0.53))


# --- filters

_THR = "thr AS (SELECT * FROM (VALUES (0, 0.30), (1, 0.15), (2, 0.30), (3, 0.25)) t(cls, least))"
#: Least confidence of each class (fixed values).
CLASS_THRESHOLDS = {0: 0.30, 1: 0.15, 2: 0.30, 3: 0.25}


@query("SELECT image_id, det_id, p.cls, conf FROM pred p JOIN thr ON p.cls = thr.cls WHERE conf >= least", BOXES, _THR)
def per_class_threshold(spark, sf_dir):
    least = spark.createDataFrame(list(CLASS_THRESHOLDS.items()), "cls int, least double")
    return views.predictions(spark, sf_dir).join(F.broadcast(least), "cls").where("conf >= least").select(*KEY, "cls", "conf")


@query("SELECT image_id, det_id, 0 AS cls, x, y, w, h FROM boxes WHERE is_gt", BOXES)
def binary_collapse(spark, sf_dir):
    return views.truth(spark, sf_dir).select(*KEY, F.lit(0).alias("cls"), "x", "y", "w", "h")


@query("SELECT image_id, det_id, cls FROM gt WHERE cls IN (0, 2)", BOXES)
def class_filter(spark, sf_dir):
    return views.truth(spark, sf_dir).where(F.col("cls").isin(0, 2)).select(*KEY, "cls")


@query("SELECT image_id, det_id, CASE cls WHEN 0 THEN 7 WHEN 1 THEN 11 WHEN 2 THEN 255 ELSE 255 END AS cls FROM gt", BOXES)
def class_remap(spark, sf_dir):
    mapping = F.create_map(F.lit(0), F.lit(7), F.lit(1), F.lit(11))
    return views.truth(spark, sf_dir).select(*KEY, F.coalesce(mapping[F.col("cls")], F.lit(255)).alias("cls"))


@query("SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM gt WHERE cls = 1)", BOXES)
def background_images(spark, sf_dir):
    """Images without a label of class 1."""
    return views.images(spark, sf_dir).join(views.truth(spark, sf_dir).where("cls = 1"), "image_id", "left_anti")


@query("SELECT image_id FROM gt GROUP BY image_id HAVING bool_or(cls = 1) AND NOT bool_or(cls IN (3))", BOXES)
def minority_images(spark, sf_dir):
    return datasets.minority_images(views.truth(spark, sf_dir), 1, [3])


@query("SELECT image_id, det_id, CAST(v.range AS INTEGER) AS variant FROM gt, range(1, 4) v WHERE image_id IN (SELECT image_id FROM gt GROUP BY image_id HAVING bool_or(cls = 1) AND NOT bool_or(cls = 3))", BOXES)
def oversample_minority(spark, sf_dir):
    labels = views.truth(spark, sf_dir)
    return datasets.oversample(labels, datasets.minority_images(labels, 1, [3]), 3).select(*KEY, "variant")


@query(
    """SELECT image_id, least(5, greatest(1, CAST(round_even(top / n, 0) AS BIGINT))) AS repeats FROM (SELECT image_id, min(n) AS n FROM (SELECT DISTINCT image_id, cls FROM gt) JOIN tot USING (cls) GROUP BY image_id), (SELECT max(n) AS top FROM tot)""",
    BOXES,
    "tot AS (SELECT cls, count(*) AS n FROM gt GROUP BY cls)",
)
def repetition_plan(spark, sf_dir):
    return datasets.repetition_plan(views.truth(spark, sf_dir), 5)


# --- tiles

_TILES = """tiles AS (SELECT image_id, det_id, cls, tile, a, b, c, d, tx, ty FROM (SELECT *, greatest(x1, tx) AS a, greatest(y1, ty) AS b, least(x2, tx + 0.5) AS c, least(y2, ty + 0.5) AS d FROM (
  SELECT *, (tile % 2) * 0.5 AS tx, (tile // 2) * 0.5 AS ty FROM gt, (SELECT CAST(range AS INTEGER) AS tile FROM range(4)))) WHERE c - a >= 0.0625 AND d - b >= 0.0625 AND (c - a) * (d - b) / (w * h) >= 0.2)"""


@query("SELECT image_id, det_id, tile, ((a + c) / 2 - tx) / 0.5 AS x, ((b + d) / 2 - ty) / 0.5 AS y, (c - a) / 0.5 AS w, (d - b) / 0.5 AS h FROM tiles", BOXES, _TILES)
def tile_clip(spark, sf_dir):
    return datasets.grid_tiles(views.truth(spark, sf_dir), 2, min_pixels=0.0625).select(*KEY, "tile", "x", "y", "w", "h")


@query("SELECT tile, cls, count(*) AS objects, count(DISTINCT image_id) AS tiles FROM tiles GROUP BY ALL", BOXES, _TILES)
def tile_stats(spark, sf_dir):
    return datasets.grid_tiles(views.truth(spark, sf_dir), 2, min_pixels=0.0625).groupBy("tile", "cls").agg(F.count("*").alias("objects"), F.countDistinct("image_id").alias("tiles"))


@query(
    """SELECT image_id, x1, y1, x1 + 64 AS x2, y1 + 64 AS y2, ratio FROM (SELECT *, max(ratio) OVER (PARTITION BY image_id) AS top FROM (
    SELECT *, (least(x1 + 64, width) - x1) * (least(y1 + 64, height) - y1) / 4096.0::DOUBLE AS ratio FROM (
    SELECT DISTINCT image_id, width, height, CASE WHEN width > 64 AND i * 48 + 64 > width THEN width - 64 ELSE i * 48 END AS x1, CASE WHEN height > 64 AND j * 48 + 64 > height THEN height - 64 ELSE j * 48 END AS y1
    FROM shapes, (SELECT range AS i FROM range(10)), (SELECT range AS j FROM range(10)) WHERE i <= CASE WHEN width <= 64 THEN 0 ELSE ceil((width - 64) / 48) END AND j <= CASE WHEN height <= 64 THEN 0 ELSE ceil((height - 64) / 48) END)))
    WHERE ratio > 0.6 OR (top <= 0.6 AND ratio > top - 0.01)""",
    BOXES,
    "shapes AS (SELECT image_id, 32 + image_id % 200 AS width, 40 + image_id % 120 AS height FROM images)",
)
def window_grid(spark, sf_dir):
    shapes = views.images(spark, sf_dir).select("image_id", (32 + F.col("image_id") % 200).alias("width"), (40 + F.col("image_id") % 120).alias("height"))
    return datasets.window_grid(shapes, 64, 16)


# --- matching


def _matched(spark, sf_dir, thresholds) -> DataFrame:
    return matching.match_validator(matching.pairs(views.truth(spark, sf_dir), views.predictions(spark, sf_dir)), thresholds)


_STEPS10 = "steps AS (SELECT (50 + 5 * range) / 100.0::DOUBLE AS t FROM range(10))"
_STEP = "steps AS (SELECT 0.5::DOUBLE AS t)"


@query("SELECT image_id, t AS threshold, g_det_id, p_det_id, iou FROM matched", BOXES, PAIRS, _STEPS10, MATCHED)
def match_validator(spark, sf_dir):
    return _matched(spark, sf_dir, metrics.STEPS).select("image_id", "threshold", "g_det_id", "p_det_id", "iou")


_PRF = "tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1"
_COUNTS = """counts AS (SELECT c.cls, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn FROM classes c
  LEFT JOIN (SELECT g_cls AS cls, count(*) AS tp FROM matched GROUP BY 1) USING (cls) LEFT JOIN (SELECT cls, count(*) AS np FROM pred GROUP BY 1) USING (cls) LEFT JOIN (SELECT cls, count(*) AS ng FROM gt GROUP BY 1) USING (cls))"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


_PRF9 = "tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9)::DOUBLE AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9)::DOUBLE AS f1"


@query(
    f"SELECT cls, {_PRF9} FROM (SELECT cls, tp, fp, fn FROM counts UNION ALL SELECT -1, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM counts)",
    BOXES,
    PAIRS,
    _STEP,
    MATCHED,
    _COUNTS,
)
def match_metrics(spark, sf_dir):
    """Per class and overall: tp, fp, fn, precision, recall, f1 at IoU 0.5 (the flagship query)."""
    gt, pred = views.truth(spark, sf_dir), views.predictions(spark, sf_dir)
    hits = _matched(spark, sf_dir, [0.5]).select("cls")
    counts = metrics.class_counts(gt, pred, hits, views.classes(spark))
    return _rounded(metrics.prf(metrics.with_total(counts)), "precision", "recall", "f1")


_CONF = """cpred AS (SELECT * FROM pred WHERE conf > 0.25), c1 AS (SELECT * FROM pairs WHERE iou > 0.45 AND p_conf > 0.25 QUALIFY row_number() OVER (PARTITION BY image_id, p_det_id ORDER BY iou DESC, g_det_id) = 1),
hit AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY image_id, g_det_id ORDER BY iou DESC, p_det_id) = 1)"""


def _confusion_hits(spark, sf_dir) -> DataFrame:
    return matching.match_confusion(matching.pairs(views.truth(spark, sf_dir), _confident(spark, sf_dir), same_class=False))


def _confident(spark, sf_dir) -> DataFrame:
    return metrics.confident(views.predictions(spark, sf_dir))


@query("SELECT image_id, g_det_id, p_det_id, iou FROM hit", BOXES, PAIRS, _CONF)
def match_confusion(spark, sf_dir):
    return _confusion_hits(spark, sf_dir).select("image_id", "g_det_id", "p_det_id", "iou")


_MATRIX = """matrix AS (SELECT pred_cls, gt_cls, count(*) AS n FROM (SELECT p_cls AS pred_cls, g_cls AS gt_cls FROM hit
  UNION ALL SELECT 4, cls FROM gt WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.image_id = gt.image_id AND hit.g_det_id = gt.det_id)
  UNION ALL SELECT cls, 4 FROM cpred WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.image_id = cpred.image_id AND hit.p_det_id = cpred.det_id)) GROUP BY ALL)"""


def _matrix(spark, sf_dir) -> DataFrame:
    return metrics.confusion_matrix(views.truth(spark, sf_dir), _confident(spark, sf_dir), _confusion_hits(spark, sf_dir), views.N_CLASSES)


@query("SELECT * FROM matrix", BOXES, PAIRS, _CONF, _MATRIX)
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("SELECT *, round(n / (sum(n) OVER (PARTITION BY gt_cls) + 1e-9), 9) AS share FROM matrix", BOXES, PAIRS, _CONF, _MATRIX)
def confusion_normalized(spark, sf_dir):
    return _rounded(metrics.normalize_columns(_matrix(spark, sf_dir)), "share")


@query("SELECT pred_cls AS cls, coalesce(sum(n) FILTER (pred_cls = gt_cls), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (pred_cls <> gt_cls), 0)::BIGINT AS fp FROM matrix WHERE pred_cls < 4 GROUP BY 1", BOXES, PAIRS, _CONF, _MATRIX)
def tp_fp_per_class(spark, sf_dir):
    return metrics.matrix_tp_fp(_matrix(spark, sf_dir), views.N_CLASSES)


_GREEDY = """p AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det_id) AS k FROM pred),
gs AS (SELECT image_id, cls, list({'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) AS gts FROM gt GROUP BY ALL),
grp AS (SELECT image_id, cls, max(k) AS n FROM p GROUP BY ALL),
walk AS (SELECT image_id, cls, n, 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS who FROM grp
  UNION ALL SELECT image_id, cls, n, k, CASE WHEN best.iou >= 0.5 THEN list_append(used, best.id) ELSE used END, CASE WHEN best.iou >= 0.5 THEN list_append(who, det_id) ELSE who END FROM (
    SELECT w.image_id, w.cls, w.n, p.k, p.det_id, used, who, list_max([{'iou': (greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0)) /
      ((g.x2 - g.x1) * (g.y2 - g.y1) + p.w * p.h - greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0)), 'id': g.id} FOR g IN gts IF NOT list_contains(used, g.id)]) AS best
    FROM walk w JOIN p ON p.image_id = w.image_id AND p.cls = w.cls AND p.k = w.k + 1 LEFT JOIN gs ON gs.image_id = w.image_id AND gs.cls = w.cls)),
greedy AS (SELECT image_id, cls, used, who FROM walk WHERE k = n)"""


def _greedy(spark, sf_dir) -> DataFrame:
    return matching.match_greedy(views.truth(spark, sf_dir), views.predictions(spark, sf_dir))


@query(f"SELECT image_id, cls, unnest(who) AS p_det_id, unnest(used) AS g_det_id FROM greedy", "RECURSIVE " + BOXES, _GREEDY)
def match_greedy(spark, sf_dir):
    m = _greedy(spark, sf_dir).select("image_id", "cls", F.explode("matched").alias("m"))
    return m.select("image_id", "cls", F.col("m.p").cast("long").alias("p_det_id"), F.col("m.g").cast("long").alias("g_det_id"))


_BEST = """gb AS (SELECT g.image_id, g.det_id, g.cls, coalesce(max(iou), 0)::DOUBLE AS best_iou, max_by({'i': iou, 'd': p_det_id, 'c': p_cls}, {'i': iou, 'd': p_det_id}) AS b FROM gt g LEFT JOIN pairs p ON p.image_id = g.image_id AND p.g_det_id = g.det_id GROUP BY ALL)"""


@query("SELECT image_id, det_id, best_iou FROM gb", BOXES, PAIRS, _BEST)
def best_overlap(spark, sf_dir):
    gt = views.truth(spark, sf_dir).select(*KEY, "cls", *XYXY.split())
    return matching.best_overlap(gt, views.predictions(spark, sf_dir)).select(*KEY, "best_iou")


@query(
    """SELECT g.image_id, g.det_id, g.cls, coalesce(n_all, 0) AS predictions, coalesce(n_same, 0) AS same_class, coalesce(any_iou, 0)::DOUBLE AS best_any, coalesce(same_iou, 0)::DOUBLE AS best_same FROM gt g
    LEFT JOIN (SELECT image_id, count(*) AS n_all FROM pred GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, cls, count(*) AS n_same FROM pred GROUP BY ALL) USING (image_id, cls)
    LEFT JOIN (SELECT image_id, g_det_id AS det_id, max(iou) AS any_iou, max(iou) FILTER (g_cls = p_cls) AS same_iou FROM pairs GROUP BY ALL) USING (image_id, det_id)""",
    BOXES,
    PAIRS,
)
def matching_diagnostics(spark, sf_dir):
    gt, pred = views.truth(spark, sf_dir).select(*KEY, "cls", *XYXY.split()), views.predictions(spark, sf_dir)
    near = matching.pairs(gt, pred, same_class=False)
    same = F.when(F.col("g_cls") == F.col("p_cls"), F.col("iou"))
    best = near.groupBy("image_id", F.col("g_det_id").alias("det_id")).agg(F.max("iou").alias("best_any"), F.max(same).alias("best_same"))
    n_all = pred.groupBy("image_id").agg(F.count("*").alias("predictions"))
    n_same = pred.groupBy("image_id", "cls").agg(F.count("*").alias("same_class"))
    out = gt.join(n_all, "image_id", "left").join(n_same, ["image_id", "cls"], "left").join(best, KEY, "left")
    return out.na.fill(0, ["predictions", "same_class"]).na.fill(0.0, ["best_any", "best_same"]).select(*KEY, "cls", "predictions", "same_class", "best_any", "best_same")


_LEFT = """g0 AS (SELECT * FROM gt WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = gt.image_id AND m.g_det_id = gt.det_id)),
p0 AS (SELECT * FROM pred WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = pred.image_id AND m.p_det_id = pred.det_id))"""


@query(
    """SELECT cause, cls, count(*) AS n FROM (SELECT cls, CASE WHEN b.i >= 0.5 AND b.c <> cls THEN 'class confusion' WHEN coalesce(b.i, 0) >= 0.1 THEN 'localization' ELSE 'missed' END AS cause FROM (
    SELECT g.image_id, g.det_id, g.cls, max({'i': iou, 'd': p_det_id, 'c': p_cls}) FILTER (iou IS NOT NULL) AS b FROM g0 g LEFT JOIN pairs p ON p.image_id = g.image_id AND p.g_det_id = g.det_id GROUP BY ALL)) GROUP BY ALL""",
    BOXES,
    PAIRS,
    _STEP,
    MATCHED,
    _LEFT,
)
def fn_causes(spark, sf_dir):
    used = _matched(spark, sf_dir, [0.5]).select("image_id", F.col("g_det_id").alias("det_id"))
    missed = views.truth(spark, sf_dir).join(used, KEY, "left_anti").select(*KEY, "cls", *XYXY.split())
    best = matching.best_overlap(missed, views.predictions(spark, sf_dir))
    return best.groupBy(matching.cause(missed=True).alias("cause"), "cls").agg(F.count("*").alias("n"))


@query(
    """SELECT cause, cls, count(*) AS n FROM (SELECT cls, CASE WHEN b.i >= 0.5 AND b.c <> cls THEN 'class confusion' WHEN coalesce(b.i, 0) >= 0.1 THEN 'localization' ELSE 'background' END AS cause FROM (
    SELECT g.image_id, g.det_id, g.cls, max({'i': iou, 'd': g_det_id, 'c': g_cls}) FILTER (iou IS NOT NULL) AS b FROM p0 g LEFT JOIN pairs p ON p.image_id = g.image_id AND p.p_det_id = g.det_id GROUP BY ALL)) GROUP BY ALL""",
    BOXES,
    PAIRS,
    _STEP,
    MATCHED,
    _LEFT,
)
def fp_causes(spark, sf_dir):
    used = _matched(spark, sf_dir, [0.5]).select("image_id", F.col("p_det_id").alias("det_id"))
    extra = views.predictions(spark, sf_dir).join(used, KEY, "left_anti").select(*KEY, "cls", *XYXY.split())
    best = matching.best_overlap(extra, views.truth(spark, sf_dir))
    return best.groupBy(matching.cause(missed=False).alias("cause"), "cls").agg(F.count("*").alias("n"))


# --- sweeps

SWEEP = [0.1, 0.25, 0.5, 0.75]
_SWEEP = """runs AS (SELECT unnest([0.1, 0.25, 0.5, 0.75])::DOUBLE AS threshold),
sp AS (SELECT pairs.*, threshold AS t FROM pairs JOIN runs ON p_conf >= threshold WHERE iou >= 0.5 AND g_cls = p_cls),
best AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY image_id, t, p_det_id ORDER BY iou DESC, g_det_id DESC) = 1),
matched AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY image_id, t, g_det_id ORDER BY p_conf DESC, p_det_id) = 1),
sweep AS (SELECT threshold, c.cls, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn FROM runs CROSS JOIN classes c
  LEFT JOIN (SELECT t AS threshold, g_cls AS cls, count(*) AS tp FROM matched GROUP BY ALL) USING (threshold, cls)
  LEFT JOIN (SELECT threshold, cls, count(*) AS np FROM pred JOIN runs ON conf >= threshold GROUP BY ALL) USING (threshold, cls) LEFT JOIN (SELECT cls, count(*) AS ng FROM gt GROUP BY ALL) USING (cls))"""


def _sweep(spark, sf_dir) -> DataFrame:
    """Counts per threshold and class. Pairs are found once; each threshold matches those its predictions are in."""
    runs = F.explode(F.array(*[F.lit(t) for t in SWEEP]))
    gt, pred = views.truth(spark, sf_dir), views.predictions(spark, sf_dir)
    found = matching.pairs(gt, pred).where("iou >= 0.5").withColumn("threshold", runs).where("p_conf >= threshold")
    best = suppression.first_of(found, ["image_id", "threshold", "p_det_id"], [F.desc("iou"), F.desc("g_det_id")])
    hits = suppression.first_of(best, ["image_id", "threshold", "g_det_id"], [F.desc("p_conf"), F.asc("p_det_id")])
    every = views.classes(spark).withColumn("threshold", runs)
    counted = pred.withColumn("threshold", runs).where("conf >= threshold")
    return metrics.class_counts(gt.withColumn("threshold", runs), counted, hits, every, ["threshold"])


@query(f"SELECT threshold, cls, {_PRF9} FROM sweep", BOXES, PAIRS, _SWEEP)
def threshold_sweep_per_class(spark, sf_dir):
    return _rounded(metrics.prf(_sweep(spark, sf_dir)), "precision", "recall", "f1")


@query(f"SELECT threshold, {_PRF9} FROM (SELECT threshold, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM sweep GROUP BY 1)", BOXES, PAIRS, _SWEEP)
def threshold_sweep(spark, sf_dir):
    total = metrics.with_total(_sweep(spark, sf_dir), ["threshold"]).where("cls = -1").drop("cls")
    return _rounded(metrics.prf(total), "precision", "recall", "f1")


@query(f"SELECT cls, threshold, f1 FROM (SELECT cls, threshold, {_PRF9} FROM sweep) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, threshold) = 1", BOXES, PAIRS, _SWEEP)
def best_threshold(spark, sf_dir):
    return metrics.best_by_f1(_rounded(metrics.prf(_sweep(spark, sf_dir)), "f1"), ["cls"])


# --- precision and recall curves

_CURVE = """curve AS (SELECT cls, t, conf, k, tpc, tpc / (n + 1e-16) AS recall, tpc / k::DOUBLE AS precision FROM (
  SELECT p.cls, s.t, p.conf, sum(CASE WHEN m.p_det_id IS NULL THEN 0 ELSE 1 END) OVER w AS tpc, row_number() OVER w AS k
  FROM pred p CROSS JOIN steps s LEFT JOIN matched m ON m.image_id = p.image_id AND m.t = s.t AND m.p_det_id = p.det_id
  WINDOW w AS (PARTITION BY p.cls, s.t ORDER BY p.conf DESC, p.image_id, p.det_id ROWS UNBOUNDED PRECEDING)) JOIN (SELECT cls, count(*) AS n FROM gt GROUP BY 1) USING (cls))"""
#: Sentinels, envelope, then for each grid point the last point at or before it and its successor.
_AP = """pts AS (SELECT cls, t, k, recall AS r, precision AS p FROM curve UNION ALL SELECT DISTINCT cls, t, 0, 0.0, 1.0 FROM curve
  UNION ALL SELECT cls, t, max(k) + 1, max(recall), 0.0 FROM curve GROUP BY ALL UNION ALL SELECT cls, t, max(k) + 2, 1.0, 0.0 FROM curve GROUP BY ALL),
env AS (SELECT *, max(p) OVER (PARTITION BY cls, t ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM pts),
nxt AS (SELECT *, lead(r) OVER (PARTITION BY cls, t ORDER BY k) AS r2, lead(e) OVER (PARTITION BY cls, t ORDER BY k) AS e2 FROM env),
lastp AS (SELECT * FROM nxt WHERE r2 IS NULL OR r2 > r),
grid AS (SELECT range AS g FROM range(101)),
val AS (SELECT cls, t, g, CASE WHEN r2 IS NULL THEN e ELSE e + (e2 - e) * (g / 100.0::DOUBLE - r) / (r2 - r) END AS y FROM lastp ASOF_GRID),
ap AS (SELECT c.cls, s.t, coalesce(sum(y * CASE WHEN g IN (0, 100) THEN 0.005 ELSE 0.01 END), 0)::DOUBLE AS ap FROM (SELECT DISTINCT cls FROM gt) c CROSS JOIN steps s LEFT JOIN val ON val.cls = c.cls AND val.t = s.t GROUP BY ALL)""".replace(
    "lastp ASOF_GRID", "lastp, grid WHERE round(r, 11) <= g / 100.0::DOUBLE AND (r2 IS NULL OR g / 100.0::DOUBLE < round(r2, 11))"
)


def _curve(spark, sf_dir, thresholds) -> tuple[DataFrame, DataFrame]:
    gt, pred = views.truth(spark, sf_dir), views.predictions(spark, sf_dir)
    n_gt = gt.groupBy("cls").agg(F.count("*").alias("n"))
    matched = matching.match_validator(matching.pairs(gt, pred), thresholds)
    return metrics.ranked(pred, matched, n_gt, thresholds), n_gt


def _ap(spark, sf_dir) -> DataFrame:
    gt, pred = views.truth(spark, sf_dir), views.predictions(spark, sf_dir)
    n_gt = gt.groupBy("cls").agg(F.count("*").alias("n"))
    return metrics.average_precision_of(pred, matching.match_marks(matching.pairs(gt, pred), metrics.STEPS), n_gt, metrics.STEPS)


@query("SELECT cls, t AS threshold, round(ap, 6) AS ap FROM ap", BOXES, PAIRS, _STEPS10, MATCHED, _CURVE, _AP)
def average_precision(spark, sf_dir):
    return _six(_ap(spark, sf_dir), "ap")


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("SELECT round(avg(ap) FILTER (t = 0.5), 6) AS map50, round(avg(ap) FILTER (t = 0.75), 6) AS map75, round(avg(ap), 6) AS map50_95 FROM ap", BOXES, PAIRS, _STEPS10, MATCHED, _CURVE, _AP)
def map_summary(spark, sf_dir):
    return _six(metrics.mean_ap(_ap(spark, sf_dir)), "map50", "map75", "map50_95")


@query("SELECT cls, k, conf, round(recall, 9) AS recall, round(precision, 9) AS precision FROM curve", BOXES, PAIRS, _STEP, MATCHED, _CURVE)
def pr_curve(spark, sf_dir):
    curve, _ = _curve(spark, sf_dir, [0.5])
    return _rounded(curve.select("cls", "k", "conf", "recall", "precision"), "recall", "precision")


#: The mean F1 curve on 1,000 confidences, then smoothed over 101 of them.
_F1 = """own AS (SELECT cls, conf, arg_max(recall, k) AS r_hi, arg_max(precision, k) AS p_hi, arg_min(recall, k) AS r_lo, arg_min(precision, k) AS p_lo FROM curve GROUP BY ALL),
nx AS (SELECT *, lead(conf) OVER w AS c2, lead(r_hi) OVER w AS r2, lead(p_hi) OVER w AS p2, row_number() OVER w = 1 AS lowest FROM own WINDOW w AS (PARTITION BY cls ORDER BY conf)),
gr AS (SELECT CAST(range AS INTEGER) AS g, range / 999.0::DOUBLE AS x FROM range(1000)),
sc AS (SELECT cls, g, CASE WHEN x <= conf OR c2 IS NULL THEN r_lo ELSE r_lo + (r2 - r_lo) * (x - conf) / (c2 - conf) END AS r, CASE WHEN x <= conf OR c2 IS NULL THEN p_lo ELSE p_lo + (p2 - p_lo) * (x - conf) / (c2 - conf) END AS p
  FROM nx, gr WHERE (lowest OR round(conf * 999, 9) <= g) AND CASE WHEN c2 IS NULL THEN g <= round(conf * 999, 9) ELSE g < round(c2 * 999, 9) END),
pts AS (SELECT gr.g, coalesce(f, 0) AS f1 FROM gr LEFT JOIN (SELECT g, sum(2 * p * r / (p + r + 1e-16)) / 4 AS f FROM sc GROUP BY g) USING (g)),
sm AS (SELECT a.g, round(sum(b.f1) / 101, 12) AS f FROM gr a, range(-50, 51) o, pts b WHERE b.g = least(greatest(a.g + o.range, 0), 999) GROUP BY a.g)"""


@query("SELECT round(g / 999.0::DOUBLE, 9) AS conf, round(f, 9) AS f1 FROM sm ORDER BY f DESC, g LIMIT 1", BOXES, PAIRS, _STEP, MATCHED, _CURVE, _F1)
def f1_operating_point(spark, sf_dir):
    """The feature is one row: the confidence of the best smoothed mean F1."""
    curve, _ = _curve(spark, sf_dir, [0.5])
    return _rounded(metrics.f1_operating_point(curve, views.N_CLASSES), "conf", "f1")


@query(
    "SELECT round(b.g / 999.0::DOUBLE, 9) AS conf, round(coalesce(sum(p), 0) / 4, 6) AS precision, round(coalesce(sum(r), 0) / 4, 6) AS recall FROM (SELECT g FROM sm ORDER BY f DESC, g LIMIT 1) b LEFT JOIN sc USING (g) GROUP BY b.g",
    BOXES,
    PAIRS,
    _STEP,
    MATCHED,
    _CURVE,
    _F1,
)
def mean_precision_recall(spark, sf_dir):
    """The feature is one row: mean precision and recall over classes at the best smoothed mean F1."""
    curve, _ = _curve(spark, sf_dir, [0.5])
    return _six(_rounded(metrics.mean_rates(curve, views.N_CLASSES), "conf"), "precision", "recall")


@query(
    """SELECT image_id, tp, fp, fn, CASE WHEN e THEN 1.0 ELSE round(coalesce(tp / nullif(tp + fp, 0), 0), 9) END::DOUBLE AS precision, CASE WHEN e THEN 1.0 ELSE round(coalesce(tp / nullif(tp + fn, 0), 0), 9) END::DOUBLE AS recall,
    CASE WHEN e THEN 1.0 ELSE round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) END::DOUBLE AS f1 FROM (
    SELECT image_id, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn, np IS NULL AND ng IS NULL AS e FROM images
    LEFT JOIN (SELECT image_id, count(*) AS tp FROM matched GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS np FROM pred GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS ng FROM gt GROUP BY 1) USING (image_id))""",
    BOXES,
    PAIRS,
    _STEP,
    MATCHED,
)
def image_metrics(spark, sf_dir):
    hits = _matched(spark, sf_dir, [0.5])
    out = metrics.image_metrics(views.images(spark, sf_dir), views.truth(spark, sf_dir), views.predictions(spark, sf_dir), hits)
    return _rounded(out, "precision", "recall", "f1")


# --- suppression

_FAST = "NOT EXISTS (SELECT 1 FROM pred b WHERE b.image_id = a.image_id {same} AND (b.conf > a.conf OR (b.conf = a.conf AND b.det_id < a.det_id)) AND b.x1 < a.x2 AND a.x1 < b.x2 AND b.y1 < a.y2 AND a.y1 < b.y2 AND {i} / (a.w * a.h + b.w * b.h - {i}) >= 0.5)"
_I = "((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))"


@query(f"SELECT image_id, det_id FROM pred a WHERE {_FAST.format(same='', i=_I)}", BOXES)
def nms_fast(spark, sf_dir):
    return suppression.suppress_fast(views.predictions(spark, sf_dir), 0.5).select(*KEY)


_NMS = """p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY conf DESC, det_id) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM pred),
walk AS (SELECT image_id, {cls} AS g, k, n, [{{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM p WHERE k = 1
  UNION ALL SELECT w.image_id, w.g, p.k, w.n, CASE WHEN len([1 FOR b IN kept IF (greatest(least(b.x2, p.x2) - greatest(b.x1, p.x1), 0) * greatest(least(b.y2, p.y2) - greatest(b.y1, p.y1), 0)) /
    ((b.x2 - b.x1) * (b.y2 - b.y1) + p.w * p.h - greatest(least(b.x2, p.x2) - greatest(b.x1, p.x1), 0) * greatest(least(b.y2, p.y2) - greatest(b.y1, p.y1), 0)) > 0.5]) > 0 THEN kept
    ELSE list_append(kept, {{'id': p.det_id, 'x1': p.x1, 'y1': p.y1, 'x2': p.x2, 'y2': p.y2}}) END
  FROM walk w JOIN p ON p.image_id = w.image_id AND p.k = w.k + 1 AND {on})"""


@query("SELECT image_id, unnest(kept).id AS det_id FROM walk WHERE k = n", "RECURSIVE " + BOXES, _NMS.format(keys="image_id", cls="0", on="true"))
def nms_greedy(spark, sf_dir):
    return suppression.suppress_greedy(views.predictions(spark, sf_dir), 0.5).select("image_id", F.col("det_id").cast("long"))


@query("SELECT image_id, unnest(kept).id AS det_id FROM walk WHERE k = n", "RECURSIVE " + BOXES, _NMS.format(keys="image_id, cls", cls="cls", on="p.cls = w.g"))
def nms_class_aware(spark, sf_dir):
    return suppression.suppress_greedy(views.predictions(spark, sf_dir), 0.5, ("image_id", "cls")).select("image_id", F.col("det_id").cast("long"))


@query("SELECT image_id, cls, det_id, conf FROM pred QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) <= 3", BOXES)
def top_detections(spark, sf_dir):
    return suppression.top_per_group(views.predictions(spark, sf_dir), 3).select("image_id", "cls", "det_id", "conf")


@query("SELECT image_id, cls, x, y, w, h, count(*) - 1 AS extra FROM gt GROUP BY ALL HAVING count(*) > 1", BOXES)
def duplicate_labels(spark, sf_dir):
    return views.truth(spark, sf_dir).groupBy("image_id", "cls", "x", "y", "w", "h").agg((F.count("*") - 1).alias("extra")).where("extra > 0")


@query("SELECT image_id, det_id, 'a' AS side FROM gt WHERE cls < 2 UNION ALL SELECT image_id, det_id, 'b' FROM gt WHERE cls % 2 = 1 AND NOT cls < 2", BOXES)
def union_left_first(spark, sf_dir):
    gt = views.truth(spark, sf_dir)
    a, b = (gt.where(c).select(*KEY, F.lit(s).alias("side")) for c, s in (("cls < 2", "a"), ("cls % 2 = 1", "b")))
    return suppression.union_by_id(a, b, KEY)


# --- datasets


@query("SELECT cls, count(*) AS instances, count(DISTINCT image_id) AS images FROM gt WHERE image_id IN (SELECT image_id FROM images) GROUP BY cls", BOXES)
def dataset_stats(spark, sf_dir):
    return datasets.dataset_stats(views.images(spark, sf_dir), views.truth(spark, sf_dir), views.classes(spark))


@query("SELECT image_id % 3 AS split, cls, count(*) AS n FROM gt GROUP BY ALL", BOXES)
def class_counts(spark, sf_dir):
    return views.truth(spark, sf_dir).groupBy((F.col("image_id") % 3).alias("split"), "cls").agg(F.count("*").alias("n"))


@query(
    """SELECT image_id, sum(n)::BIGINT AS rows, sum(CASE WHEN greatest(x2, y2, w, h) > 1.01 OR least(x2, y2, w, h) < -0.01 THEN n ELSE 0 END)::BIGINT AS out_of_bounds, sum(CASE WHEN cls >= 3 THEN n ELSE 0 END)::BIGINT AS bad_class, sum(n - 1)::BIGINT AS duplicates,
    CASE WHEN sum(CASE WHEN greatest(x2, y2, w, h) > 1.01 OR least(x2, y2, w, h) < -0.01 THEN n ELSE 0 END) > 0 OR sum(CASE WHEN cls >= 3 THEN n ELSE 0 END) > 0 THEN 'corrupt' ELSE 'found' END AS status
    FROM (SELECT image_id, cls, x2, y2, w, h, count(*) AS n FROM gt GROUP BY ALL) GROUP BY image_id""",
    BOXES,
)
def label_verify(spark, sf_dir):
    """Far corners as the coordinates to check, with three classes allowed."""
    labels = views.truth(spark, sf_dir).select("image_id", "cls", F.col("x2").alias("x"), F.col("y2").alias("y"), "w", "h")
    return datasets.verify_labels(labels, 3)


@query("SELECT least(floor(x * 50), 49)::INTEGER AS bx, least(floor(y * 50), 49)::INTEGER AS by, count(*) AS n FROM gt WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 GROUP BY ALL", BOXES)
def label_histogram(spark, sf_dir):
    return datasets.histogram_2d(views.truth(spark, sf_dir), "x", "y")


@query(
    """SELECT fold, cls, val, tot - val AS train, round(val / (tot - val + 1e-7), 6) AS ratio FROM (SELECT *, (sum(val) OVER (PARTITION BY cls))::BIGINT AS tot FROM (
    SELECT CAST(('0x' || substr(md5('0 ' || image_id), 1, 8))::BIGINT % 5 AS INTEGER) AS fold, cls, count(*) AS val FROM gt GROUP BY ALL))""",
    BOXES,
)
def kfold_distribution(spark, sf_dir):
    return _six(datasets.k_folds(views.truth(spark, sf_dir), 5, [0, 1, 2, 3]), "ratio")


@query(None)
def split_stratified_multilabel(spark, sf_dir):
    return datasets.stratified_split(views.truth(spark, sf_dir), views.images(spark, sf_dir), 0.2)


@query(
    """SELECT count(*) AS images, count(*) FILTER (n > 0) AS with_boxes, coalesce(sum(n), 0)::BIGINT AS boxes, round(count(*) FILTER (n > 0) / count(*), 6) AS rate FROM (
    SELECT i.image_id, coalesce(n, 0) AS n FROM images i LEFT JOIN (SELECT image_id, count(*) AS n FROM pred WHERE conf >= 0.5 GROUP BY 1) USING (image_id) WHERE i.image_id NOT IN (SELECT image_id FROM gt WHERE cls = 0))""",
    BOXES,
)
def false_positive_audit(spark, sf_dir):
    """Predictions on images without a label of class 0."""
    normal = views.images(spark, sf_dir).join(views.truth(spark, sf_dir).where("cls = 0"), "image_id", "left_anti")
    found = views.predictions(spark, sf_dir).where("conf >= 0.5").groupBy("image_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return normal.join(found, "image_id", "left").agg(F.count("*").alias("images"), F.count(F.when(n > 0, 1)).alias("with_boxes"), F.sum(n).alias("boxes"), F.round(F.count(F.when(n > 0, 1)) / F.count("*"), 6).alias("rate"))


@query(
    """SELECT gt AS cls, round(hit / (ng + coalesce(np, 0) - hit), 9)::DOUBLE AS iou, round(hit / ng, 9)::DOUBLE AS accuracy FROM (SELECT gt, sum(n) AS ng, sum(n) FILTER (gt = pred) AS hit FROM m GROUP BY gt) LEFT JOIN (SELECT pred AS gt, sum(n) AS np FROM m GROUP BY pred) USING (gt)""",
    BOXES,
    "m AS (SELECT cls AS gt, CAST(floor(conf * 4) AS INTEGER) AS pred, count(*) AS n FROM boxes GROUP BY ALL)",
)
def semantic_confusion_miou(spark, sf_dir):
    """Boxes as pixels: class against the quarter of the confidence."""
    m = views.boxes(spark, sf_dir).groupBy(F.col("cls").alias("gt"), F.floor(F.col("conf") * 4).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return _rounded(metrics.semantic_scores(m), "iou", "accuracy")
