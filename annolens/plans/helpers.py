"""Queries over boxes and tracks for the geometry, distance, sampling and search helpers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from annolens.functions import geometry as geo
from annolens.functions import overlap, strings
from annolens.operators import datasets, matching, metrics, runlog, similarity, suppression, zones
from annolens.plans import views
from annolens.plans.boxes import _AP, _CURVE, _NMS, _STEPS10, KEY, XYWH, XYXY, _ap, _six, box
from annolens.plans.corpora import _U
from annolens.plans.tracks import _LOG, _PREV, ZONE, _log
from annolens.plans.views import BOXES, MATCHED, PAIRS, TRACKS, registry
from annolens.sources import labels
from annolens.sources.folders import scratch

QUERIES, ORACLE_SQL, query = registry()


def _round(names: str, columns, digits: int = 6) -> list:
    return [F.round(c, digits).alias(n) for n, c in zip(names.split(), columns)]


# --- geometry


@query("SELECT image_id, det_id, x, y, w, h, x1, y1, x2, y2, x1 AS l, y1 AS t, round(w * h, 6) AS area FROM boxes", BOXES)
def box_ltwh(spark, sf_dir):
    ltwh = box("x1 y1 w h")
    lt = geo.xywh_to_ltwh(*box(XYWH))[:2]
    return views.boxes(spark, sf_dir).select(*KEY, *datasets.box_columns(geo.ltwh_to_xywh(*ltwh), XYWH), *datasets.box_columns(geo.ltwh_to_xyxy(*ltwh)), *datasets.box_columns(lt, "l t"), F.round(geo.area(*box()), 6).alias("area"))


@query(
    """SELECT image_id, det_id, round(a, 6) AS x1, round(b, 6) AS y1, round(c, 6) AS x2, round(d, 6) AS y2 FROM (SELECT image_id, det_id, least(greatest(p, 0), 600) AS a, least(greatest(q, 0), 450) AS b, least(greatest(r, 0), 600) AS c, least(greatest(s, 0), 450) AS d FROM (
    SELECT image_id, det_id, 640 - x2 * 640 + 8 AS p, 480 - y2 * 480 + 4 AS q, 640 - x1 * 640 + 8 AS r, 480 - y1 * 480 + 4 AS s FROM boxes)) WHERE c > a AND d > b""",
    BOXES,
)
def instance_moves(spark, sf_dir):
    """Boxes scaled to pixels, mirrored both ways, padded and cut; those without an area go."""
    moved = geo.clip_box(*geo.padded(*geo.flipped(*geo.scaled(*box(), 640, 480), 640, 480), 8, 4), F.lit(600.0), F.lit(450.0))
    return views.boxes(spark, sf_dir).select(*KEY, *datasets.box_columns(moved)).where("x2 > x1 AND y2 > y1").select(*KEY, *_round(XYXY, box()))


@query(
    """SELECT image_id, det_id, coalesce(list_min(list_transform(k, lambda p: p[1])), 0) AS x1, coalesce(list_min(list_transform(k, lambda p: p[2])), 0) AS y1, coalesce(list_max(list_transform(k, lambda p: p[1])), 0) AS x2, coalesce(list_max(list_transform(k, lambda p: p[2])), 0) AS y2 FROM (
    SELECT image_id, det_id, CASE WHEN len(list_filter(k, lambda p: p[1] <> 0)) > 0 THEN k END AS k FROM (SELECT image_id, det_id, list_filter(CASE WHEN (x1 < 0)::INT + (y1 < 0)::INT + (x2 > 1)::INT + (y2 > 1)::INT >= 3 THEN list_transform(c, lambda p: [least(greatest(p[1], 0), 1), least(greatest(p[2], 0), 1)]) ELSE c END,
    lambda p: p[1] >= 0 AND p[2] >= 0 AND p[1] <= 1 AND p[2] <= 1) AS k FROM (SELECT *, [[x1, y1], [x2, y1], [x2, y2], [x1, y2]] AS c FROM boxes)))""",
    BOXES,
)
def segment_boxes(spark, sf_dir):
    """Boxes of the corners that lie inside the unit square."""
    c = F.array(*[geo.point(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    held = views.boxes(spark, sf_dir).withColumn("b", geo.segment_box(c, 1.0, 1.0))
    return held.select(*KEY, *[F.coalesce(f"b.{n}", F.lit(0.0)).alias(n) for n in XYXY.split()])


@query(
    """SELECT image_id, det_id, CAST(i - 1 AS INTEGER) AS i, round(px[k] + (px[k + 1] - px[k]) * (s - k + 1), 6) AS px, round(py[k] + (py[k + 1] - py[k]) * (s - k + 1), 6) AS py FROM (
    SELECT *, least(floor(s), 3)::INTEGER + 1 AS k FROM (SELECT image_id, det_id, [x1, x2, x2, x1, x1] AS px, [y1, y1, y2, y2, y1] AS py FROM gt), (SELECT s, row_number() OVER (ORDER BY s) AS i FROM (SELECT range * 4 / 6.0::DOUBLE AS s FROM range(7) UNION ALL SELECT range::DOUBLE FROM range(5))))""",
    BOXES,
)
def polygon_resample(spark, sf_dir):
    """A box's four corners as twelve points; its corners stay."""
    c = F.array(*[geo.point(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    held = views.truth(spark, sf_dir).select(*KEY, F.posexplode(geo.resample(c, 12)).alias("i", "p"))
    return held.select(*KEY, "i", *_round("px py", (F.col("p.x"), F.col("p.y"))))


@query("SELECT image_id, det_id, round(CASE WHEN t > 180 THEN 360 - t ELSE t END, 6) AS angle FROM (SELECT image_id, det_id, abs(degrees(atan2(y2 - y, x1 - x) - atan2(y1 - y, x2 - x))) AS t FROM boxes)", BOXES)
def point_angles(spark, sf_dir):
    return views.boxes(spark, sf_dir).select(*KEY, F.round(geo.angle_at(*box("x2 y1 x y x1 y2")), 6).alias("angle"))


@query(
    """SELECT image_id, det_id, round(least(u1, u2, u3, u4), 6) AS x1, round(least(v1, v2, v3, v4), 6) AS y1, round(greatest(u1, u2, u3, u4), 6) AS x2, round(greatest(v1, v2, v3, v4), 6) AS y2, round(u1, 6) AS kx, round(v1, 6) AS ky,
    CASE WHEN u1 < 0 OR v1 < 0 OR u1 > 1 OR v1 > 1 THEN 0 ELSE 2 END AS kv FROM (SELECT image_id, det_id, """
    + ", ".join(f"(0.9 * {x} - 0.2 * {y} + 0.1) / (0.05 * {x} + 0.1 * {y} + 1) AS u{i}, (0.1 * {x} + 0.8 * {y} + 0.05) / (0.05 * {x} + 0.1 * {y} + 1) AS v{i}" for i, (x, y) in enumerate((("x1", "y1"), ("x2", "y2"), ("x1", "y2"), ("x2", "y1")), 1))
    + " FROM boxes)",
    BOXES,
)
def perspective_moves(spark, sf_dir):
    """Boxes and their first corner as a keypoint under a perspective map."""
    m = [0.9, -0.2, 0.1, 0.1, 0.8, 0.05, 0.05, 0.1, 1.0]
    kx, ky, kv = geo.map_keypoint(F.col("x1"), F.col("y1"), F.lit(2), m, 1, 1)
    return views.boxes(spark, sf_dir).select(*KEY, *_round(XYXY, geo.map_box(*box(), m)), *_round("kx ky", (kx, ky)), kv.alias("kv"))


@query("SELECT image_id, layer, CAST(i AS INTEGER) AS i, (i % n + 0.5::DOUBLE) / n * (32 + image_id % 200) AS x, (i // n + 0.5::DOUBLE) / n * (40 + image_id % 120) AS y FROM (SELECT image_id, layer, n, unnest(range(n * n)) AS i FROM images, (VALUES (0, 4), (1, 2)) t(layer, n))", BOXES)
def point_grids(spark, sf_dir):
    """Grids of points over every image, coarser for the second layer."""
    shapes = views.images(spark, sf_dir).select("image_id", (32 + F.col("image_id") % 200).alias("width"), (40 + F.col("image_id") % 120).alias("height"))
    grids = [shapes.select("*", F.lit(layer).alias("layer"), F.posexplode(geo.grid_points(n)).alias("i", "p")) for layer, n in ((0, 4), (1, 2))]
    return datasets.concatenated(grids).select("image_id", "layer", "i", (F.col("p.x") * F.col("width")).alias("x"), (F.col("p.y") * F.col("height")).alias("y"))


@query(
    """SELECT image_id, layer, x0 AS x1, y0 AS y1, least(x0 + cw, width) AS x2, least(y0 + ch, height) AS y2 FROM (SELECT image_id, layer, width, height, cw, ch, (cw - o) * (i // n) AS x0, (ch - o) * (i % n) AS y0 FROM (
    SELECT *, ceil((o * (n - 1) + width) / n)::BIGINT AS cw, ceil((o * (n - 1) + height) / n)::BIGINT AS ch, unnest(range(n * n)) AS i FROM (
    SELECT image_id, layer, n, 320 + image_id % 200 AS width, 240 + image_id % 120 AS height, CASE WHEN layer = 0 THEN 0 ELSE floor(least(320 + image_id % 200, 240 + image_id % 120) * (0.34::DOUBLE * 2 / n)) END::BIGINT AS o FROM images, (VALUES (0, 1), (1, 2)) t(layer, n))))""",
    BOXES,
)
def layer_crops(spark, sf_dir):
    """The whole image and a layer of four overlapping crops."""
    w, h = 320 + F.col("image_id") % 200, 240 + F.col("image_id") % 120
    parts = [views.images(spark, sf_dir).select("image_id", F.lit(k).alias("layer"), F.explode(geo.crop_boxes(w, h, k, 0.34)).alias("c")) for k in (0, 1)]
    return parts[0].union(parts[1]).select("image_id", "layer", *[F.col(f"c.{n}").cast("long").alias(n) for n in XYXY.split()])


@query("SELECT image_id, det_id, 1 - x1 AS l, 1 - y1 AS t, x2 - 1 AS r, y2 - 1 AS b, x, y, w, h FROM boxes", BOXES)
def anchor_codecs(spark, sf_dir):
    """Distances of a box to an anchor point, and the box from them."""
    d = views.boxes(spark, sf_dir).select(*KEY, *datasets.box_columns(geo.box_to_distances(*box(), F.lit(1.0), F.lit(1.0)), "l t r b"))
    return d.select(*KEY, "l", "t", "r", "b", *datasets.box_columns(geo.distances_to_box(*box("l t r b"), F.lit(1.0), F.lit(1.0)), XYWH))


@query(
    """SELECT image_id, det_id, greatest(cx - hf, 0)::BIGINT AS x1, greatest(cy - hf, 0)::BIGINT AS y1, least(cx + hf, 640)::BIGINT AS x2, least(cy + hf, 480)::BIGINT AS y2 FROM (SELECT image_id, det_id, floor((a + c) / 2) AS cx, floor((b + d) / 2) AS cy, floor(greatest(c - a, d - b) / 2) AS hf FROM (
    SELECT image_id, det_id, greatest(a - trunc((c - a) * 10 / 100), 0) AS a, greatest(b - trunc((d - b) * 10 / 100), 0) AS b, least(c + trunc((c - a) * 10 / 100), 640) AS c, least(d + trunc((d - b) * 10 / 100), 480) AS d FROM (
    SELECT image_id, det_id, trunc(x1 * 640) AS a, trunc(y1 * 480) AS b, trunc(x2 * 640) AS c, trunc(y2 * 480) AS d FROM boxes)))""",
    BOXES,
)
def margin_crops(spark, sf_dir):
    out = geo.margin_crop(*geo.scaled(*box(), 640, 480), F.lit(640), F.lit(480), 10)
    return views.boxes(spark, sf_dir).select(*KEY, *[c.cast("long").alias(n) for n, c in zip(XYXY.split(), out)])


# --- distances


@query(
    """SELECT image_id, g_det_id AS a, p_det_id AS b, round(1 - iou, 9) AS distance, round(1 - iou * p_conf, 9) AS fused, round(least(1 - iou, CASE WHEN abs(p_conf - 0.5) > 0.2 OR 1 - iou > 0.5 THEN 1 ELSE abs(p_conf - 0.5) END), 9) AS gated FROM pairs""",
    BOXES,
    PAIRS,
)
def track_distances(spark, sf_dir):
    """IoU distance, fused with a score, and gated with twice a difference of scores as the other distance."""
    found = matching.pairs(views.truth(spark, sf_dir), views.predictions(spark, sf_dir), same_class=False)
    d = 1 - F.col("iou")
    gated = overlap.fuse_appearance(d, F.abs(F.col("p_conf") - 0.5) * 2)
    return found.select("image_id", F.col("g_det_id").alias("a"), F.col("p_det_id").alias("b"), *_round("distance fused gated", (d, overlap.fuse_score(d, F.col("p_conf")), gated), 9))


@query(
    """SELECT image_id, a, b, round(i / (aw * ah + bw * bh - i + 1e-7) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) / (greatest(ay2, by2) - least(ay1, by1) + 1e-7), 6) AS hiou FROM (
    SELECT g.image_id, g.det_id AS a, p.det_id AS b, g.w AS aw, g.h AS ah, p.w AS bw, p.h AS bh, g.y1 AS ay1, g.y2 AS ay2, p.y1 AS by1, p.y2 AS by2, greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) AS i
    FROM gt g JOIN pred p ON g.image_id = p.image_id AND g.cls = p.cls)""",
    BOXES,
)
def height_iou_pairs(spark, sf_dir):
    g, p = matching.named(views.truth(spark, sf_dir), "g_", ("image_id", "cls")), matching.named(views.predictions(spark, sf_dir), "p_", ("image_id", "cls"))
    return g.join(p, ["image_id", "cls"]).select("image_id", F.col("g_det_id").alias("a"), F.col("p_det_id").alias("b"), F.round(overlap.height_iou(box(prefix="g_"), box(prefix="p_")), 6).alias("hiou"))


_NEXT = "nx AS (SELECT a.vec_id, [x::DOUBLE FOR x IN a.embedding] AS u, [x::DOUBLE FOR x IN b.embedding] AS v FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _next(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("u"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v")), "vec_id", "left")


@query("SELECT vec_id, round(coalesce(greatest(1 - list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 0), 2), 6) AS distance FROM nx", _NEXT)
def embedding_distances(spark, sf_dir):
    """Cosine distance to the next vector; 2 where there is none."""
    return _next(spark, sf_dir).select("vec_id", F.round(overlap.embedding_distance(F.col("u"), F.col("v")), 6).alias("distance"))


@query("SELECT vec_id, round(i / (p + q - i + 1e-7), 6) AS iou FROM (SELECT vec_id, len(list_filter(range(1, len(u) + 1), lambda k: u[k] > 0 AND v[k] > 0)) AS i, len(list_filter(u, lambda x: x > 0)) AS p, len(list_filter(v, lambda x: x > 0)) AS q FROM nx WHERE v IS NOT NULL)", _NEXT)
def mask_ious(spark, sf_dir):
    """Signs of vectors as masks, each against the next."""
    mask = lambda c: F.transform(c, lambda x: (x > 0).cast("int"))
    return _next(spark, sf_dir).where("v IS NOT NULL").select("vec_id", F.round(overlap.mask_iou(mask("u"), mask("v")), 6).alias("iou"))


@query("SELECT vec_id, round(len(list_filter(embedding, lambda x: x::DOUBLE > 0.05)) / len(list_filter(embedding, lambda x: x::DOUBLE > -0.05)), 6) AS stability FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > -0.05)) > 0")
def mask_stability(spark, sf_dir):
    """Vectors as mask logits: pixels above a raised threshold over those above a lowered one."""
    above = lambda t: F.size(F.filter("embedding", lambda x: x.cast("double") > t))
    held = views.table(spark, sf_dir, "embeddings").where(above(-0.05) > 0)
    return held.select("vec_id", F.round(above(0.05) / above(-0.05), 6).alias("stability"))


@query(
    """SELECT track_id, frame, round(acos(least(greatest((vy * dy + vx * dx) / (sqrt(vx * vx + vy * vy) * sqrt(dx * dx + dy * dy)), -1), 1)) / pi(), 6) AS cost FROM (SELECT track_id, frame, lag(x - px) OVER w AS vx, lag(y - py) OVER w AS vy, x - px AS dx, y - py AS dy FROM prev WINDOW w AS (PARTITION BY track_id ORDER BY frame))
    WHERE vx * vx + vy * vy > 0 AND dx * dx + dy * dy > 0""",
    TRACKS,
    _PREV,
)
def direction_costs(spark, sf_dir):
    """Angle between a track's last two steps."""
    steps = zones.with_previous(views.tracks(spark, sf_dir)).withColumns({"dx": F.expr("x - px"), "dy": F.expr("y - py")})
    both = zones.with_previous(steps.select("stream", "track_id", "frame", F.col("dx").alias("x"), F.col("dy").alias("y")))
    long = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    moved = both.where("px * px + py * py > 0 AND x * x + y * y > 0")
    v, d = long("px", "py"), long("x", "y")
    return moved.select("track_id", "frame", F.round(overlap.direction_cost(F.col("py") / v, F.col("px") / v, F.col("y") / d, F.col("x") / d), 6).alias("cost"))


# --- filters and suppression


@query("SELECT image_id, det_id, CASE WHEN conf >= 0.6 THEN 'high' WHEN conf > 0.1 THEN 'low' ELSE 'none' END AS band, conf > 0.25 AS above, conf >= 0.25 AS least FROM pred", BOXES)
def confidence_bands(spark, sf_dir):
    """High and low confidence, and both readings of a threshold."""
    c = F.col("conf")
    return views.predictions(spark, sf_dir).select(*KEY, F.when(c >= 0.6, "high").when(c > 0.1, "low").otherwise("none").alias("band"), (c > 0.25).alias("above"), (c >= 0.25).alias("least"))


@query("SELECT image_id, count(*) FILTER (cls < 3) AS collapsed, count(*) FILTER (cls >= 3) AS bad FROM gt GROUP BY image_id", BOXES)
def collapse_counts(spark, sf_dir):
    """Labels collapsed to one class, and those of a class out of range."""
    return views.truth(spark, sf_dir).groupBy("image_id").agg(F.count(F.when(F.col("cls") < 3, 1)).alias("collapsed"), F.count(F.when(F.col("cls") >= 3, 1)).alias("bad"))


@query("SELECT image_id, det_id, CASE cls WHEN 0 THEN 7 WHEN 1 THEN 11 ELSE 255 END AS cls, CASE cls WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 255 END AS back FROM gt", BOXES)
def class_map_inverse(spark, sf_dir):
    forth, back = ((0, 7), (1, 11)), ((7, 0), (11, 1))
    of = lambda pairs, c: F.coalesce(F.create_map(*[F.lit(v) for p in pairs for v in p])[F.col(c)], F.lit(255))
    return views.truth(spark, sf_dir).withColumn("cls", of(forth, "cls")).select(*KEY, "cls", of(back, "cls").alias("back"))


@query("SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM gt)", BOXES)
def empty_label_images(spark, sf_dir):
    return views.images(spark, sf_dir).join(views.truth(spark, sf_dir), "image_id", "left_anti")


@query("SELECT track_id, frame FROM tracks WHERE x BETWEEN 100 AND 400 AND y BETWEEN 50 AND 300", TRACKS)
def zone_mask(spark, sf_dir):
    return zones.inside_zone(views.tracks(spark, sf_dir), ZONE).select("track_id", "frame")


@query("SELECT image_id, cls, x, y, w, h, det_id FROM gt QUALIFY row_number() OVER (PARTITION BY image_id, cls, x, y, w, h ORDER BY det_id) = 1", BOXES)
def duplicates_first(spark, sf_dir):
    keys = ["image_id", "cls", *XYWH.split()]
    return suppression.remove_duplicates(views.truth(spark, sf_dir), keys, ["det_id"]).select(*keys, "det_id")


_CAND = """cand AS (SELECT image_id, det_id, CAST(c AS INTEGER) AS cls, s AS conf, w, h, x1, y1, x2, y2 FROM (SELECT *, CASE WHEN conf >= 1 - conf THEN cls ELSE (cls + 1) % 4 END AS c, greatest(conf, 1 - conf) AS s FROM pred) WHERE s > 0.6)"""


@query("SELECT image_id, unnest(kept).id AS det_id, g AS cls FROM walk WHERE k = n", "RECURSIVE " + BOXES, _CAND, _NMS.format(keys="image_id, cls", cls="cls", on="p.cls = w.g").replace("FROM pred)", "FROM cand)"))
def nms_pipeline(spark, sf_dir):
    """Score arrays to candidates to suppressed detections."""
    at = lambda k: F.when(F.col("cls") == k, F.col("conf")).when((F.col("cls") + 1) % 4 == k, 1 - F.col("conf")).otherwise(0.0)
    scored = views.predictions(spark, sf_dir).withColumn("scores", F.array(*map(at, range(4)))).drop("cls", "conf")
    return suppression.non_max_suppression(scored, 0.6, 0.5).select("image_id", F.col("det_id").cast("long"), "cls")


_SHIFT = "moved AS (SELECT image_id, det_id, cls, conf, w, h, x1 + image_id % 3 AS x1, y1 + det_id % 2 AS y1, x2 + image_id % 3 AS x2, y2 + det_id % 2 AS y2 FROM pred)"
_OVER = "((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))"


@query(
    f"SELECT a.image_id || '' AS image_id, a.det_id FROM moved a WHERE NOT EXISTS (SELECT 1 FROM moved b WHERE b.image_id = a.image_id AND b.cls = a.cls AND (b.conf > a.conf OR (b.conf = a.conf AND b.det_id < a.det_id)) AND b.x1 < a.x2 AND a.x1 < b.x2 AND b.y1 < a.y2 AND a.y1 < b.y2 AND {_OVER} / (a.w * a.h + b.w * b.h - {_OVER}) >= 0.3)",
    BOXES,
    _SHIFT,
)
def tile_merge(spark, sf_dir):
    """Detections of tiles, named by image and origin, merged in the image."""
    tile = F.concat(F.col("image_id").cast("string"), F.lit("__1024__"), (F.col("image_id") % 3).cast("string"), F.lit("___"), (F.col("det_id") % 2).cast("string"))
    return suppression.merge_tiles(views.predictions(spark, sf_dir).withColumn("tile", tile).drop("image_id")).select("image_id", "det_id")


@query(
    """SELECT 'a' AS side, image_id AS stream, det_id AS track_id FROM gt WHERE NOT EXISTS (SELECT 1 FROM close c WHERE c.image_id = gt.image_id AND c.g_det_id = gt.det_id AND g_det_id < p_det_id)
    UNION ALL SELECT 'b', image_id, det_id FROM pred WHERE NOT EXISTS (SELECT 1 FROM close c WHERE c.image_id = pred.image_id AND c.p_det_id = pred.det_id AND g_det_id >= p_det_id)""",
    BOXES,
    PAIRS,
    "close AS (SELECT * FROM pairs WHERE 1 - iou < 0.15)",
)
def duplicate_tracks(spark, sf_dir):
    """Boxes as tracks that have lived as many frames as their number."""
    as_tracks = lambda df: df.select(F.col("image_id").alias("stream"), F.col("det_id").alias("track_id"), F.col("det_id").alias("frames"), *XYXY.split())
    a, b = suppression.remove_duplicate_tracks(as_tracks(views.truth(spark, sf_dir)), as_tracks(views.predictions(spark, sf_dir)))
    return a.select(F.lit("a").alias("side"), "stream", "track_id").union(b.select(F.lit("b"), "stream", "track_id"))


@query(
    """SELECT image_id, p_det_id AS anchor_id, g_det_id AS det_id FROM (SELECT * FROM (SELECT g.image_id, g.det_id AS g_det_id, p.det_id AS p_det_id, p.conf, i / (g.w * g.h + p.w * p.h - i) AS o FROM (
    SELECT g, p, greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) AS i FROM gt g JOIN pred p ON g.image_id = p.image_id AND p.x > g.x1 AND p.x < g.x2 AND p.y > g.y1 AND p.y < g.y2))
    QUALIFY row_number() OVER (PARTITION BY image_id, g_det_id ORDER BY conf DESC, p_det_id) <= 3) QUALIFY row_number() OVER (PARTITION BY image_id, p_det_id ORDER BY o DESC, g_det_id) = 1""",
    BOXES,
)
def anchor_candidates(spark, sf_dir):
    """Predictions' centres as anchors of the labels around them."""
    p = views.predictions(spark, sf_dir)
    anchors = p.select("image_id", F.col("det_id").alias("anchor_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("conf").alias("score"), *[F.col(c).alias(f"a_{c}") for c in XYXY.split()])
    gt = views.truth(spark, sf_dir).select(*KEY, *XYXY.split())
    return matching.top_candidates(anchors, gt, 3, overlap.iou(box(), box(prefix="a_"))).select("image_id", "anchor_id", "det_id")


# --- metrics


@query("SELECT cls, round(coalesce(m, (SELECT avg(ap) FROM ap)), 6) AS map FROM (SELECT CAST(range AS INTEGER) AS cls FROM range(5)) LEFT JOIN (SELECT cls, avg(ap) AS m FROM ap GROUP BY cls) USING (cls)", BOXES, PAIRS, _STEPS10, MATCHED, _CURVE, _AP)
def class_maps(spark, sf_dir):
    """Mean average precision by class; a fifth class without labels has the mean of all."""
    return _six(metrics.class_maps(_ap(spark, sf_dir), spark.range(5).select(F.col("id").cast("int").alias("cls"))), "map")


@query("SELECT image_id, cls, round_even(n / tot, 5) AS pixel_ratio FROM (SELECT *, sum(n) OVER (PARTITION BY image_id) AS tot FROM (SELECT image_id, cls, count(*) AS n FROM boxes GROUP BY ALL)) WHERE cls < 3", BOXES)
def pixel_ratios(spark, sf_dir):
    """Boxes as pixels; class 3 has no name."""
    return metrics.pixel_ratio(views.boxes(spark, sf_dir).groupBy("image_id", "cls").agg(F.count("*").alias("n")), [0, 1, 2])


@query("SELECT sum(n)::BIGINT AS instances, [sum(c0)::BIGINT, sum(c1)::BIGINT, sum(c2)::BIGINT, sum(c3)::BIGINT] AS instances_by_class, count(*) AS images, count(*) FILTER (n = 0) AS unlabelled, [count(*) FILTER (c0 > 0), count(*) FILTER (c1 > 0), count(*) FILTER (c2 > 0), count(*) FILTER (c3 > 0)] AS images_by_class FROM (SELECT i.image_id, count(cls) AS n, count(*) FILTER (cls = 0) AS c0, count(*) FILTER (cls = 1) AS c1, count(*) FILTER (cls = 2) AS c2, count(*) FILTER (cls = 3) AS c3 FROM images i LEFT JOIN gt USING (image_id) GROUP BY i.image_id)", BOXES)
def dataset_report(spark, sf_dir):
    return datasets.stats_report(views.images(spark, sf_dir), views.truth(spark, sf_dir), [0, 1, 2, 3])


@query("SELECT round(avg(best), 6) AS mean FROM (SELECT run, max(fitness) AS best FROM log GROUP BY run)", TRACKS, _LOG)
def mean_over_runs(spark, sf_dir):
    """The mean of every run's best fitness."""
    return _six(runlog.best_epoch(_log(spark, sf_dir), "fitness").agg(F.avg("fitness").alias("mean")), "mean")


@query("SELECT run, epoch, round(sum(v) / 5, 6) AS smooth FROM (SELECT a.run, a.epoch, b.fitness AS v FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM log) a, range(-2, 3) o, log b WHERE b.run = a.run AND b.epoch = least(greatest(a.epoch + o.range, 1), n)) GROUP BY ALL", TRACKS, _LOG)
def moving_average(spark, sf_dir):
    return _six(runlog.smoothed_series(_log(spark, sf_dir), "fitness", 5).select("run", "epoch", "smooth"), "smooth")


@query("SELECT track_id, frame, list(x) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS trail FROM tracks", TRACKS)
def track_history(spark, sf_dir):
    return zones.history(views.tracks(spark, sf_dir)).select("track_id", "frame", F.transform("trail", lambda p: p["x"]).alias("trail"))


@query("SELECT frame, count(*) AS n, count(DISTINCT cls) AS classes FROM tracks GROUP BY frame", TRACKS)
def frame_totals(spark, sf_dir):
    return views.tracks(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), F.countDistinct("cls").alias("classes"))


# --- sampling


@query(f"SELECT doc_id, CASE WHEN r <= round_even(n * 0.5, 0) THEN 'flip' WHEN r <= round_even(n * 0.5, 0) + round_even(n * 0.3, 0) THEN 'rotate' ELSE 'blur' END AS recipe FROM (SELECT doc_id, row_number() OVER (ORDER BY {_U.format(id='doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents)")
def recipe_allocation(spark, sf_dir):
    return datasets.recipes(views.table(spark, sf_dir, "documents").select("doc_id"), [("flip", 0.5), ("rotate", 0.3), ("blur", 0.2)], "doc_id")


@query(
    """SELECT image_id, m AS det_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY worst, m) AS r, count(*) OVER (PARTITION BY image_id) AS n FROM (
    SELECT a.image_id, a.det_id AS m, max(greatest(least(1 - a.x1, b.x2) - greatest(1 - a.x2, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / ((b.x2 - b.x1) * (b.y2 - b.y1) + 1e-7)) AS worst FROM gt a JOIN gt b USING (image_id) GROUP BY ALL) WHERE worst < 0.3) WHERE r <= round_even(n * 0.5, 0)""",
    BOXES,
)
def copy_donors(spark, sf_dir):
    return datasets.copy_donors(views.truth(spark, sf_dir), 0.5)


@query(
    """SELECT image_id, list_concat(t, list_transform(range(3 - len(t)), lambda x: -1)) AS texts FROM (SELECT image_id, list_concat(own, lacking[1:greatest(least(3 - len(own), 1), 0)]) AS t FROM (SELECT i.image_id,
    coalesce(list(DISTINCT cls ORDER BY cls) FILTER (cls IS NOT NULL), [])[1:3] AS own, list_transform(list_sort(list_filter([{'u': ('0x' || substr(md5('0 ' || i.image_id || ' ' || c), 1, 8))::BIGINT, 'c': c} FOR c IN [0, 1, 2, 3]], lambda z: NOT list_contains(coalesce(list(DISTINCT cls ORDER BY cls) FILTER (cls IS NOT NULL), [])[1:3], z.c))), lambda z: z.c) AS lacking
    FROM images i LEFT JOIN gt USING (image_id) GROUP BY i.image_id))""",
    BOXES,
)
def text_samples(spark, sf_dir):
    """Three texts an image: its classes, one it lacks, padding."""
    return datasets.text_samples(views.truth(spark, sf_dir), views.images(spark, sf_dir), 4, 3, 1)


_RANKED = "{n} AS (SELECT image_id, row_number() OVER (ORDER BY ('0x' || substr(md5('{seed} ' || image_id), 1, 8))::BIGINT, image_id) AS r, count(*) OVER () AS n FROM ({of}))"


@query(
    "SELECT b.image_id, d.image_id AS donor FROM b JOIN d ON d.r = (b.r - 1) % d.n + 1",
    BOXES,
    _RANKED.format(n="b", seed=0, of="SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM gt WHERE cls = 1)"),
    _RANKED.format(n="d", seed=1, of="SELECT image_id FROM gt GROUP BY image_id HAVING bool_or(cls = 1) AND NOT bool_or(cls = 3)"),
)
def background_donors(spark, sf_dir):
    gt = views.truth(spark, sf_dir)
    return datasets.paired_donors(views.images(spark, sf_dir).join(gt.where("cls = 1"), "image_id", "left_anti"), datasets.minority_images(gt, 1, [3]))


@query(f"SELECT round(sum(n_chars) * (SELECT count(*) FROM documents) / count(*) * 1.5, 6) AS required FROM (SELECT n_chars FROM documents ORDER BY {_U.format(id='doc_id')}, doc_id LIMIT 30)")
def sample_extrapolation(spark, sf_dir):
    """The feature is an estimate from 30 rows."""
    return _six(datasets.extrapolated(views.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id"), "required")


@query("SELECT 0 AS part, image_id, det_id FROM gt UNION ALL SELECT 1, image_id, det_id FROM pred", BOXES)
def concatenated(spark, sf_dir):
    return datasets.concatenated([views.truth(spark, sf_dir).select(*KEY), views.predictions(spark, sf_dir).select(*KEY)]).select("part", *KEY)


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'xx') AND trim(lang) <> ''")
def unknown_labels(spark, sf_dir):
    return datasets.unknown_labels(views.table(spark, sf_dir, "documents"), "lang", ["en", "xx"])


@query(
    """SELECT batch, count(*) AS n, min(ratio) AS least, max(ratio) AS most FROM (SELECT ratio, CAST(floor((row_number() OVER (ORDER BY ratio, u, image_id) - 1) / 8) AS BIGINT) AS batch FROM (
    SELECT image_id, ('0x' || substr(md5('0 ' || image_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, (40 + image_id % 120) / (32 + image_id % 200)::DOUBLE AS ratio FROM images)) GROUP BY ALL""",
    BOXES,
)
def shape_batches(spark, sf_dir):
    shapes = views.images(spark, sf_dir).select("image_id", (32 + F.col("image_id") % 200).alias("width"), (40 + F.col("image_id") % 120).alias("height"))
    return datasets.shape_batches(shapes, 8).withColumn("batch", F.col("batch").cast("long"))


_WIN = """SELECT {rate} AS rate, image_id, x1, y1, x1 + {c} AS x2, y1 + {c} AS y2 FROM (SELECT *, max(ratio) OVER (PARTITION BY image_id) AS top FROM (
  SELECT *, (least(x1 + {c}, width) - x1) * (least(y1 + {c}, height) - y1) / ({c} * {c})::DOUBLE AS ratio FROM (
  SELECT DISTINCT image_id, width, height, CASE WHEN width > {c} AND i * {s} + {c} > width THEN width - {c} ELSE i * {s} END AS x1, CASE WHEN height > {c} AND j * {s} + {c} > height THEN height - {c} ELSE j * {s} END AS y1
  FROM shapes, (SELECT range AS i FROM range(20)), (SELECT range AS j FROM range(20)) WHERE i <= CASE WHEN width <= {c} THEN 0 ELSE ceil((width - {c}) / {s}) END AND j <= CASE WHEN height <= {c} THEN 0 ELSE ceil((height - {c}) / {s}) END)))
  WHERE ratio > 0.6 OR (top <= 0.6 AND ratio > top - 0.01)"""


@query(_WIN.format(rate=1, c=64, s=48) + " UNION ALL " + _WIN.format(rate=2, c=32, s=24), BOXES, "shapes AS (SELECT image_id, 32 + image_id % 200 AS width, 40 + image_id % 120 AS height FROM images)")
def tile_rates(spark, sf_dir):
    """Windows at two rates: crop and gap divided by each."""
    shapes = views.images(spark, sf_dir).select("image_id", (32 + F.col("image_id") % 200).alias("width"), (40 + F.col("image_id") % 120).alias("height"))
    parts = [datasets.window_grid(shapes, int(64 / r), int(16 / r)).select(F.lit(r).alias("rate"), "image_id", *XYXY.split()) for r in (1, 2)]
    return parts[0].union(parts[1])


@query("SELECT image_id, printf('%d %g %g %g %g %g %g %g %g', cls, a, b, c, b, c, d, a, d) AS value FROM (SELECT image_id, cls, least(greatest(x1 / 3, 0), 0.3) AS a, least(greatest(y1 / 3, 0), 0.3) AS b, least(greatest(x2 / 3, 0), 0.3) AS c, least(greatest(y2 / 3, 0), 0.3) AS d FROM pred WHERE conf > 0.25) WHERE c > a AND d > b", BOXES)
def auto_labels(spark, sf_dir):
    """Confident detections as outlines cut at a frame, those without an area left out, as label lines."""
    cut = geo.clip_box(*[F.col(c) / 3 for c in XYXY.split()], F.lit(0.3), F.lit(0.3))
    held = metrics.confident(views.predictions(spark, sf_dir)).select("image_id", "cls", *datasets.box_columns(cut)).where("x2 > x1 AND y2 > y1")
    return held.select("image_id", labels.line(F.col("cls"), *box("x1 y1 x2 y1 x2 y2 x1 y2"), digits=None).alias("value"))


@query("SELECT image_id, det_id, [floor(greatest(least(CASE WHEN t <= 510 THEN c[1] + (c[2] - c[1]) * (t - 475) / 35 ELSE c[2] + (c[3] - c[2]) * (t - 510) / 140 END, 255), 0))::INTEGER FOR t IN [450.0::DOUBLE, 500, 550, 600, 650, 700]] AS bands FROM (SELECT image_id, det_id, [x * 255, y * 255, conf * 255] AS c FROM pred)", BOXES)
def wavelengths(spark, sf_dir):
    """Three channels at 475, 510 and 650 as six bands, beyond the ends in the same line."""
    c = F.array(*[F.col(k) * 255 for k in ("x", "y", "conf")])
    at = lambda k: F.get(c, F.lit(k))

    def band(t):
        low, high = at(0) + (at(1) - at(0)) * (t - 475) / 35, at(1) + (at(2) - at(1)) * (t - 510) / 140
        return geo.clamp(F.when(t <= 510, low).otherwise(high), 0, 255)

    return views.predictions(spark, sf_dir).select(*KEY, F.transform(F.array(*[F.lit(450.0 + 50 * i) for i in range(6)]), lambda t: F.floor(band(t)).cast("int")).alias("bands"))


# --- text and search


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10 || '.' || lpad((doc_id % 100) || '', 2, '0'))::DOUBLE ELSE 'Infinity'::DOUBLE END AS threshold, CASE WHEN doc_id % 2 = 0 THEN doc_id || '' ELSE 'img' || doc_id END AS image_key, '/d/images/labels/' || doc_id || '.txt' AS label_path,
    doc_id % 7 AS chipping, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id / 4 END::DOUBLE AS weight, printf('%.2f', doc_id / 8) AS fixed, sha256(doc_id || '') AS digest FROM documents"""
)
def string_parsing(spark, sf_dir):
    i = F.col("doc_id")
    text = i.cast("string")
    run = F.when(i % 3 == 0, F.concat(F.lit("exp_conf"), (i % 10).cast("string"), F.lit("p"), F.lpad((i % 100).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("exp_"), text))
    stem = F.when(i % 2 == 0, F.concat(F.lit("00"), text)).otherwise(F.concat(F.lit("img"), text))
    pairs = F.array(F.concat(F.lit("chipping="), (i % 7).cast("string")), F.lit("spot=x"))
    weight = F.when(i % 5 == 0, F.lit(float("nan"))).otherwise(i / 4)
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", strings.threshold_of(run).alias("threshold"), strings.image_key(stem).alias("image_key"), strings.label_path(F.concat(F.lit("/d/images/images/"), text, F.lit(".png"))).alias("label_path"),
        strings.parsed_counts(pairs)["chipping"].cast("long").alias("chipping"), strings.nan_to_zero(weight).alias("weight"), strings.fixed(i / 8, 2).alias("fixed"), F.sha2(text, 256).alias("digest"),
    )


@query("SELECT page_id, CASE WHEN n = 1 THEN ident ELSE ident || '_' || n END AS name FROM (SELECT page_id, ident, row_number() OVER (PARTITION BY lower(ident) ORDER BY page_id) AS n FROM (SELECT page_id, regexp_replace(substr(url, 1, 24), '[^a-zA-Z0-9_]', '_', 'g') AS ident FROM pages))")
def unique_identifiers(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", strings.unique_identifier(F.substring("url", 1, 24), F.col("page_id")).alias("name"))


@query("SELECT category, n FROM f WHERE n >= least((SELECT max(n) FROM f), 100)", "f AS (SELECT lower(trim(category)) AS category, count(*) AS n FROM (SELECT unnest(string_split(url, '/')) AS category FROM pages) WHERE trim(category) <> '' GROUP BY 1)")
def frequent_categories(spark, sf_dir):
    return datasets.frequent_categories(datasets.category_frequency(views.table(spark, sf_dir, "pages"), "url"))


@query("SELECT q.vec_id AS query_id, n.vec_id, round(sqrt(list_sum([pow(a.x - a.y, 2) FOR a IN list_transform(range(1, len(n.e) + 1), lambda k: {'x': n.e[k], 'y': q.e[k]})])), 5) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(sqrt(list_sum([pow(a.x - a.y, 2) FOR a IN list_transform(range(1, len(n.e) + 1), lambda k: {'x': n.e[k], 'y': q.e[k]})])), 5), n.vec_id) AS INTEGER) AS rank FROM v n, v q WHERE n.label % 2 = 0 AND q.vec_id % 20 = 0 QUALIFY rank <= 5", "v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings)")
def vector_search_filtered(spark, sf_dir):
    """The feature: the five nearest vectors of even label by Euclidean distance, through an index that was written and loaded."""
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    index = similarity.load_or_build_index(spark, f"{scratch(spark)}/index", lambda: vectors)
    queries = index.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return similarity.vector_search(index, queries, 5, metric="l2", where="label % 2 = 0")


@query(
    """SELECT n.vec_id, round(list_dot_product(n.e, m.e) / (sqrt(list_dot_product(n.e, n.e)) * sqrt(list_dot_product(m.e, m.e))), 5) AS score FROM v n, (SELECT list(x ORDER BY i) AS e FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v WHERE vec_id IN (1, 2, 3)) GROUP BY i)) m ORDER BY 2 DESC, 1 LIMIT 10""",
    "v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings)",
)
def similar_to_several(spark, sf_dir):
    """The feature: the ten vectors nearest to the mean of three given ones."""
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = similarity.mean_vector(vectors.where(F.col("vec_id").isin(1, 2, 3))).withColumn("query_id", F.lit(0))
    return similarity.vector_search(vectors, asked, 10, metric="cosine").select("vec_id", F.col("score"))


# --- further reports


def _masks(text: str) -> str:
    """A chain of SQL steps once more, for boxes of half the width as masks."""
    return re.sub(r"\b(gt|pred|pairs|best|matched|curve|pts|env|nxt|lastp|grid|val|ap)\b", r"z_\1", text)


_HALVED = "z_gt AS (SELECT * REPLACE (x - w / 4 AS x1, x + w / 4 AS x2, w / 2 AS w) FROM gt), z_pred AS (SELECT * REPLACE (x - w / 4 AS x1, x + w / 4 AS x2, w / 2 AS w) FROM pred)"


@query(
    "SELECT round(a, 6) AS box_map, round(b, 6) AS mask_map, round(a + b, 6) AS fitness FROM (SELECT (SELECT avg(ap) FROM ap) AS a, (SELECT avg(z_ap) FROM z_ap) AS b)",
    BOXES, PAIRS, _STEPS10, MATCHED, _CURVE, _AP, _HALVED, _masks(PAIRS), _masks(MATCHED), _masks(_CURVE), _masks(_AP),
)
def segment_metrics(spark, sf_dir):
    """Box and mask metrics of the same detections, and the sum that is their fitness."""
    gt, pred = views.truth(spark, sf_dir), views.predictions(spark, sf_dir)
    half = lambda df: df.withColumns({"x1": F.expr("x - w / 4"), "x2": F.expr("x + w / 4")})
    n_gt = gt.groupBy("cls").agg(F.count("*").alias("n"))
    both = []
    for name, g, p in (("box_map", gt, pred), ("mask_map", half(gt), half(pred))):
        ap = metrics.average_precision_of(p, matching.match_marks(matching.pairs(g, p), metrics.STEPS), n_gt, metrics.STEPS)
        both.append(ap.agg(F.avg("ap").alias(name)))
    return _six(both[0].join(both[1]).withColumn("fitness", F.col("box_map") + F.col("mask_map")), "box_map", "mask_map", "fitness")


_POSES = """z_gt AS (SELECT * FROM gt), z_pred AS (SELECT * FROM pred), z_pairs AS (SELECT g.image_id, g.cls AS g_cls, p.cls AS p_cls, g.det_id AS g_det_id, p.det_id AS p_det_id, p.conf AS p_conf,
  round((exp(-(pow(g.x1 - p.x1, 2) + pow(g.y1 - p.y1, 2)) / (0.04 * (g.w * g.h * 0.53 + 1e-7) * 2)) + exp(-(pow(g.x2 - p.x2, 2) + pow(g.y2 - p.y2, 2)) / (0.16 * (g.w * g.h * 0.53 + 1e-7) * 2))) / (2 + 1e-7), 9) AS iou
  FROM gt g JOIN pred p ON g.image_id = p.image_id AND g.cls = p.cls)"""


@query(
    "SELECT round(a, 6) AS box_map, round(b, 6) AS pose_map, round(a + b, 6) AS fitness FROM (SELECT (SELECT avg(ap) FROM ap) AS a, (SELECT avg(z_ap) FROM z_ap) AS b)",
    BOXES, PAIRS, _STEPS10, MATCHED, _CURVE, _AP, _POSES, _masks(MATCHED), _masks(_CURVE), _masks(_AP),
)
def pose_metrics(spark, sf_dir):
    """Box and pose metrics of the same detections, two corners as keypoints, and the sum that is their fitness."""
    corners = F.array(*[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.lit(1).alias("v")) for i in (1, 2)])
    gt, pred = (f(spark, sf_dir).withColumn("keypoints", corners) for f in (views.truth, views.predictions))
    n_gt = gt.groupBy("cls").agg(F.count("*").alias("n"))
    both = []
    for name, near in (("box_map", matching.pairs(gt, pred)), ("pose_map", matching.keypoint_pairs(gt, pred, [0.1, 0.2], metrics.STEPS[0]))):
        ap = metrics.average_precision_of(pred, matching.match_marks(near, metrics.STEPS), n_gt, metrics.STEPS)
        both.append(ap.agg(F.avg("ap").alias(name)))
    return _six(both[0].join(both[1]).withColumn("fitness", F.col("box_map") + F.col("pose_map")), "box_map", "pose_map", "fitness")


@query(
    """SELECT image_id, status, CASE WHEN status = 'found' THEN n - d ELSE 0 END::BIGINT AS kept, d::BIGINT AS duplicates FROM (SELECT i.image_id, CASE WHEN i.image_id % 7 = 0 THEN 'missing' WHEN i.image_id % 7 = 1 OR n IS NULL THEN 'empty' WHEN bad THEN 'corrupt' ELSE 'found' END AS status, coalesce(n, 0) AS n, coalesce(d, 0) AS d
    FROM images i LEFT JOIN (SELECT image_id, count(*) AS n, count(*) - count(DISTINCT {'a': cls, 'b': x, 'c': y, 'd': w, 'e': h}) AS d, bool_or(greatest(x, y, w, h) > 0.8) AS bad FROM gt WHERE image_id % 7 > 1 AND det_id % 3 = 0 GROUP BY image_id) USING (image_id))""",
    BOXES,
)
def label_scan(spark, sf_dir):
    """Images, their label files and what these hold: missing, empty, corrupt or found."""
    images = views.images(spark, sf_dir)
    files = images.where("image_id % 7 <> 0").select("image_id", F.when(F.col("image_id") % 7 == 1, 0).otherwise(9).alias("length"))
    rows = views.truth(spark, sf_dir).where("image_id % 7 > 1 AND det_id % 3 = 0")
    return datasets.scanned_labels(images, files, rows, 4, high=0.8)


@query("SELECT cls, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS cls FROM range(6)) LEFT JOIN (SELECT cls, count(*) AS n FROM gt GROUP BY cls) USING (cls)", BOXES)
def class_histogram(spark, sf_dir):
    return datasets.class_histogram(views.truth(spark, sf_dir), spark.range(6).select(F.col("id").cast("int").alias("cls")))


@query("SELECT run, round(regr_slope(loss, epoch), 6) AS slope, round(regr_intercept(loss, epoch), 6) AS intercept FROM (SELECT *, lag(loss) OVER (PARTITION BY run ORDER BY epoch) AS p FROM log) WHERE p IS NULL OR loss > p GROUP BY run HAVING count(*) > 1", TRACKS, _LOG)
def memory_fit(spark, sf_dir):
    """Fits on the points that rise."""
    rising = runlog.increasing(_log(spark, sf_dir), "epoch", "loss", ["run"])
    many = rising.groupBy("run").count().where("count > 1").select("run")
    return _six(runlog.linear_fit(rising.join(many, "run", "left_semi"), "epoch", "loss", ["run"]), "slope", "intercept")


@query("SELECT CAST(row_number() OVER (ORDER BY cls) AS INTEGER) AS index, cls, n || '' AS n, coalesce(CASE WHEN n > 200 THEN n END || '', '-') AS metric, coalesce(n > 200 AND n > 210, FALSE) AS passed FROM (SELECT cls, count(*) AS n FROM tracks GROUP BY cls)", TRACKS)
def benchmark_table(spark, sf_dir):
    """Event types stand for exported formats; a metric may be absent."""
    n = views.tracks(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n")).withColumn("metric", F.when(F.col("n") > 200, F.col("n")))
    return runlog.benchmark_table(n, ["cls"], "metric", 210)


@query("SELECT image_id, unnest(kept).id AS det_id, g AS cls FROM walk WHERE k = n", "RECURSIVE " + BOXES, _SHIFT, _NMS.format(keys="image_id, cls", cls="cls", on="p.cls = w.g").replace("FROM pred)", "FROM moved)"))
def slice_merge(spark, sf_dir):
    """Detections of slices moved to the image and suppressed."""
    found = views.predictions(spark, sf_dir).withColumns({"ox": F.col("image_id") % 3, "oy": F.col("det_id") % 2})
    return suppression.merge_slices(found, 0.5).select("image_id", F.col("det_id").cast("long"), "cls")


@query("SELECT quality || '' AS cls, sum(length(doc_id || '') + 1)::BIGINT AS bytes, TRUE AS ok FROM labels GROUP BY quality")
def class_folder_scan(spark, sf_dir):
    """Files in one folder for each class, written and scanned without reading them."""
    path = scratch(spark)
    rows = views.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("value"), F.concat(F.lit("class"), F.col("quality").cast("string")).alias("q"))
    labels.write_lines(rows, path, "q")
    found = labels.class_folders(spark, path, "part-*").where("ok")
    return found.groupBy(F.regexp_extract("cls", r"class(.*)$", 1).alias("cls")).agg(F.sum("length").alias("bytes"), F.min("ok").alias("ok"))
