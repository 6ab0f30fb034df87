"""Queries over matched boxes: evaluation by size, windows and objects, assignments, enclosing rectangles; over track lives, rasters and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.functions import geometry as geo
from annolens.operators import association, datasets, grid, lifecycle, matching, raster, runlog, sized
from annolens.plans import views
from annolens.plans.views import BOXES, PAIRS, registry
from annolens.sources.folders import shipped
from annolens.streaming import metrics_log, track_lifecycle

QUERIES, ORACLE_SQL, query = registry()
XYXY = "x1 y1 x2 y2"


# --- evaluation by size: boxes in pixels of images of three scales, every seventh truth box a crowd


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = (1 + F.col("image_id") % 3) * F.lit(64.0)
    b = views.boxes(spark, sf_dir)
    sides = (F.col("w") * scale) * (F.col("h") * scale)
    return b.select("image_id", "det_id", "cls", "conf", "is_gt", *[(F.col(c) * scale).alias(c) for c in XYXY.split()], sides.alias("area"), (F.col("is_gt") & (F.col("det_id") % 7 == 0)).alias("crowd"))


def _truth(spark, sf_dir) -> DataFrame:
    return _sized(spark, sf_dir).where("is_gt").drop("is_gt", "conf")


def _found(spark, sf_dir) -> DataFrame:
    return _sized(spark, sf_dir).where("NOT is_gt").drop("is_gt", "crowd")


_SIZED = """sized AS (SELECT image_id, det_id, cls, conf, is_gt, s * x1 AS x1, s * y1 AS y1, s * x2 AS x2, s * y2 AS y2, (s * w) * (s * h) AS area, is_gt AND det_id % 7 = 0 AS crowd
  FROM (SELECT *, 64.0::DOUBLE * (1 + image_id % 3) AS s FROM boxes)),
ranges(range, low, high) AS (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE), ('small', 0.0, 1024.0), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)),
thresholds AS (SELECT round(0.5 + 0.05 * range, 2)::DOUBLE AS threshold FROM range(10)),
dets AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det_id) AS k FROM sized WHERE NOT is_gt QUALIFY k <= 100),
touching AS (SELECT d.image_id, d.cls, d.det_id, d.k, d.conf, d.area, g.det_id AS g, g.area AS ga, g.crowd, (least(g.x2, d.x2) - greatest(g.x1, d.x1)) * (least(g.y2, d.y2) - greatest(g.y1, d.y1)) AS i
  FROM dets d JOIN sized g ON g.is_gt AND g.image_id = d.image_id AND g.cls = d.cls AND g.x1 < d.x2 AND d.x1 < g.x2 AND g.y1 < d.y2 AND d.y1 < g.y2),
near AS (SELECT image_id, cls, det_id, k, conf, area, list({'share': share, 'g': g, 'area': ga, 'crowd': crowd}) AS truths
  FROM (SELECT *, CASE WHEN crowd THEN i / area ELSE i / (area + ga - i) END AS share FROM touching) WHERE share >= 0.5 GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY k) AS turn FROM near),
walk AS (SELECT DISTINCT image_id, cls, range, low, high, threshold, 0::BIGINT AS turn, 0::BIGINT AS det_id, 0::BIGINT AS k, 0::DOUBLE AS conf, []::BIGINT[] AS taken, false AS hit, false AS left_out FROM turns, ranges, thresholds
  UNION ALL SELECT image_id, cls, range, low, high, threshold, turn, det_id, k, conf, CASE WHEN best IS NOT NULL AND NOT best.crowd THEN list_append(taken, best.g) ELSE taken END, best IS NOT NULL,
    CASE WHEN best IS NOT NULL THEN NOT best.counts ELSE area < low OR area > high END FROM (
    SELECT w.image_id, w.cls, range, low, high, threshold, t.turn, t.det_id, t.k, t.conf, t.area, taken,
      list_max([{'counts': NOT (x.crowd OR x.area < low OR x.area > high), 'share': x.share, 'g': x.g, 'crowd': x.crowd} FOR x IN truths IF x.share >= threshold AND (x.crowd OR NOT list_contains(taken, x.g))]) AS best
    FROM walk w JOIN turns t ON t.image_id = w.image_id AND t.cls = w.cls AND t.turn = w.turn + 1)),
looked AS (SELECT image_id, cls, range, threshold, det_id, k, conf, hit, left_out FROM walk WHERE turn > 0
  UNION ALL SELECT image_id, cls, range, threshold, det_id, k, conf, false, area < low OR area > high FROM dets d, ranges, thresholds WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.image_id = d.image_id AND n.cls = d.cls AND n.det_id = d.det_id)),
n AS (SELECT cls, range, count(*) AS n FROM sized, ranges WHERE is_gt AND NOT crowd AND area >= low AND area <= high GROUP BY ALL),
points AS (SELECT cls, range, threshold, t / n AS r, t / c AS p FROM (
  SELECT *, sum(hit::INTEGER) OVER w AS t, count(*) OVER w AS c FROM looked WHERE NOT left_out WINDOW w AS (PARTITION BY cls, range, threshold ORDER BY conf DESC, image_id, k ROWS UNBOUNDED PRECEDING)) JOIN n USING (cls, range) WHERE hit),
tops AS (SELECT cls, range, threshold, i, max(p) AS p FROM (SELECT *, least(CASE WHEN (floor(r * 100) + 1) * 0.01::DOUBLE <= r THEN floor(r * 100) + 1 WHEN floor(r * 100) * 0.01::DOUBLE <= r THEN floor(r * 100) ELSE floor(r * 100) - 1 END, 100) AS i FROM points) GROUP BY ALL),
aps AS (SELECT cls, range, threshold, coalesce(sum(p), 0) / 101 AS ap FROM (SELECT n.cls, n.range, t.threshold, g.range AS at, max(tops.p) AS p FROM n CROSS JOIN thresholds t CROSS JOIN range(101) g LEFT JOIN tops ON tops.cls = n.cls AND tops.range = n.range AND tops.threshold = t.threshold AND tops.i >= g.range GROUP BY ALL) GROUP BY ALL),
recalls AS (SELECT n.cls, n.range, t.threshold, m.most, coalesce(count(*) FILTER (hit AND NOT left_out AND k <= most), 0) / any_value(n) AS recall FROM n CROSS JOIN thresholds t CROSS JOIN (VALUES (1), (10), (100)) m(most) LEFT JOIN looked l ON l.cls = n.cls AND l.range = n.range AND l.threshold = t.threshold GROUP BY ALL)"""


@query(
    """SELECT name, round(coalesce(value, -1), 6) AS value FROM (
    SELECT 'AP' AS name, avg(ap) AS value FROM aps WHERE range = 'all' UNION ALL SELECT 'AP50', avg(ap) FROM aps WHERE range = 'all' AND threshold = 0.5
    UNION ALL SELECT 'AP75', avg(ap) FROM aps WHERE range = 'all' AND threshold = 0.75 UNION ALL SELECT 'AP_' || s, avg(ap) FROM (VALUES ('small'), ('medium'), ('large')) v(s) LEFT JOIN aps ON range = s GROUP BY s
    UNION ALL SELECT 'AR_' || most, avg(recall) FROM recalls WHERE range = 'all' GROUP BY most UNION ALL SELECT 'AR_' || s, avg(recall) FROM (VALUES ('small'), ('medium'), ('large')) v(s) LEFT JOIN recalls ON range = s AND most = 100 GROUP BY s)""",
    "RECURSIVE " + BOXES,
    _SIZED,
)
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and recall by size of boxes and number of predictions."""
    return sized.summary(_truth(spark, sf_dir), _found(spark, sf_dir)).select("name", F.round("value", 6).alias("value"))


@query("SELECT cls, range, threshold, count(*) FILTER (hit AND NOT left_out) AS tp, count(*) FILTER (NOT hit AND NOT left_out) AS fp, count(*) FILTER (left_out) AS left_out FROM looked GROUP BY ALL", "RECURSIVE " + BOXES, _SIZED)
def size_outcomes(spark, sf_dir):
    """Predictions that count as right, as wrong, or not at all, by class, size and threshold."""
    n = sized.counts(_truth(spark, sf_dir), _found(spark, sf_dir))
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    hit, out = F.col("hit"), F.col("left_out")
    return n.groupBy("cls", "range", "threshold").agg(count(hit & ~out, "tp"), count(~hit & ~out, "fp"), count(out, "left_out"))


# --- windows and objects: rotated boxes in an image of 640 x 480


def _rotated(spark, sf_dir) -> DataFrame:
    turn = (F.col("det_id") % 7) * 0.2 + 0.05
    corners = geo.rotated_corners(F.col("x") * 640, F.col("y") * 480, F.col("w") * 160, F.col("h") * 120, turn)
    return views.boxes(spark, sf_dir).select("image_id", "det_id", "cls", corners.alias("points"))


_CORNERS = """corners AS (SELECT image_id, det_id, cls, [{'x': px + ax + bx, 'y': py + ay + b_y}, {'x': px + ax - bx, 'y': py + ay - b_y}, {'x': px - ax - bx, 'y': py - ay - b_y}, {'x': px - ax + bx, 'y': py - ay + b_y}] AS points FROM (
  SELECT image_id, det_id, cls, x * 640 AS px, y * 480 AS py, w * 160 / 2 * cos(r) AS ax, w * 160 / 2 * sin(r) AS ay, -(h * 120) / 2 * sin(r) AS bx, h * 120 / 2 * cos(r) AS b_y FROM (SELECT *, (det_id % 7) * 0.2::DOUBLE + 0.05::DOUBLE AS r FROM boxes)))"""
_AREA = "abs(list_sum([p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y FOR i IN range(1, len(p) + 1)])) / 2"


def _cut(source: str, name: str, axis: str, bound: str, sign: int) -> str:
    """One step of clipping in SQL: the part of p where sign * (axis - bound) is at least 0."""
    at = lambda q: f"({sign} * (p[{q}].{axis} - {bound}))"
    before = "((i + len(p) - 2) % len(p) + 1)"
    a, b = at(before), at("i")
    cross = f"{{'x': p[{before}].x + (p[i].x - p[{before}].x) * ({a} / ({a} - {b})), 'y': p[{before}].y + (p[i].y - p[{before}].y) * ({a} / ({a} - {b}))}}"
    return f"{name} AS (SELECT * EXCLUDE p, flatten([list_concat(CASE WHEN ({a} >= 0) <> ({b} >= 0) THEN [{cross}] ELSE [] END, CASE WHEN {b} >= 0 THEN [p[i]] ELSE [] END) FOR i IN range(1, len(p) + 1)]) AS p FROM {source})"


_WINDOWS = """starts(size, x) AS (VALUES (640, 0), (640, 192), (640, 384), (480, 0), (480, 192), (480, 224)),
windows AS (SELECT image_id, a.x AS x1, b.x AS y1, a.x + 256 AS x2, b.x + 256 AS y2 FROM (SELECT DISTINCT image_id FROM boxes), starts a, starts b WHERE a.size = 640 AND b.size = 480),
held AS (SELECT w.*, det_id, cls, points AS p, points AS whole FROM windows w JOIN corners c ON c.image_id = w.image_id
  AND list_min([q.x FOR q IN points]) < x2 AND list_max([q.x FOR q IN points]) > x1 AND list_min([q.y FOR q IN points]) < y2 AND list_max([q.y FOR q IN points]) > y1)"""


@query(
    f"SELECT image_id, x1, y1, x2, y2, det_id, cls, round(inside / greatest(area, 1e-6), 6) AS iof FROM (SELECT * EXCLUDE (p, whole), coalesce({_AREA}, 0) AS inside, {_AREA.replace('p[', 'whole[').replace('len(p)', 'len(whole)')} AS area FROM bottom) WHERE inside / greatest(area, 1e-6) >= 0.7",
    BOXES,
    _CORNERS,
    _WINDOWS,
    _cut("held", "lefts", "x", "x1", 1),
    _cut("lefts", "rights", "x", "x2", -1),
    _cut("rights", "tops", "y", "y1", 1),
    _cut("tops", "bottom", "y", "y2", -1),
)
def window_objects(spark, sf_dir):
    """Sliding windows with the rotated boxes of which they hold at least 0.7."""
    shapes = views.boxes(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(640).alias("width"), F.lit(480).alias("height"))
    windows = datasets.window_grid(shapes, 256, 64)
    found = grid.window_objects(windows, _rotated(spark, sf_dir), 0.7, cell=256.0)
    return found.withColumn("iof", F.round("iof", 6))


@query(
    """SELECT image_id, det_id, round(min_by(w * h, round(w * h, 6)), 4) AS area, round(min_by(w, round(w * h, 6)), 4) AS w, round(min_by(h, round(w * h, 6)), 4) AS h FROM (
    SELECT image_id, det_id, greatest(max(u) - min(u), max(v) - min(v)) AS w, least(max(u) - min(u), max(v) - min(v)) AS h FROM (
      SELECT image_id, det_id, i, j, (q.x * dx + q.y * dy) / sqrt(dx * dx + dy * dy) AS u, (q.y * dx - q.x * dy) / sqrt(dx * dx + dy * dy) AS v FROM (
        SELECT image_id, det_id, i, j, p[j].x - p[i].x AS dx, p[j].y - p[i].y AS dy, unnest(p) AS q FROM (SELECT image_id, det_id, p, i, unnest(range(1, len(p) + 1)) AS j FROM (SELECT image_id, det_id, list_append(points, {'x': points[1].x + 10, 'y': points[1].y + 25}) AS p, unnest(range(1, 6)) AS i FROM corners)) WHERE i <> j))
    GROUP BY image_id, det_id, i, j) GROUP BY image_id, det_id""",
    BOXES,
    _CORNERS,
)
def smallest_rectangles(spark, sf_dir):
    """The rectangle of least area around the corners of a rotated box and one point more."""
    points = F.concat("points", F.array(geo.point(F.col("points")[0]["x"] + 10, F.col("points")[0]["y"] + 25)))
    r = shipped(_rotated(spark, sf_dir)).select("image_id", "det_id", geo.smallest_rectangle(points).alias("r"))
    return r.select("image_id", "det_id", F.round(F.col("r.w") * F.col("r.h"), 4).alias("area"), F.round("r.w", 4).alias("w"), F.round("r.h", 4).alias("h"))


# --- associations: truth boxes and predictions of an image


def _edges(spark, sf_dir, same_class: bool) -> DataFrame:
    found = matching.pairs(views.truth(spark, sf_dir), views.predictions(spark, sf_dir), same_class)
    return found.withColumnsRenamed({"g_det_id": "a", "p_det_id": "b"})


@query(
    "SELECT image_id, a, b, round(cost, 6) AS cost, round FROM rounds WHERE match",
    "RECURSIVE " + BOXES,
    PAIRS,
    """rounds AS (SELECT -1 AS round, 0.0::DOUBLE AS lim, image_id, g_det_id AS a, p_det_id AS b, 1 - iou AS cost, false AS match, false AS gone FROM pairs
  UNION ALL SELECT round + 1, CASE WHEN round < 0 THEN 0.8::DOUBLE ELSE lim - 0.05::DOUBLE END, image_id, a, b, cost, match, bool_or(match) OVER (PARTITION BY image_id, a) OR bool_or(match) OVER (PARTITION BY image_id, b) FROM (
    SELECT round, lim, image_id, a, b, cost, row_number() OVER (PARTITION BY image_id, a ORDER BY cost, b) = 1 AND row_number() OVER (PARTITION BY image_id, b ORDER BY cost, a) = 1 AS match
    FROM rounds WHERE NOT gone AND cost < CASE WHEN round < 0 THEN 0.8::DOUBLE ELSE lim - 0.05::DOUBLE END))""",
)
def mutual_nearest(spark, sf_dir):
    """Truth boxes and predictions that are each other's nearest, round by round, by a distance of 1 - IoU."""
    costs = _edges(spark, sf_dir, False).select("image_id", "a", "b", (1 - F.col("iou")).alias("cost"))
    found = association.mutual_nearest(costs, 0.8, 0.05)
    return found.select("image_id", "a", "b", F.round("cost", 6).alias("cost"), "round")


def _assignment(edges: str) -> str:
    """SQL of the best assignment within (image_id, grp): every partial matching, one a after another."""
    return f"""edges AS ({edges}),
turns AS (SELECT image_id, grp, p, list({{'a': a, 'b': b, 'v': v}} ORDER BY b) AS options FROM (SELECT *, dense_rank() OVER (PARTITION BY image_id, grp ORDER BY a) AS p FROM edges) GROUP BY ALL),
walk AS (SELECT DISTINCT image_id, grp, 0::BIGINT AS p, 0::BIGINT AS total, []::STRUCT(a BIGINT, b BIGINT, v BIGINT)[] AS picks FROM turns
  UNION SELECT image_id, grp, p, CASE WHEN o IS NULL THEN total ELSE total + o.v END, CASE WHEN o IS NULL THEN picks ELSE list_append(picks, o) END FROM (
    SELECT w.image_id, w.grp, t.p, total, picks, unnest(list_append([x FOR x IN options IF NOT list_contains([y.b FOR y IN picks], x.b)], NULL)) AS o FROM walk w JOIN turns t ON t.image_id = w.image_id AND t.grp = w.grp AND t.p = w.p + 1)),
best AS (SELECT image_id, grp, max(total) AS total FROM walk GROUP BY ALL)"""


@query(
    "SELECT image_id, grp AS cls, total FROM best",
    "RECURSIVE " + BOXES,
    PAIRS,
    _assignment("SELECT image_id, g_cls AS grp, g_det_id AS a, p_det_id AS b, round(iou * 1000000)::BIGINT AS v FROM pairs WHERE g_cls = p_cls AND iou >= 0.5"),
)
def optimal_matches(spark, sf_dir):
    """The largest total IoU (in millionths) of truth boxes and predictions of one class matched one to one at IoU 0.5."""
    edges = _edges(spark, sf_dir, True).where("iou >= 0.5").select("image_id", "cls", "a", "b", F.round(F.col("iou") * 1_000_000).cast("long").alias("benefit"))
    found = association.assign(edges, ("image_id", "cls"))
    return found.groupBy("image_id", "cls").agg(F.sum("benefit").alias("total"))


@query(
    """SELECT b.image_id, total, (SELECT count(*) FROM gt g WHERE g.image_id = b.image_id) AS n_truth FROM best b""",
    "RECURSIVE " + BOXES,
    PAIRS,
    _assignment("SELECT image_id, 0 AS grp, g_det_id AS a, p_det_id AS b, round((iou - 0.6) * 1000)::BIGINT AS v FROM pairs WHERE iou > 0.601"),
)
def linear_assignment(spark, sf_dir):
    """Assignment of least cost 1 - IoU with a limit of 0.4, whatever the class: what it gains over no pairs, in thousandths, and the image's truth boxes."""
    edges = _edges(spark, sf_dir, False).where("iou > 0.601").select("image_id", "a", "b", F.round((F.col("iou") - 0.6) * 1000).cast("long").alias("benefit"))
    found = association.assign(edges).groupBy("image_id").agg(F.sum("benefit").alias("total"))
    return found.join(views.truth(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n_truth")), "image_id")


# --- tracks over time: users as objects in four streams, half a day a frame


def _sightings(spark, sf_dir) -> DataFrame:
    t = views.table(spark, sf_dir, "events")
    frame = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 43200)
    return t.select((F.col("user_id") % 4).alias("stream"), frame.alias("frame"), F.col("user_id").alias("object"), F.timestamp_seconds(frame * 43200).alias("ts")).where("user_id IS NOT NULL").distinct()


_LIFE = """sightings AS (SELECT DISTINCT user_id % 4 AS stream, floor(epoch(ts) / 43200)::BIGINT AS frame, user_id AS object FROM events WHERE user_id IS NOT NULL),
gaps AS (SELECT *, frame - lag(frame) OVER (PARTITION BY stream, object ORDER BY frame) AS gap FROM sightings),
seen AS (SELECT *, last_value(CASE WHEN gap IS NULL OR gap > 10 THEN frame END IGNORE NULLS) OVER (PARTITION BY stream, object ORDER BY frame) AS start FROM gaps),
named AS (SELECT *, dense_rank() OVER (PARTITION BY stream ORDER BY start, object) AS track_id FROM seen),
ends AS (SELECT stream, max(frame) AS last FROM sightings GROUP BY stream),
after AS (SELECT n.*, last, lead(frame) OVER (PARTITION BY stream, track_id ORDER BY frame) AS next FROM named n JOIN ends USING (stream)),
changes AS (SELECT stream, frame, object, track_id, 'tracked' AS state, last FROM after WHERE frame = start OR gap > 1
  UNION ALL SELECT stream, frame + 1, object, track_id, 'lost', last FROM after WHERE next IS NULL OR next > frame + 1
  UNION ALL SELECT stream, frame + 11, object, track_id, 'removed', last FROM after WHERE next IS NULL)"""


@query("SELECT stream, frame, object, track_id, state FROM changes WHERE frame <= last", _LIFE)
def track_transitions(spark, sf_dir):
    """When tracks are found, lost and removed, with ids counted up by stream."""
    return lifecycle.transitions(_sightings(spark, sf_dir), 10)


@query("SELECT stream, frame, object, track_id, state FROM changes c WHERE frame <= (SELECT max(frame) FROM sightings s WHERE s.stream = c.stream)", _LIFE)
def streaming_track_transitions(spark, sf_dir):
    """The same from a stream, whose state holds live tracks only."""
    return track_lifecycle.from_table(spark, _sightings(spark, sf_dir), 10)


@query("SELECT cls, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM (SELECT event_type AS cls, value FROM events) GROUP BY cls")
def streaming_metrics_log(spark, sf_dir):
    """Counts and sums by class that a stream logs for every micro-batch, added up."""
    per_batch = lambda rows: rows.groupBy(F.col("event_type").alias("cls")).agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    log = metrics_log.from_table(views.table(spark, sf_dir, "events"), "ts", per_batch, "cls string, n long, total double")
    return log.groupBy("cls").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


# --- rasters: rotated boxes in an image of 64 x 48


def _small(spark, sf_dir) -> DataFrame:
    small = F.transform("points", lambda p: geo.point(p["x"] / 10, p["y"] / 10))
    return _rotated(spark, sf_dir).select("image_id", "det_id", small.alias("points"))


def _masks(spark, sf_dir) -> DataFrame:
    return raster.masks(_small(spark, sf_dir), 64, 48)


_RUNS = """lines AS (SELECT image_id, det_id, p, unnest(range(greatest(ceil(list_min([q.x FOR q IN p]) - 0.5), 0)::BIGINT, least(floor(list_max([q.x FOR q IN p]) - 0.5), 63)::BIGINT + 1)) AS px
  FROM (SELECT image_id, det_id, [{'x': q.x / 10, 'y': q.y / 10} FOR q IN points] AS p FROM corners)),
crossed AS (SELECT image_id, det_id, px, list_sort([p[i].y + (px + 0.5::DOUBLE - p[i].x) * (p[i % 4 + 1].y - p[i].y) / (p[i % 4 + 1].x - p[i].x) FOR i IN range(1, 5) IF (p[i].x > px + 0.5::DOUBLE) <> (p[i % 4 + 1].x > px + 0.5::DOUBLE)]) AS c FROM lines),
runs AS (SELECT image_id, det_id, px, least(greatest(ceil(c[1] - 0.5), 0), 48)::BIGINT AS y0, least(greatest(ceil(c[2] - 0.5), 0), 48)::BIGINT AS y1 FROM crossed WHERE len(c) > 1),
held AS (SELECT * FROM runs WHERE y1 > y0), sizes AS (SELECT image_id, det_id, sum(y1 - y0)::BIGINT AS area FROM held GROUP BY ALL)"""


@query("SELECT s.image_id, s.det_id, area, min(px) AS x1, min(y0) AS y1, max(px) + 1 AS x2, max(y1) AS y2 FROM held h JOIN sizes s ON s.image_id = h.image_id AND s.det_id = h.det_id GROUP BY ALL", BOXES, _CORNERS, _RUNS)
def polygon_masks(spark, sf_dir):
    """Pixels of every rotated box, through run lengths and back: area and enclosing box."""
    return raster.through_counts(_small(spark, sf_dir), 64, 48)


@query(
    """SELECT image_id, det_id, count(*) AS pixels FROM (SELECT image_id, det_id FROM (SELECT h.image_id, h.det_id, px, unnest(range(y0, y1)) AS y, area FROM held h JOIN sizes s ON s.image_id = h.image_id AND s.det_id = h.det_id)
    QUALIFY row_number() OVER (PARTITION BY image_id, px, y ORDER BY area, det_id DESC) = 1) GROUP BY ALL""",
    BOXES,
    _CORNERS,
    _RUNS,
)
def overlap_masks(spark, sf_dir):
    """Pixels that each rotated box owns where the smallest on top hides the larger."""
    owned = raster.owners(_masks(spark, sf_dir))
    return owned.groupBy("image_id", "det_id").agg(F.sum(F.col("y1") - F.col("y0")).alias("pixels"))


# --- tuning: the nine best suppliers as parents

_GENES = {"rate": (0.0, 0.2), "momentum": (0.0, 1.0, 0.5), "decay": (0.0, 2.0)}


def _parents(spark, sf_dir) -> DataFrame:
    s = views.table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_acctbal").alias("fitness"), ((F.col("s_suppkey") % 100) / 1000).alias("rate"), (F.col("s_nationkey") / 25).alias("momentum"), F.lit(0.5).alias("decay"))
    return runlog.top_results(rows, 9)


_U = "('0x' || substr(md5(concat_ws(' ', {0})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_CHILD = f"""parents AS (SELECT s_acctbal AS fitness, (s_suppkey % 100) / 1000.0::DOUBLE AS rate, s_nationkey / 25.0::DOUBLE AS momentum, 0.5::DOUBLE AS decay FROM supplier ORDER BY fitness DESC, rate, momentum, decay LIMIT 9),
weighed AS (SELECT *, fitness - min(fitness) OVER () + 1e-6::DOUBLE AS w FROM parents),
summed AS (SELECT *, sum(w) OVER (ORDER BY fitness DESC, rate, momentum, decay ROWS UNBOUNDED PRECEDING) AS high, sum(w) OVER () AS total FROM weighed),
drawn AS (SELECT s.* FROM summed s, (SELECT {_U.format("0, 'draw', range")} AS u FROM range(9)) WHERE u * total >= high - w AND u * total < high),
genes AS (UNPIVOT (SELECT rate, momentum, decay FROM drawn) ON rate, momentum, decay INTO NAME gene VALUE v),
ends AS (SELECT gene, min(v) AS low, max(v) AS high, CASE WHEN min(v) = max(v) THEN 0.01::DOUBLE + 0.09::DOUBLE * ({_U.format("0, 'span', gene")}) ELSE max(v) - min(v) END AS span FROM genes GROUP BY gene),
child AS (SELECT gene, low - 0.2::DOUBLE * span + ({_U.format("0, 'gene', gene")}) * (high + 0.2::DOUBLE * span - (low - 0.2::DOUBLE * span)) AS value FROM ends),
bounds(gene, low, high, gain) AS (VALUES ('rate', 0.0::DOUBLE, 0.2::DOUBLE, 1.0::DOUBLE), ('momentum', 0.0, 1.0, 0.5), ('decay', 0.0, 2.0, 1.0)),
draws AS (SELECT *, CASE WHEN {_U.format("0, 'mask', try, gene")} < 0.5 THEN least(greatest(exp(sqrt(-2 * ln(1 - {_U.format("0, 'size', try, gene")})) * cos(2 * pi() * ({_U.format("0, 'turn', try, gene")})) * 0.2::DOUBLE * gain), 0.25), 4.0) ELSE 1.0 END AS factor
  FROM child JOIN bounds USING (gene), (SELECT range AS try FROM range(64)))"""


@query("SELECT gene, round(value, 6) AS value FROM child", _CHILD)
def tuning_crossover(spark, sf_dir):
    child = runlog.crossover(_parents(spark, sf_dir), list(_GENES), 9, 0.2)
    return child.select("gene", F.round("value", 6).alias("value"))


@query("SELECT gene, round(least(greatest(value * factor, low), high), 5) AS value FROM draws WHERE try = (SELECT coalesce(min(try), 0) FROM draws WHERE factor <> 1)", _CHILD)
def tuning_mutation(spark, sf_dir):
    return runlog.mutated(runlog.crossover(_parents(spark, sf_dir), list(_GENES), 9, 0.2), _GENES)
