"""Round trips: rows made of the supplied tables are written by a sink and come back through a reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolens.functions import geometry as geo
from annolens.operators import metrics, zones
from annolens.plans import views
from annolens.plans.boxes import KEY, XYXY, _matched
from annolens.plans.tracks import _LOG, _log
from annolens.plans.views import BOXES, MATCHED, PAIRS, TRACKS, registry
from annolens.sources import annotations, labels, reports
from annolens.sources.folders import scratch

QUERIES, ORACLE_SQL, query = registry()
NAMES = ["chipping", "scratch", "splash", "spot"]


def _c(names: str) -> list:
    return [F.col(c) for c in names.split()]


def _sheet() -> F.Column:
    """Sixteen files stand for all images."""
    return F.concat(F.lit("sheet"), (F.col("image_id") % 16).cast("string"))


# --- label text


@query("SELECT image_id, det_id, printf('%d %.6f %.6f %.6f %.6f', cls, x, y, w, h) AS fixed6, printf('%d %.8f %.8f', cls, x / 3, y / 7) AS fixed8, printf('%d %g %g %g', cls, x / 3, w * 1000, conf / 4096) AS short FROM boxes", BOXES)
def label_lines(spark, sf_dir):
    n = F.col("cls")
    return views.boxes(spark, sf_dir).select(
        *KEY, labels.line(n, *_c("x y w h")).alias("fixed6"), labels.line(n, F.col("x") / 3, F.col("y") / 7, digits=8).alias("fixed8"),
        labels.line(n, F.col("x") / 3, F.col("w") * 1000, F.col("conf") / 4096, digits=None).alias("short"),
    )


@query("SELECT 'sheet' || (image_id % 16) AS stem, cls, x, y, w, h FROM gt", BOXES)
def labels_round_trip(spark, sf_dir):
    """Five-field lines, one folder a sheet, with odd lines between them."""
    path = scratch(spark)
    rows = views.truth(spark, sf_dir).select(_sheet().alias("sheet"), labels.line(*_c("cls x y w h")).alias("value"))
    odd = rows.select("sheet").distinct().select("sheet", F.explode(F.array(F.lit(""), F.lit("1 0.5 0.5"), F.lit("1 0.1 0.2 0.3 0.4 0.5 0.6"))).alias("value"))
    labels.write_lines(rows.union(odd), path, "sheet")
    read = labels.five_fields(labels.read_lines(spark, path))
    return read.select(F.regexp_extract("path", r"sheet=([^/]*)/", 1).alias("stem"), "cls", "x", "y", "w", "h")


@query("SELECT cls, x, y, w, h, CAST(printf('%.6f', conf) AS DOUBLE) AS conf FROM pred", BOXES)
def predictions_strict(spark, sf_dir):
    path = scratch(spark)
    labels.write_lines(views.predictions(spark, sf_dir).select(labels.line(*_c("cls x y w h conf")).alias("value")), path)
    return labels.strict(labels.read_lines(spark, path), prediction=True).drop("path", "stem")


@query("SELECT cls, CASE WHEN det_id % 2 = 0 THEN (x1 + x2) / 2 ELSE x END AS x, CASE WHEN det_id % 2 = 0 THEN (y1 + y2) / 2 ELSE y END AS y, w, h FROM gt", BOXES)
def polygons_strict(spark, sf_dir):
    """Every second label as a polygon of its corners; enclosing boxes come back."""
    path = scratch(spark)
    polygon, box = labels.line(*_c("cls x1 y1 x2 y1 x2 y2 x1 y2"), digits=8), labels.line(*_c("cls x y w h"), digits=8)
    labels.write_lines(views.truth(spark, sf_dir).select(F.when(F.col("det_id") % 2 == 0, polygon).otherwise(box).alias("value")), path)
    return labels.strict(labels.read_lines(spark, path)).drop("path", "stem")


@query("SELECT cls, x, y, w, h FROM gt WHERE det_id % 3 <> 0", BOXES)
def labels_lenient(spark, sf_dir):
    """Lines of four fields are left out."""
    path = scratch(spark)
    value = F.when(F.col("det_id") % 3 == 0, labels.line(*_c("cls x y w"))).otherwise(labels.line(*_c("cls x y w h")))
    labels.write_lines(views.truth(spark, sf_dir).select(value.alias("value")), path)
    return labels.lenient(labels.read_lines(spark, path)).drop("path", "stem")


@query("SELECT cls, count(*) AS n FROM gt GROUP BY cls", BOXES)
def label_totals(spark, sf_dir):
    path = scratch(spark)
    labels.write_lines(views.truth(spark, sf_dir).select(labels.line(*_c("cls x y w h")).alias("value")), path)
    return labels.class_totals(labels.read_lines(spark, path))


@query("SELECT run, threshold, cls, count(*) AS n FROM pred JOIN (VALUES ('exp_conf0p25', 0.25::DOUBLE), ('exp_conf0p5', 0.5::DOUBLE), ('exp_confx', 'Infinity'::DOUBLE)) r(run, threshold) ON conf >= CASE WHEN run = 'exp_confx' THEN 0.75 ELSE threshold END GROUP BY ALL", BOXES)
def threshold_runs(spark, sf_dir):
    """Label folders of runs named by their threshold; folders of other names are passed over."""
    root, pred = scratch(spark), views.predictions(spark, sf_dir)
    for run, least in (("exp_conf0p25", 0.25), ("exp_conf0p5", 0.5), ("exp_confx", 0.75), ("metrics", 0.0)):
        labels.write_lines(pred.where(F.col("conf") >= least).select(labels.line(*_c("cls x y w h conf")).alias("value")), f"{root}/{run}/labels")
    found = labels.strict(labels.runs(spark, root), prediction=True)
    return found.groupBy("run", "threshold", "cls").agg(F.count("*").alias("n")).orderBy("threshold", "cls")


@query(
    """SELECT image_id, cls, round(640 * x1, 3) AS x1, round(480 * y1, 3) AS y1, round(640 * x2, 3) AS x3, round(480 * y2, 3) AS y3 FROM gt""", BOXES
)
def oriented_round_trip(spark, sf_dir):
    """Unrotated boxes as eight coordinates and a class name; a line of eight fields is left out."""
    path = scratch(spark)
    gt = views.truth(spark, sf_dir).select("image_id", "cls", *[(F.col(c) * s).alias(c) for c, s in zip(XYXY.split(), (640, 480, 640, 480))])
    coords = [F.format_string("%.3f", c) for c in _c("x1 y1 x2 y1 x2 y2 x1 y2")]
    name = F.get(F.array(*map(F.lit, NAMES)), F.col("cls"))
    value = F.concat_ws(" ", *coords, name, F.col("image_id").cast("string"))
    labels.write_lines(gt.select(value.alias("value")).union(gt.limit(1).select(F.concat_ws(" ", *coords).alias("value"))), path)
    lines = labels.read_lines(spark, path).withColumn("image_id", F.regexp_extract("value", r"(\d+)$", 1).cast("long"))
    read = labels.oriented(lines, {n: i for i, n in enumerate(NAMES)})
    return read.select("image_id", "cls", "x1", "y1", "x3", "y3")


@query(
    """SELECT image_id, cls, round_even(conf, 5) AS conf, round_even(100 * x - 100 * w / 2 * cos(r) + 100 * h / 2 * sin(r), 3) AS x3, round_even(100 * y - 100 * w / 2 * sin(r) + 100 * h / 2 * cos(r), 3) AS y4, count(*) AS n
    FROM (SELECT *, (det_id % 7) * 0.2::DOUBLE + 0.05::DOUBLE AS r FROM pred) GROUP BY ALL""",
    BOXES,
)
def oriented_export(spark, sf_dir):
    """Rotated predictions as text, one folder a class, and their third and fourth corner as read back."""
    path = scratch(spark)
    turn = (F.col("det_id") % 7) * 0.2 + 0.05
    found = views.predictions(spark, sf_dir).withColumns({"r": turn, **{c: F.col(c) * 100 for c in "xywh"}})
    labels.write_lines(reports.oriented_lines(found, F.col("image_id").cast("string")), path, "cls")
    f = F.split("value", " ")
    at = lambda k: f[k].cast("double")
    read = spark.read.text(path).select(f[0].cast("long").alias("image_id"), "cls", at(1).alias("conf"), at(6).alias("x3"), at(9).alias("y4"))
    return read.groupBy("image_id", "cls", "conf", "x3", "y4").agg(F.count("*").alias("n"))


@query(
    """SELECT image_id || '' AS image_id, cls + 1 AS category_id, round_even(conf, 5) AS score, [round_even(100 * x, 3), round_even(100 * y, 3), round_even(100 * w, 3), round_even(100 * h, 3), round_even(r, 3)] AS rbox,
    round_even(100 * x + 100 * w / 2 * cos(r) - 100 * h / 2 * sin(r), 3) AS px FROM (SELECT *, (det_id % 7) * 0.2::DOUBLE + 0.05::DOUBLE AS r FROM pred)""",
    BOXES,
)
def rotated_json(spark, sf_dir):
    """Rotated predictions as JSON records, read back, with the first corner's x."""
    path = scratch(spark)
    turn = (F.col("det_id") % 7) * 0.2 + 0.05
    found = views.predictions(spark, sf_dir).withColumns({"r": turn, **{c: F.col(c) * 100 for c in "xywh"}})
    out = reports.rotated_records(found, F.concat(F.col("image_id").cast("string"), F.lit(".jpg")), F.col("cls") + 1)
    out.write.json(path)
    return spark.read.schema(out.schema).json(path).select("image_id", "category_id", "score", "rbox", F.col("poly")[0].alias("px"))


@query(
    """SELECT image_id || '' AS image_id, image_id || '.jpg' AS file_name, cls + 1 AS category_id, [x1, y1, x2 - x1, y2 - y1] AS bbox, round_even(conf, 5) AS score, [x1, y1, 2, x2, y2, 1] AS keypoints FROM (
    SELECT image_id, cls, conf, 64 * x1 AS x1, 64 * y1 AS y1, 64 * x2 AS x2, 64 * y2 AS y2 FROM pred)""",
    BOXES,
)
def keypoint_json(spark, sf_dir):
    """Predictions with two keypoints as JSON records, read back."""
    path = scratch(spark)
    found = views.predictions(spark, sf_dir).withColumns({c: F.col(c) * 64 for c in XYXY.split()})
    points = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.lit(v).alias("v")) for a, b, v in (("x1", "y1", 2), ("x2", "y2", 1))])
    out = reports.keypoint_records(found, F.concat(F.col("image_id").cast("string"), F.lit(".jpg")), F.col("cls") + 1, points)
    out.write.json(path)
    return spark.read.schema(out.schema).json(path)


@query(
    """SELECT image_id, kind, status, cls, x, y, w, h, n FROM (
    SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'boxes' ELSE 'polygons' END AS kind, CASE WHEN image_id % 5 = 0 THEN 'corrupt' ELSE 'found' END AS status, cls, x / 4 + 0.25 AS x, y / 4 + 0.25 AS y, w / 4 AS w, h / 4 AS h, CASE WHEN image_id % 3 = 0 THEN -1 ELSE 4 END AS n FROM gt WHERE image_id % 5 <> 0
    UNION SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'boxes' ELSE 'polygons' END, 'corrupt', NULL, NULL, NULL, NULL, NULL, -1 FROM gt WHERE image_id % 5 = 0)""",
    BOXES,
)
def labels_sniffed(spark, sf_dir):
    """Label lines of boxes or of outlines, an image a file; those of every fifth image have a class out of range."""
    sides = [F.col("x") / 4 + 0.25, F.col("y") / 4 + 0.25, F.col("w") / 4, F.col("h") / 4]
    x1, y1, x2, y2 = geo.xywh_to_xyxy(*sides)
    cls = F.when(F.col("image_id") % 5 == 0, 9).otherwise(F.col("cls")).cast("string")
    words = lambda *v: F.concat_ws(" ", cls, *[c.cast("string") for c in v])
    line = F.when(F.col("image_id") % 3 == 0, words(*sides)).otherwise(words(x1, y1, x2, y1, x2, y2, x1, y2))
    lines = views.truth(spark, sf_dir).select("image_id", F.explode(F.array(line)).alias("value"))  # a generator, so that filters do not write the line out anew
    found = labels.sniffed(lines, views.N_CLASSES, by="image_id")
    return found.select("image_id", "kind", "status", "cls", *"xywh", F.coalesce(F.size("points"), F.lit(-1)).alias("n"))


# --- annotation JSON


def _documents(spark, sf_dir):
    """Box annotations of 64 images a document: rows of class 3 are crowds, every fifth is empty, all are given twice."""
    gt = views.truth(spark, sf_dir)
    bbox = F.array(F.col("x1") * 640, F.col("y1") * 480, F.when(F.col("det_id") % 5 == 0, 0.0).otherwise(F.col("w") * 640), F.col("h") * 480)
    one = F.struct(F.col("image_id"), (F.col("cls") + 1).alias("category_id"), bbox.alias("bbox"), (F.col("cls") == 3).alias("iscrowd"))
    a = gt.select(F.expr("image_id div 64").alias("d"), one.alias("a")).select("d", F.explode(F.array("a", "a")).alias("a"))
    per = a.groupBy("d").agg(F.collect_list("a").alias("annotations"))
    i = gt.select("image_id").distinct().select(F.expr("image_id div 64").alias("d"), F.struct(F.col("image_id").alias("id"), F.lit(480.0).alias("height"), F.lit(640.0).alias("width"), F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name")).alias("i"))
    return per.join(i.groupBy("d").agg(F.collect_list("i").alias("images")), "d").select("images", "annotations")


@query("SELECT DISTINCT image_id, image_id || '.jpg' AS file_name, cls, x, y, w, h FROM gt WHERE cls <> 3 AND det_id % 5 <> 0", BOXES)
def box_annotations(spark, sf_dir):
    path = scratch(spark)
    _documents(spark, sf_dir).write.json(path)
    return annotations.read_boxes(spark, path)


@query(
    """SELECT c AS category, CASE WHEN c NOT IN (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91) THEN c - 1 - len(list_filter([12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91], lambda u: u < c)) END::INTEGER AS cls, count(*) AS n
    FROM (SELECT CAST(p_partkey % 91 + 1 AS INTEGER) AS c FROM part) GROUP BY c"""
)
def class_id_maps(spark, sf_dir):
    """Category ids of parts to the 80 classes, counted; a row whose way back does not give its id is not."""
    ids = views.table(spark, sf_dir, "part").select((F.col("p_partkey") % 91 + 1).cast("int").alias("category"))
    cls = annotations.compact_class(F.col("category"))
    back = F.coalesce(annotations.category_of(cls) == F.col("category"), F.lit(True))
    return ids.where(back).groupBy("category", cls.cast("int").alias("cls")).agg(F.count("*").alias("n"))


@query(
    """SELECT DISTINCT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY first) - 1 AS INTEGER) AS cls, text, x, y, w, h FROM (
    SELECT image_id, x, y, w, h, text, min(det_id) OVER (PARTITION BY image_id, text) AS first FROM (SELECT *, CASE cls WHEN 0 THEN 'red' WHEN 1 THEN 'bold fox' WHEN 2 THEN 'fox' ELSE '' END AS text FROM gt) WHERE text <> '')""",
    BOXES,
)
def grounded_boxes(spark, sf_dir):
    """Boxes whose text is made of spans of a caption."""
    path, gt = scratch(spark), views.truth(spark, sf_dir)
    spans = F.expr("CASE cls WHEN 0 THEN array(array(0, 3)) WHEN 1 THEN array(array(4, 8), array(9, 12)) WHEN 2 THEN array(array(9, 12)) ELSE array(array(3, 4)) END")
    one = F.struct(F.col("det_id"), F.col("image_id"), (F.col("cls") + 1).alias("category_id"), F.array(F.col("x1") * 640, F.col("y1") * 480, F.col("w") * 640, F.col("h") * 480).alias("bbox"), F.lit(False).alias("iscrowd"), spans.alias("tokens_positive"))
    image = F.struct(F.col("image_id").alias("id"), F.lit(480.0).alias("height"), F.lit(640.0).alias("width"), F.lit("x.jpg").alias("file_name"), F.lit("RED Bold fox").alias("caption"))
    gt.groupBy("image_id").agg(F.array(image).alias("images"), F.sort_array(F.collect_list(one)).alias("annotations")).drop("image_id").write.json(path)
    return annotations.read_grounded(spark, path)


_SHAPED = "shaped AS (SELECT * FROM gt WHERE image_id % 4 <> 3)"


@query(
    """SELECT i.image_id % 2 = 0 AND i.image_id % 4 <> 3 AS by_name, CASE WHEN image_id % 2 = 0 THEN 'img_' ELSE 'IMG_' END || i.image_id || '.PNG' AS image, n FROM (SELECT DISTINCT image_id FROM gt) i
    LEFT JOIN (SELECT image_id, count(*) AS n FROM shaped GROUP BY 1) USING (image_id)""",
    BOXES,
    _SHAPED,
)
def labelled_images(spark, sf_dir):
    """Shape documents and a list of images: found by name, by stem in other letters, or not at all."""
    path, gt = scratch(spark), views.truth(spark, sf_dir)
    name = lambda p: F.concat(F.lit(p), F.col("image_id").cast("string"))
    image = F.concat(F.when(F.col("image_id") % 2 == 0, name("img_")).otherwise(name("IMG_")), F.lit(".PNG"))
    one = F.struct(F.get(F.array(*map(F.lit, NAMES)), F.col("cls")).alias("label"), F.array(F.array(F.col("x1") * 640, F.col("y1") * 480), F.array(F.col("x2") * 640, F.col("y2") * 480)).alias("points"))
    docs = gt.where("image_id % 4 <> 3").groupBy("image_id").agg(F.collect_list(one).alias("shapes"))
    shown = F.when(F.col("image_id") % 2 == 0, F.concat(F.lit("deep/folder/"), image)).otherwise(F.lit("elsewhere.png"))
    docs.select(name("img_").alias("stem"), shown.alias("imagePath"), F.lit(640.0).alias("imageWidth"), F.lit(480.0).alias("imageHeight"), "shapes").write.json(path)
    read = spark.read.schema(f"stem string, {annotations.SHAPES}").json(path)
    found = annotations.resolve_images(read, gt.select(image.alias("image")).distinct())
    by_name = F.coalesce(F.col("imagePath") != "elsewhere.png", F.lit(False))
    return found.select(by_name.alias("by_name"), "image", F.when(F.col("shapes").isNotNull(), F.size("shapes")).cast("long").alias("n"))


@query("SELECT image_id || '' AS image, CAST(cls AS INTEGER) AS cls, printf('%d %.8f %.8f %.8f %.8f', cls, (a + c) / 2, (b + d) / 2, c - a, d - b) AS value FROM (SELECT *, least(greatest(x1, 0), 1) AS a, least(greatest(y1, 0), 1) AS b, least(greatest(x2, 0), 1) AS c, least(greatest(y2, 0), 1) AS d FROM gt) WHERE cls < 3 AND c > a AND d > b", BOXES)
def shapes_to_lines(spark, sf_dir):
    """Shapes of known labels as lines, points cut at the image."""
    gt = views.truth(spark, sf_dir)
    one = F.struct(F.get(F.array(*map(F.lit, NAMES)), F.col("cls")).alias("label"), F.array(F.array(F.col("x1") * 640, F.col("y1") * 480), F.array(F.col("x2") * 640, F.col("y2") * 480)).alias("points"))
    docs = gt.groupBy(F.col("image_id").cast("string").alias("image")).agg(F.collect_list(one).alias("shapes"), F.lit(640.0).alias("imageWidth"), F.lit(480.0).alias("imageHeight"))
    return annotations.shape_lines(docs, NAMES[:3])


@query(
    """SELECT file, CASE WHEN row_number() OVER (ORDER BY u, file) <= greatest(floor(count(*) OVER () / 10), 1) THEN 'val' ELSE 'train' END AS split, n FROM (
    SELECT image_id || '.jpg' AS file, (('0x' || substr(md5('0 ' || image_id || '.jpg'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS u, count(*) AS n FROM gt GROUP BY image_id)""",
    BOXES,
)
def dataset_records(spark, sf_dir):
    """Dataset lines: a header and one record an image, without a val split."""
    path, gt = scratch(spark), views.truth(spark, sf_dir)
    file = F.concat(F.col("image_id").cast("string"), F.lit(".jpg"))
    one = F.array(F.col("cls").cast("double"), *_c("x y w h"))
    rows = gt.groupBy(file.alias("file")).agg(F.create_map(F.lit("boxes"), F.collect_list(one)).alias("annotations"))
    header = spark.range(1).select(F.lit("detect").alias("task"), F.create_map(F.lit("0"), F.lit(NAMES[0])).alias("class_names"))
    held = rows.select(F.lit(None).cast("string").alias("task"), F.lit(None).cast("map<string, string>").alias("class_names"), "file", F.lit("train").alias("split"), F.concat(F.lit("http://x/"), "file", F.lit("?sig=1")).alias("url"), "annotations")
    nothing = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("file", "split", "url", "annotations")]
    header.select("task", "class_names", *nothing).union(held).write.json(path)
    _, records = annotations.read_records(spark, path)
    boxes = F.size(F.element_at("annotations", F.lit("boxes"))).cast("long")
    return annotations.with_val(records).where(F.length("digest") == 64).select("file", "split", boxes.alias("n"))


@query("SELECT frame, max(CASE WHEN x BETWEEN 100 AND 400 AND y BETWEEN 50 AND 300 THEN 1 ELSE 0 END) + max(CASE WHEN x <= 320 THEN 1 ELSE 0 END)::BIGINT AS occupied, 2 - (max(CASE WHEN x BETWEEN 100 AND 400 AND y BETWEEN 50 AND 300 THEN 1 ELSE 0 END) + max(CASE WHEN x <= 320 THEN 1 ELSE 0 END))::BIGINT AS available FROM tracks GROUP BY frame", TRACKS)
def slots_from_file(spark, sf_dir):
    path = scratch(spark)
    corners = [[[100.9, 50.2], [400.5, 50.2], [400.5, 300.7], [100.9, 300.7]], [[-1.0, -1.0], [320.0, -1.0], [320.0, 481.0], [-1.0, 481.0]]]
    spark.createDataFrame([(c,) for c in corners], annotations.REGION).write.json(path)
    return zones.slots_by_file(views.tracks(spark, sf_dir), annotations.read_regions(spark, path))


# --- reports


@query("SELECT image_id, ['chipping', 'scratch', 'splash', 'spot'][cls + 1] AS name, cls AS class, round_even(conf, 5) AS confidence, round_even(x1 / 3, 5) AS x1, round_even(y1 / 7, 5) AS y1, round_even(x2 / 3, 5) AS x2, round_even(y2 / 7, 5) AS y2 FROM pred", BOXES)
def detection_summary(spark, sf_dir):
    """Summaries written as JSON lines and read back."""
    path = scratch(spark)
    out = reports.summary(views.predictions(spark, sf_dir), NAMES, 3, 7)
    reports.to_json(out).write.text(path)
    return spark.read.schema(out.schema).json(path).select("image_id", "name", "class", "confidence", "box.*")


@query(
    """SELECT vec_id AS image_id, CAST(n AS INTEGER) AS rank, 'name ' || cls AS name, cls AS class, round_even(score, 5) AS confidence FROM (SELECT vec_id, cls, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS n FROM (
    SELECT vec_id, CAST(i.range AS INTEGER) AS cls, embedding[i.range + 1]::DOUBLE AS score FROM embeddings, range(64) i)) WHERE n <= 5"""
)
def class_summaries(spark, sf_dir):
    """The five best classes of every vector, its coordinates as scores, written as CSV with a byte order mark and read back."""
    path = scratch(spark)
    scores = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("cls", "s")).withColumn("score", F.col("s").cast("double")).drop("s")
    out = reports.class_summary(scores, [f"name {i}" for i in range(64)])
    reports.write_csv(out, path, mark=True)
    return reports.read_csv(spark, path).select(*[F.col(f.name).cast(f.dataType) for f in out.schema])


@query("SELECT image_id || '' AS image_id, image_id || '.jpg' AS file_name, cls + 1 AS category_id, [round_even(640 * x1 / 3, 3), round_even(480 * y1 / 7, 3), round_even(640 * x2 / 3 - 640 * x1 / 3, 3), round_even(480 * y2 / 7 - 480 * y1 / 7, 3)] AS bbox, round_even(conf, 5) AS score FROM pred", BOXES)
def prediction_json(spark, sf_dir):
    path = scratch(spark)
    shown = views.predictions(spark, sf_dir).select("image_id", "cls", "conf", *[(F.col(c) * s / d).alias(c) for c, s, d in zip(XYXY.split(), (640, 480, 640, 480), (3, 7, 3, 7))])
    out = reports.prediction_records(shown, F.concat(F.col("image_id").cast("string"), F.lit(".jpg")), F.col("cls") + 1)
    out.write.json(path)
    return spark.read.schema(out.schema).json(path)


@query(
    """SELECT image_id, list_transform(range(1, len(e)), lambda i: e[i + 1] - e[i]) AS counts FROM (SELECT image_id, list_concat([0::BIGINT], coalesce(list(pos ORDER BY pos) FILTER (changed), []), [max(n)]) AS e FROM (
    SELECT *, count(*) OVER (PARTITION BY image_id) AS n, m <> coalesce(lag(m) OVER (PARTITION BY image_id ORDER BY pos), FALSE) AS changed FROM (SELECT image_id, det_id - 1 AS pos, cls % 2 = 1 AS m FROM boxes)) GROUP BY image_id)""",
    BOXES,
)
def mask_run_lengths(spark, sf_dir):
    """An image's boxes in order as pixels, those of odd class set."""
    pixels = views.boxes(spark, sf_dir).select("image_id", (F.col("det_id") - 1).alias("at"), (F.col("cls") % 2 == 1).alias("on"))
    return reports.run_lengths(pixels, ["image_id"])


_STEP = "steps AS (SELECT 0.5::DOUBLE AS t)"


@query(
    """SELECT kind, image_id, cls, confidence FROM (SELECT 'FN' AS kind, image_id, cls, NULL::DOUBLE AS confidence FROM gt WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = gt.image_id AND m.g_det_id = gt.det_id)
    UNION ALL SELECT 'FP', image_id, cls, round_even(conf, 4) FROM pred WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = pred.image_id AND m.p_det_id = pred.det_id))""",
    BOXES,
    PAIRS,
    _STEP,
    MATCHED,
)
def error_cases(spark, sf_dir):
    """Missed labels and wrong predictions as a CSV manifest."""
    path, hits = scratch(spark), _matched(spark, sf_dir, [0.5])
    side = lambda k: hits.select("image_id", F.col(k).alias("det_id"))
    fn = views.truth(spark, sf_dir).join(side("g_det_id"), KEY, "left_anti").select(F.lit("FN").alias("kind"), "image_id", "cls", F.lit(None).cast("double").alias("confidence"))
    fp = views.predictions(spark, sf_dir).join(side("p_det_id"), KEY, "left_anti").select(F.lit("FP").alias("kind"), "image_id", "cls", F.bround("conf", 4).alias("confidence"))
    out = fn.union(fp)
    out.write.option("header", "true").csv(path)  # as long as the data: one file a task
    return spark.read.schema(out.schema).option("header", "true").csv(path)


@query(
    """SELECT ['chipping', 'scratch', 'splash', 'spot'][cls + 1] AS class, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(ng, 0) - coalesce(tp, 0) AS fn FROM classes LEFT JOIN (SELECT cls, count(*) AS ng FROM gt GROUP BY cls) USING (cls)
    LEFT JOIN (SELECT cls, count(*) AS np FROM pred GROUP BY cls) USING (cls) LEFT JOIN (SELECT g_cls AS cls, count(*) AS tp FROM matched GROUP BY 1) USING (cls)
    UNION ALL SELECT 'all', (SELECT count(*) FROM matched), (SELECT count(*) FROM pred) - (SELECT count(*) FROM matched), (SELECT count(*) FROM gt) - (SELECT count(*) FROM matched)""",
    BOXES,
    PAIRS,
    _STEP,
    MATCHED,
)
def metrics_csv(spark, sf_dir):
    """Counts by class and in all through a CSV report."""
    path = scratch(spark)
    counts = metrics.with_total(metrics.class_counts(views.truth(spark, sf_dir), views.predictions(spark, sf_dir), _matched(spark, sf_dir, [0.5]).select("cls"), views.classes(spark)))
    name = F.when(F.col("cls") < 0, "all").otherwise(F.get(F.array(*map(F.lit, NAMES)), F.col("cls")))
    reports.write_csv(counts.select(name.alias("class"), "tp", "fp", "fn"), path)
    return reports.read_csv(spark, path).select("class", *[F.col(c).cast("long") for c in ("tp", "fp", "fn")])


@query(
    """SELECT coalesce(split, 'all') AS split, count(*) AS images, sum(c0)::BIGINT AS class_0, sum(c1)::BIGINT AS class_1, sum(c2)::BIGINT AS class_2, sum(c3)::BIGINT AS class_3 FROM (
    SELECT i.image_id, CASE WHEN i.image_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) FILTER (cls = 0) AS c0, count(*) FILTER (cls = 1) AS c1, count(*) FILTER (cls = 2) AS c2, count(*) FILTER (cls = 3) AS c3
    FROM images i LEFT JOIN gt USING (image_id) GROUP BY i.image_id) GROUP BY GROUPING SETS ((split), ())""",
    BOXES,
)
def split_manifest(spark, sf_dir):
    """A split manifest through CSV, and its totals."""
    path = scratch(spark)
    splits = views.images(spark, sf_dir).select("image_id", F.when(F.col("image_id") % 5 == 0, "val").otherwise("train").alias("split"))
    out = reports.split_manifest(splits, views.truth(spark, sf_dir), [0, 1, 2, 3])
    out.write.option("header", "true").csv(path)
    return reports.split_summary(spark.read.schema(out.schema).option("header", "true").csv(path), [0, 1, 2, 3])


@query("SELECT run, epoch, fitness, loss FROM log", TRACKS, _LOG)
def runlog_csv(spark, sf_dir):
    """A run log appended to in two calls and read with inferred types."""
    path, log = scratch(spark), _log(spark, sf_dir)
    for part in ("epoch % 2 = 0", "epoch % 2 = 1"):
        reports.write_csv(log.where(part), path, append=True)
    if reports.read_csv(spark, f"{path}/none") is not None:
        raise ValueError("a missing log reads as none")
    return reports.read_csv(spark, path).select(F.col("run").cast("long"), F.col("epoch").cast("int"), F.col("fitness").cast("double"), F.col("loss").cast("double"))


@query("SELECT run * 1000 + epoch AS iteration, CASE WHEN epoch % 3 = 0 THEN 0.0 ELSE fitness END::DOUBLE AS fitness, CASE WHEN epoch % 2 = 0 THEN loss ELSE 0.01 END::DOUBLE AS lr, 0.9::DOUBLE AS momentum FROM log", TRACKS, _LOG)
def tuning_log(spark, sf_dir):
    """Tuning records with absent values."""
    path, log = scratch(spark), _log(spark, sf_dir)
    lr = F.when(F.col("epoch") % 2 == 0, F.col("loss"))
    fitness = F.when(F.col("epoch") % 3 != 0, F.col("fitness"))
    log.select((F.col("run") * 1000 + F.col("epoch")).alias("iteration"), fitness.alias("fitness"), F.struct(lr.alias("lr")).alias("hyperparameters")).write.json(path)
    return reports.read_tuning(spark, path, {"lr": 0.01, "momentum": 0.9})
