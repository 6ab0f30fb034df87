"""Annotation JSON: box annotations with an image list, shapes of labelled images, captioned boxes, dataset records, regions.

Documents are read one a line (or one a file with ``whole``) under a stated schema and exploded into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Category ids from 1 to 91 that the 80 classes leave out (fixed values).
UNUSED = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)
COCO = """images array<struct<id: long, height: double, width: double, file_name: string, caption: string>>,
annotations array<struct<image_id: long, category_id: int, bbox: array<double>, iscrowd: boolean, tokens_positive: array<array<int>>>>"""
SHAPES = "imagePath string, imageWidth double, imageHeight double, shapes array<struct<label: string, points: array<array<double>>>>"
RECORD = "type string, task string, class_names map<string, string>, file string, split string, url string, annotations map<string, array<array<double>>>"
REGION = "points array<array<double>>"


def _json(spark: SparkSession, path: str, schema: str, whole: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", str(whole).lower()).option("recursiveFileLookup", "true").json(path)


def compact_class(category: Column) -> Column:
    """Class 0..79 of a category id 1..91; null for an unused id."""
    below = F.size(F.filter(F.array(*map(F.lit, UNUSED)), lambda u: u < category))
    return F.when(~category.isin(*UNUSED) & category.between(1, 91), category - 1 - below)


def category_of(cls: Column) -> Column:
    """Category id of a class 0..79."""
    ids = [i for i in range(1, 92) if i not in UNUSED]
    return F.get(F.array(*map(F.lit, ids)), cls)


def _boxes(document: DataFrame) -> DataFrame:
    """Annotations of each document with their image: normalized boxes that are no crowd and have an area, in order.

    Images and annotations are exploded together and meet by document and image id, so work is linear in a
    document's length. Of several images of one id the last is taken; annotations of no image are left out.
    """
    types = {c: document.schema[c].dataType.elementType.simpleString() for c in ("images", "annotations")}
    none = {c: F.lit(None).cast(t) for c, t in types.items()}
    entry = lambda key, at, i, a: F.struct(key.alias("image_id"), at.alias("at"), i.alias("i"), a.alias("a"))
    images = F.transform("images", lambda i, at: entry(i["id"], at, i, none["annotations"]))
    boxes = F.transform("annotations", lambda a, at: entry(a["image_id"], at, none["images"], a))
    entries = F.flatten(F.filter(F.array(images, boxes), lambda x: x.isNotNull()))
    rows = document.select(F.monotonically_increasing_id().alias("document"), entries.alias("e")).select("document", F.explode("e").alias("e")).select("document", "e.*")
    image = F.max_by("i", F.when(F.col("i").isNotNull(), F.col("at"))).over(Window.partitionBy("document", "image_id"))
    met = rows.where(F.col("image_id").isNotNull()).withColumn("i", image)
    b = lambda k: F.get("a.bbox", F.lit(k))
    shaped = met.where(F.col("a").isNotNull() & F.col("i").isNotNull() & ~F.coalesce("a.iscrowd", F.lit(False))).select(
        "at", "image_id", "i.file_name", "i.caption", "a.category_id", "a.tokens_positive",
        ((b(0) + b(2) / 2) / F.col("i.width")).alias("x"), ((b(1) + b(3) / 2) / F.col("i.height")).alias("y"), (b(2) / F.col("i.width")).alias("w"), (b(3) / F.col("i.height")).alias("h"),
    )
    return shaped.where("w > 0 AND h > 0")


def read_boxes(spark: SparkSession, path: str, whole: bool = False, compact: bool = False) -> DataFrame:
    """(image_id, file_name, cls, x, y, w, h): normalized boxes; crowds, empty boxes and repeated rows are left out.

    Classes are category ids less one, or the 80 classes with ``compact``.
    """
    cls = compact_class(F.col("category_id")) if compact else F.col("category_id") - 1
    return _boxes(_json(spark, path, COCO, whole)).select("image_id", "file_name", cls.alias("cls"), "x", "y", "w", "h").distinct()


def read_grounded(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(image_id, cls, text, x, y, w, h): a box's text is its caption's spans; classes of an image are numbered as texts appear."""
    spans = F.transform("tokens_positive", lambda t: F.substring(F.col("caption"), F.get(t, F.lit(0)) + 1, F.get(t, F.lit(1)) - F.get(t, F.lit(0))))
    named = _boxes(_json(spark, path, COCO, whole)).withColumn("text", F.trim(F.lower(F.array_join(spans, " ")))).where("text <> ''")
    first = named.withColumn("first", F.min("at").over(Window.partitionBy("image_id", "text")))
    cls = F.dense_rank().over(Window.partitionBy("image_id").orderBy("first")) - 1
    return first.select("image_id", cls.alias("cls"), "text", "x", "y", "w", "h").distinct()


def read_shapes(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(file, stem, imagePath, imageWidth, imageHeight, shapes) of every document."""
    file = F.col("_metadata.file_path")
    df = _json(spark, path, SHAPES, whole)
    return df.select(file.alias("file"), F.regexp_extract(file, r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"), *df.columns)


def resolve_images(documents: DataFrame, images: DataFrame, stem: str = "stem") -> DataFrame:
    """Images (image) with their document (null: background): the one whose imagePath has the image's name, else the one of the same stem without regard to case."""
    name = F.regexp_extract("imagePath", r"([^/\\\\]*)$", 1)
    d = documents.withColumn("__name", name).withColumn("__stem", F.lower(stem))
    i = images.withColumn("__stem", F.lower(F.regexp_extract("image", r"^(.*?)(?:\.[^.]*)?$", 1)))
    by_name = d.join(i.select("image"), F.col("__name") == F.col("image"))
    rest = d.join(i.select("image"), F.col("__name") == F.col("image"), "left_anti").join(i, "__stem")
    found = by_name.select("image", *documents.columns).union(rest.select("image", *documents.columns))
    return images.select("image").join(found, "image", "left")


def shape_lines(resolved: DataFrame, classes: list[str], polygons: bool = False) -> DataFrame:
    """(image, cls, value): label lines of 8 decimals of shapes with a known label, points cut at the image, boxes with an area or polygons of three points."""
    from annolens.sources.labels import line

    ids = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i)])
    s = resolved.where("imageWidth > 0 AND imageHeight > 0").select("image", "imageWidth", "imageHeight", F.explode("shapes").alias("s"))
    clamp = lambda v, high: F.least(F.greatest(v, F.lit(0.0)), high)
    point = lambda p: F.struct(clamp(F.get(p, F.lit(0)), F.col("imageWidth")).alias("x"), clamp(F.get(p, F.lit(1)), F.col("imageHeight")).alias("y"))
    known = s.select("image", "imageWidth", "imageHeight", ids[F.trim("s.label")].alias("cls"), F.transform("s.points", point).alias("p")).where(F.col("cls").isNotNull())
    if polygons:
        flat = F.flatten(F.transform("p", lambda q: F.array(q["x"] / F.col("imageWidth"), q["y"] / F.col("imageHeight"))))
        text = F.array_join(F.transform(flat, lambda v: F.format_string("%.8f", v)), " ")
        return known.where(F.size("p") >= 3).select("image", "cls", F.concat_ws(" ", F.col("cls").cast("string"), text).alias("value"))
    x, y = F.transform("p", lambda q: q["x"]), F.transform("p", lambda q: q["y"])
    boxed = known.where(F.size("p") >= 2).select("image", "cls", "imageWidth", "imageHeight", F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2")).where("x2 > x1 AND y2 > y1")
    value = line(F.col("cls"), F.expr("(x1 + x2) / 2 / imageWidth"), F.expr("(y1 + y2) / 2 / imageHeight"), F.expr("(x2 - x1) / imageWidth"), F.expr("(y2 - y1) / imageHeight"), digits=8)
    return boxed.select("image", "cls", value.alias("value"))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The header record (task, class_names) and the image records (file, split, url, annotations, digest) of a dataset's lines.

    A record's digest is the sha256 of its content without the query string of its address.
    """
    every = spark.read.schema(RECORD).json(path)
    content = F.to_json(F.struct("file", "split", F.regexp_replace("url", r"\?.*$", "").alias("url"), "annotations"))
    return every.where("file IS NULL").select("task", "class_names"), every.where("file IS NOT NULL").select("file", "split", "url", "annotations", F.sha2(content, 256).alias("digest"))


def with_val(records: DataFrame) -> DataFrame:
    """Image records as they are if any is of split val; else a tenth of the training ones, at least one, chosen by hash, become val."""
    from annolens.operators.datasets import hash_rank

    if not records.where("split = 'val'").isEmpty():
        return records
    train = records.where("split = 'train'")
    if train.limit(2).count() < 2:
        raise ValueError("two training images are needed to make a val split")
    val = F.col("__r") <= F.greatest(F.floor(F.col("__n") / 10), F.lit(1))
    moved = hash_rank(train, "file").withColumn("split", F.when(val, "val").otherwise("train")).select(*records.columns)
    return moved.union(records.where("split <> 'train'"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(region, points): regions in the order of their text, with whole-pixel corners. Regions are few."""
    df = spark.read.schema(REGION).json(path)
    points = F.transform("points", lambda p: F.struct(F.get(p, F.lit(0)).cast("int").cast("double").alias("x"), F.get(p, F.lit(1)).cast("int").cast("double").alias("y")))
    return df.select(F.md5(F.to_json(F.struct("points"))).alias("region"), points.alias("points"))
