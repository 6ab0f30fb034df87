"""Sinks: detection summaries, prediction JSON, run-length masks, oriented boxes, CSV reports, and run logs both ways."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolens.functions import strings


#: Fixed value: the mark that spreadsheet programs take as a sign of UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def write_csv(rows: DataFrame, path: str, append: bool = False, mark: bool = False) -> None:
    """CSV with a header of the columns in order; a report is small and goes to one file, a log grows by one file a call.

    With ``mark`` the file begins with a byte order mark.
    """
    named = rows.withColumnRenamed(rows.columns[0], BYTE_ORDER_MARK + rows.columns[0]) if mark else rows
    named.coalesce(1).write.mode("append" if append else "errorifexists").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A run log with the types its values suggest; None where there is none."""
    try:
        read = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
        return read.withColumnRenamed(read.columns[0], read.columns[0].removeprefix(BYTE_ORDER_MARK)) if read.columns else read
    except AnalysisException:
        return None


def summary(found: DataFrame, names: list[str], width: float = 1, height: float = 1, digits: int = 5) -> DataFrame:
    """Per detection: image_id, name, class, confidence and the struct box, divided by the image's size and rounded."""
    name = F.get(F.array(*map(F.lit, names)), F.col("cls"))
    sides = {"x1": width, "y1": height, "x2": width, "y2": height}
    box = F.struct(*[F.bround(F.col(c) / s, digits).alias(c) for c, s in sides.items()])
    return found.select("image_id", name.alias("name"), F.col("cls").alias("class"), F.bround("conf", digits).alias("confidence"), box.alias("box"))


def class_summary(scores: DataFrame, names: list[str], k: int = 5, digits: int = 5) -> DataFrame:
    """(image_id, rank, name, class, confidence): the ``k`` classes of largest score of each image (image_id, cls, score), ties by class."""
    n = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "cls"))
    name = F.get(F.array(*map(F.lit, names)), F.col("cls"))
    return scores.withColumn("rank", n).where(F.col("rank") <= k).select("image_id", "rank", name.alias("name"), F.col("cls").alias("class"), F.bround("score", digits).alias("confidence"))


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def prediction_records(found: DataFrame, file: Column, category: Column, **more: Column) -> DataFrame:
    """image_id (whole-number stems as numbers), file_name, category_id, bbox (left, top, width, height to 3 decimals) and score (to 5)."""
    stem = F.regexp_extract(file, r"^(.*?)(?:\.[^.]*)?$", 1)
    sides = (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return found.select(strings.image_key(stem).alias("image_id"), file.alias("file_name"), category.alias("category_id"), F.array(*[F.bround(v, 3) for v in sides]).alias("bbox"), F.bround("conf", 5).alias("score"), *[c.alias(n) for n, c in more.items()])


def keypoint_records(found: DataFrame, file: Column, category: Column, keypoints: Column) -> DataFrame:
    """``prediction_records`` with ``keypoints``: x, y and visibility (or score) of every point of an array, one after another."""
    flat = F.flatten(F.transform(keypoints, lambda k: F.array(k["x"], k["y"], k["v"].cast("double"))))
    held = found.withColumn("__k", flat)
    return prediction_records(held, file, category, keypoints=F.col("__k"))


def rotated_records(found: DataFrame, file: Column, category: Column) -> DataFrame:
    """image_id, file_name, category_id, score, rbox (x, y, w, h, angle) and poly (four corners) to 3 decimals, of rotated boxes (x, y, w, h, r)."""
    from annolens.functions.geometry import rotated_corners

    five = [F.col(c) for c in ("x", "y", "w", "h", "r")]
    stem = F.regexp_extract(file, r"^(.*?)(?:\.[^.]*)?$", 1)
    poly = F.flatten(F.transform(rotated_corners(*five), lambda p: F.array(F.bround(p["x"], 3), F.bround(p["y"], 3))))
    return found.select(strings.image_key(stem).alias("image_id"), file.alias("file_name"), category.alias("category_id"), F.bround("conf", 5).alias("score"), F.array(*[F.bround(v, 3) for v in five]).alias("rbox"), poly.alias("poly"))


def run_lengths(pixels: DataFrame, keys: list[str], at: str = "at", on: str = "on") -> DataFrame:
    """(keys, counts): lengths of the runs of a mask's pixels in order, the first of zeros, which may be 0 long.

    ``pixels`` has a row for each pixel, numbered by ``at`` from 0. Runs are the gaps between changes.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    starts = pixels.withColumn("__before", F.coalesce(F.lag(on).over(w), F.lit(False))).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    changes = starts.where(F.col(on) != F.col("__before"))
    ends = starts.groupBy(*keys).agg(F.first("__n").alias("n"))
    held = changes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(at).cast("long"))).alias("c"))
    edges = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("c", F.array().cast("array<long>")), F.array(F.col("n")))
    both = ends.join(held, keys, "left").withColumn("e", edges)
    return both.select(*keys, F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.get("e", i) - F.get("e", i - 1)).alias("counts"))


def oriented_lines(found: DataFrame, image: Column) -> DataFrame:
    """(cls, value): `image confidence x1 y1 ... x4 y4` for each rotated box (x, y, w, h, r in pixels), to be written by class."""
    from annolens.functions.geometry import rotated_corners

    c = found.withColumn("c", rotated_corners(*(F.col(k) for k in ("x", "y", "w", "h", "r"))))
    flat = [F.format_string("%.3f", F.bround(F.col("c")[i][k], 3)) for i in range(4) for k in "xy"]
    return c.select("cls", F.concat_ws(" ", image, F.bround("conf", 5).cast("string"), *flat).alias("value"))


def split_manifest(splits: DataFrame, labels: DataFrame, classes: list[int]) -> DataFrame:
    """(image_id, split, one count for each class) of every image."""
    n = labels.groupBy("image_id").agg(*[F.sum((F.col("cls") == c).cast("long")).alias(f"class_{c}") for c in classes])
    return splits.join(n, "image_id", "left").na.fill(0, [f"class_{c}" for c in classes])


def split_summary(manifest: DataFrame, classes: list[int]) -> DataFrame:
    """(split, images, one total for each class) with a row `all`."""
    sums = [F.count("*").alias("images"), *[F.sum(f"class_{c}").alias(f"class_{c}") for c in classes]]
    return manifest.groupBy("split").agg(*sums).unionByName(manifest.agg(*sums).withColumn("split", F.lit("all")))


def read_tuning(spark: SparkSession, path: str, genes: dict[str, float]) -> DataFrame:
    """(iteration, fitness, one column for each of ``genes``) of a tuning log; absent values are the defaults, an absent fitness 0."""
    kinds = ", ".join(f"`{g}`: double" for g in genes)
    df = spark.read.schema(f"iteration long, fitness double, hyperparameters struct<{kinds}>").json(path)
    return df.select("iteration", F.coalesce("fitness", F.lit(0.0)).alias("fitness"), *[F.coalesce(f"hyperparameters.{g}", F.lit(float(v))).alias(g) for g, v in genes.items()])
