"""Label text: one line for each object, `class x y w h [confidence]` or `class x1 y1 x2 y2 ...`.

Lines are read as (path, stem, value); the parsers differ in what they do with lines of another form.
Writers make the lines as a column and leave files to Spark: one folder for each value of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolens.functions import strings


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, stem, value) of every line below ``path``, which may hold globs."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    # without patterns, which would be tried anew on the whole path of every line
    name = F.substring_index(file, "/", -1)
    bare = F.when(F.contains(name, F.lit(".")), F.left(name, F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)).otherwise(name)
    return lines.select(file.alias("path"), bare.alias("stem"), "value")


def _fields(lines: DataFrame) -> DataFrame:
    """Add ``f``, the blank-separated fields; none for a blank line."""
    odd = F.col("value").rlike(r"[\t\n\x0B\f\r]|  ")  # most lines have single blanks only
    trimmed = F.trim(F.when(odd, F.regexp_replace("value", r"\s+", " ")).otherwise(F.col("value")))
    return lines.withColumn("f", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " ")))


def _numbers() -> Column:
    return F.transform(F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0))), lambda x: x.try_cast("double"))


def _box(n: Column) -> Column:
    """A struct x, y, w, h, of four numbers or around a polygon."""
    at = lambda k: F.filter(n, lambda x, i: i % 2 == k)
    x1, x2, y1, y2 = F.array_min(at(0)), F.array_max(at(0)), F.array_min(at(1)), F.array_max(at(1))
    polygon = ((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)
    return F.struct(*[F.when(F.size(n) == 4, F.get(n, F.lit(i))).otherwise(p).alias(c) for i, (c, p) in enumerate(zip("xywh", polygon))])


def _rows(lines: DataFrame, prediction: bool) -> DataFrame:
    cls = F.get("f", F.lit(0)).try_cast("double").cast("int").alias("cls")
    keep = [c for c in lines.columns if c not in ("value", "f", "n")]
    if prediction:
        parts = [F.get("n", F.lit(i)).alias(c) for i, c in enumerate("xywh")]
        return lines.select(*keep, cls, *parts, F.coalesce(F.get("n", F.lit(4)), F.lit(1.0)).alias("conf"))
    return lines.withColumn("b", _box(F.col("n"))).select(*keep, cls, "b.*")


def strict(lines: DataFrame, prediction: bool = False) -> DataFrame:
    """cls, x, y, w, h[, conf] of every line; a line of fewer than five fields, with a field that is no number, or with an odd polygon ends the job."""
    held = _fields(lines).withColumn("n", _numbers())
    short = F.size("f") < 5
    text = F.exists("n", lambda x: x.isNull()) | F.get("f", F.lit(0)).try_cast("double").isNull()
    odd = F.lit(False) if prediction else ~((F.size("n") == 4) | ((F.size("n") >= 6) & (F.size("n") % 2 == 0)))
    message = F.concat(F.lit("unsupported label line: "), F.col("value"))
    return _rows(held.withColumn("n", F.when(short | text | odd, F.raise_error(message)).otherwise(F.col("n"))), prediction)


def lenient(lines: DataFrame, prediction: bool = False) -> DataFrame:
    """The same; lines of fewer than five fields are left out."""
    return _rows(_fields(lines).where(F.size("f") >= 5).withColumn("n", _numbers()), prediction)


def five_fields(lines: DataFrame) -> DataFrame:
    """Boxes of the lines of exactly five fields; others are left out."""
    return _rows(_fields(lines).where(F.size("f") == 5).withColumn("n", _numbers()), False)


def sniffed(lines: DataFrame, n_classes: int, keypoints: tuple[int, int] | None = None, by: str = "path") -> DataFrame:
    """Rows of label files of unknown kind: ``by``, kind, status, and cls, x, y, w, h, points of each distinct row of a sound file.

    A file with a line of more than six fields holds polygons, given as points with the box around them, else boxes;
    beside a polygon, four numbers are two points.
    With ``keypoints`` (number, 2 or 3 values each) every line is a box and its points, which have v = 0 where
    two values are given and one of them is below 0. One line of another length, a word that is no number, a
    class that is not among ``n_classes``, or a value below -0.01 or a coordinate above 1.01 makes the whole file corrupt,
    which then has one row without values.
    """
    whole = Window.partitionBy(by)
    f = _fields(lines).where(F.size("f") > 0)
    number = F.transform("f", lambda x: x.try_cast("double"))
    f = f.withColumn("n", number).withColumn("polygons", F.max(F.size("f")).over(whole) > 6 if keypoints is None else F.lit(False))
    size, cls = F.size("n"), F.get("n", F.lit(0))
    values = F.slice("n", F.lit(2), F.greatest(size - 1, F.lit(0)))
    if keypoints:
        count, width = keypoints
        fits, coordinates = size == 5 + count * width, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(values, 5 + i * width, F.lit(2))))
    else:
        fits, coordinates = F.when(F.col("polygons"), (size >= 3) & (size % 2 == 1)).otherwise(size == 5), values
    sound = fits & ~F.exists("n", lambda x: x.isNull()) & (cls >= 0) & (cls < n_classes) & ~F.exists("n", lambda x: x < -0.01) & ~F.exists(coordinates, lambda x: x > 1.01)
    checked = f.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("status", F.when(F.min("ok").over(whole), "found").otherwise("corrupt"))
    kind = F.lit("keypoints") if keypoints else F.when(F.col("polygons"), "polygons").otherwise("boxes")
    none = F.lit(None).cast("array<struct<x: double, y: double, v: int>>")
    if keypoints:
        at = lambda i, k: F.get(values, 4 + i * width + k)
        seen = lambda i: at(i, 2).cast("int") if width == 3 else F.when((at(i, 0) < 0) | (at(i, 1) < 0), 0).otherwise(1)
        points = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), seen(i).alias("v")))
        box = _box(F.slice(values, 1, 4))
    else:
        points = F.when(F.col("polygons"), F.transform(F.sequence(F.lit(0), ((size - 1) / 2).cast("int") - 1), lambda i: F.struct(F.get(values, 2 * i).alias("x"), F.get(values, 2 * i + 1).alias("y"), F.lit(1).alias("v")))).otherwise(none)
        box = F.when(F.col("polygons"), _box(F.concat(values, values))).otherwise(_box(values))  # twice, so that two points are no box
    # equal rows of a file are one; they meet as plain numbers (a corrupt file's as none), which take less room than points
    good = F.col("status") == "found"
    plain = checked.select(by, "polygons", "status", F.when(good, cls.cast("int")).alias("cls"), F.when(good, F.transform(F.concat(F.array(F.lit(0.0)), values), lambda x: x + 0.0)).alias("n"))
    once = plain.withColumn("__r", F.row_number().over(Window.partitionBy(by, "cls", "n").orderBy(F.lit(0)))).where("__r = 1")
    rows = once.select(by, kind.alias("kind"), "status", "cls", F.when(good, box).alias("b"), F.when(good, points).otherwise(none).alias("points"))
    return rows.select(by, "kind", "status", "cls", "b.*", "points")


def class_totals(lines: DataFrame) -> DataFrame:
    """(cls, n) over lines that are not blank; one that has not five fields ends the job."""
    held = _fields(lines).where(F.size("f") > 0)
    wrong = F.raise_error(F.concat(F.lit("a label line has five fields: "), F.col("value")))
    return held.groupBy(F.when(F.size("f") == 5, F.get("f", F.lit(0)).cast("double").cast("int")).otherwise(wrong).alias("cls")).agg(F.count("*").alias("n"))


def oriented(lines: DataFrame, classes: dict[str, int]) -> DataFrame:
    """(stem, cls, x1, y1 ... x4, y4) of lines of eight coordinates and a class name; lines of fewer than nine fields are left out, unknown names end the job."""
    names = F.create_map(*[F.lit(v) for kv in classes.items() for v in kv])
    held = _fields(lines).where(F.size("f") >= 9)
    name = F.get("f", F.lit(8))
    cls = F.coalesce(names[name], F.raise_error(F.concat(F.lit("unknown class: "), name)))
    keep = [c for c in lines.columns if c != "value"]
    return held.select(*keep, cls.alias("cls"), *[F.get("f", F.lit(i)).cast("double").alias(f"{'xy'[i % 2]}{i // 2 + 1}") for i in range(8)])


def runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, threshold, stem, value): lines of the ``labels`` folders of runs named ``*conf*``."""
    lines = read_lines(spark, f"{root}/*conf*/labels")
    part = lambda k: F.substring_index(F.substring_index("path", "/", -k), "/", 1)
    run = F.when(part(2) == "labels", part(3)).otherwise("")
    return lines.select(run.alias("run"), strings.threshold_of(run).alias("threshold"), "stem", "value")


def line(cls: Column, *numbers: Column, digits: int | None = 6) -> Column:
    """A label line with ``digits`` decimals, or six significant digits for None."""
    text = [strings.numbers(list(numbers), 6 if digits is None else digits, significant=digits is None)] if numbers else []
    return F.concat_ws(" ", cls.cast("string"), *text)


def write_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Write the column ``value`` as text, in one folder for each value of ``by``; rows of one value are together unless they are many."""
    if by is None:
        rows.select("value").write.text(path)
    else:
        rows.select("value", by).hint("rebalance", by).write.partitionBy(by).text(path)


def class_folders(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """(cls, path, length, ok) of the files in one folder for each class; an empty file is not ok. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(f"{root}/*/*").select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("cls"), "path", "length", (F.col("length") > 0).alias("ok"))
