"""What makes work or memory grow: plans, code sizes, files, and the steps that took the place of others."""

import random
import re

import annolens.plans.catalogue as catalogue
from annolens.functions import geometry as geo
from annolens.operators import datasets, grid, raster
from annolens.sources import labels
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
POINTS = "array<struct<x: double, y: double>>"


def plan(df, kind="extended"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), kind)


def rings(seed, n, most=9):
    rng = random.Random(seed)
    return [[(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(rng.randrange(0, most))] for _ in range(n)]


def test_polygon_masks_has_one_python_step(spark):
    """F2"""
    physical = plan(catalogue.QUERIES["polygon_masks"](spark, SMALL)).split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1
    df = spark.createDataFrame([(i, 0, p) for i, p in enumerate(rings(1, 40))], f"image_id int, det_id int, points {POINTS}")
    assert sorted(raster.through_counts(df, 40, 30).collect()) == sorted(raster.measured(raster.masks_of(raster.run_counts(raster.masks(df, 40, 30), 40, 30), 30)).collect())


def test_smallest_rectangle_is_no_lambda(spark):
    """and odd rows give nulls."""
    rows = [(0, None), (1, []), (2, [(0.0, 0.0), (1.0, float("nan"))]), (3, [(0.0, 0.0), (1.0, None)]), (4, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0)])]
    df = spark.createDataFrame(rows, f"i int, points {POINTS}").select("i", geo.smallest_rectangle(F.col("points")).alias("r"))
    assert "lambda" not in plan(df)
    assert {r.i: r.r and (r.r.w, r.r.h) for r in df.collect()} == {0: (None, None), 1: (None, None), 2: (None, None), 3: (None, None), 4: (4.0, 2.0)}


def test_pairs_by_keys_and_by_cells(spark):
    """images of few boxes go without cells, others by cells, with the same pairs."""
    rng = random.Random(3)
    rows = [(k % 7 % 4, k, float(x := rng.randrange(60)), float(y := rng.randrange(60)), float(x + rng.randrange(1, 20)), float(y + rng.randrange(1, 20))) for k in range(140)]
    df = spark.createDataFrame(rows, "image_id long, k long, x1 double, y1 double, x2 double, y2 double")
    pairs = lambda few: sorted((r.image_id, r.a_k, r.b_k) for r in grid.grid_pairs(df, df, ["image_id"], 7.0, few).collect())
    assert pairs(0) == pairs(30) == pairs(1000)


def test_shares_equal_clipped_areas(spark):
    """F10"""
    objects = spark.createDataFrame([(i % 3, i, p) for i, p in enumerate(rings(5, 60))] + [(0, 99, [(1.0, 1.0), (2.0, None), (2.0, 2.0)])], f"image_id int, det_id int, points {POINTS}").withColumn("cls", F.lit(0))
    windows = spark.range(3).select(F.col("id").cast("int").alias("image_id"), *[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (5.0, 5.0, 45.0, 40.0))])
    got = grid.window_objects(windows, objects, 0.5, cell=20.0)
    assert "lambda" not in plan(got).split("b_points")[0]
    share = geo.polygon_area(geo.clip_polygon(F.col("points"), F.lit(5.0), F.lit(5.0), F.lit(45.0), F.lit(40.0))) / geo.polygon_area(F.col("points"))
    wanted = {r.det_id: round(r.s, 9) for r in objects.where("size(points) > 2 AND det_id < 99").select("det_id", share.alias("s")).where("s >= 0.5").collect()}
    assert {r.det_id: round(r.iof, 9) for r in got.collect()} == wanted and len(wanted) > 5


def test_numbers_are_printed_as_printf_does(spark):
    """F16: the exact value decides, not its shortest decimal text."""
    values = [3.5e-6, 0.5, -2.5, -1e-9, -0.0, 123456789.123, 1e20, 1e-320]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(labels.line(F.lit(7), F.col("v"), F.col("v"))).collect()]
    text = lambda v, f: re.sub("^-(0(?:\\.0+)?)$", "\\1", f % v)
    assert got == [f"7 {text(v, '%.6f')} {text(v, '%.6f')}" for v in values]
    assert [r[0] for r in df.select(labels.line(F.lit(7), F.col("v"), digits=None)).collect()] == [f"7 {text(v, '%g')}" for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),)], "v double")
    assert [r[0] for r in odd.select(labels.line(F.lit(None), F.col("v"))).collect()] == ["null", "NaN", "-Infinity"]


def test_one_class_is_written_by_many_tasks(spark, tmp_path):
    """F18"""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40k")
    try:
        rows = spark.range(40000, numPartitions=8).select(F.sha2(F.col("id").cast("string"), 256).alias("value"), F.lit(1).alias("cls"))
        labels.write_lines(rows, str(tmp_path / "out"), "cls")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "out" / "cls=1").glob("*.txt"))) > 2 and spark.read.text(str(tmp_path / "out")).count() == 40000


def test_keypoint_similarity_is_no_lambda(spark):
    """F19"""
    assert "aggregate" not in plan(catalogue.QUERIES["oks_pairs"](spark, SMALL))


def test_rotation_is_compiled(spark):
    """a method of more than 8000 bytes stays interpreted."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(catalogue.QUERIES["label_rotate"](spark, SMALL), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000


def test_windows_do_not_meet(spark):
    """F22"""
    images = spark.createDataFrame([(1, 100, 40), (2, 30, 30), (3, 640, 480), (4, None, 10)], "image_id int, width int, height int")
    found = datasets.window_grid(images, 64, 16)
    assert "Window" not in plan(found)
    assert sorted((r.image_id, r.x1, r.y1) for r in found.where("image_id < 3").collect()) == [(1, 0, 0), (1, 36, 0), (2, 0, 0)]


def test_sniffed_rows_meet_as_numbers(spark):
    """no aggregate over points."""
    lines = spark.createDataFrame([("a", "0 0 0 1 0 1 1"), ("a", "0.4 0 0 1.0 0 1 -0.0"), ("a", "0.6 0 0 1.0 0 1 1")], "path string, value string")
    found = labels.sniffed(lines, 2)
    assert "Aggregate" not in plan(found)
    assert sorted((r.cls, r.points[2].y) for r in found.collect()) == [(0, 0.0), (0, 1.0)]


def test_runs_and_stems_by_parts_of_the_path(spark, tmp_path):
    """no pattern is tried on the path of every line."""
    for at in ("x_conf0p5/labels/a.b.txt", "x_conf0p5/labels/none", "x_conf0p5/labels/deep/c.txt"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("1 2 3\n")
    found = labels.runs(spark, str(tmp_path))
    assert "regexp_extract(file_path" not in plan(labels.read_lines(spark, str(tmp_path))) and "regexp_extract(_metadata" not in plan(labels.read_lines(spark, str(tmp_path)))
    assert sorted((r.run, r.threshold, r.stem) for r in found.collect()) == [("", float("inf"), "c"), ("x_conf0p5", 0.5, "a.b"), ("x_conf0p5", 0.5, "none")]
