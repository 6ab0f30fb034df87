"""Domain views over the supplied tables, in Spark and, with equal results, in SQL.

boxes: lineitem rows as boxes with dyadic coordinates (truth if line number is 3 or less).
tracks: events as tracked points. images: orders. Row numbers are taken within an image or
a track, never over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolens.functions.geometry import xywh_to_xyxy
from annolens.operators.datasets import box_columns

N_CLASSES = 4
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    n = F.row_number().over(Window.partitionBy("image_id").orderBy(*ORDER))
    raw = table(spark, sf_dir, "lineitem").withColumn("image_id", F.expr("l_orderkey div 8")).withColumn("det_id", n)
    shaped = raw.select(
        "image_id",
        "det_id",
        (F.col("l_suppkey") % N_CLASSES).cast("int").alias("cls"),
        ((F.col("l_partkey") % 4) / 4.0).alias("x"),
        ((F.expr("l_partkey div 4") % 4) / 4.0).alias("y"),
        ((2 + q % 4) / 8.0).alias("w"),
        ((2 + F.expr("cast(l_quantity as int) div 4") % 4) / 8.0).alias("h"),
        ((F.round(F.col("l_extendedprice") * 100).cast("long") % 1024) / 1024.0).alias("conf"),
        (F.col("l_linenumber") <= 3).alias("is_gt"),
    )
    return shaped.select("*", *box_columns(xywh_to_xyxy(*(F.col(c) for c in "xywh"))))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("is_gt").drop("is_gt")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("NOT is_gt").drop("is_gt")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 8").alias("image_id")).distinct()


def classes(spark: SparkSession) -> DataFrame:
    return spark.range(N_CLASSES).select(F.col("id").cast("int").alias("cls"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.lit(0).alias("stream"),
        F.col("user_id").alias("track_id"),
        frame.alias("frame"),
        (F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long") % 640).cast("double").alias("x"),
        (F.coalesce(k, F.lit(0)) * 7 % 480).cast("double").alias("y"),
        F.col("event_type").alias("cls"),
    )


BOXES = """boxes AS (
  SELECT *, x - w / 2 AS x1, y - h / 2 AS y1, x + w / 2 AS x2, y + h / 2 AS y2 FROM (
    SELECT l_orderkey // 8 AS image_id,
      row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS det_id,
      CAST(l_suppkey % 4 AS INTEGER) AS cls, (l_partkey % 4) / 4.0::DOUBLE AS x, ((l_partkey // 4) % 4) / 4.0::DOUBLE AS y,
      (2 + CAST(l_quantity AS INTEGER) % 4) / 8.0::DOUBLE AS w, (2 + (CAST(l_quantity AS INTEGER) // 4) % 4) / 8.0::DOUBLE AS h,
      (CAST(round(l_extendedprice * 100) AS BIGINT) % 1024) / 1024.0::DOUBLE AS conf, l_linenumber <= 3 AS is_gt FROM lineitem)),
gt AS (SELECT * FROM boxes WHERE is_gt), pred AS (SELECT * FROM boxes WHERE NOT is_gt),
images AS (SELECT DISTINCT o_orderkey // 8 AS image_id FROM orders), classes AS (SELECT CAST(range AS INTEGER) AS cls FROM range(4))"""

#: All overlapping truth-prediction pairs of an image with their IoU.
PAIRS = """pairs AS (
  SELECT image_id, g_cls, p_cls, g_det_id, p_det_id, p_conf, i / (ga + pa - i) AS iou FROM (
    SELECT g.image_id, g.cls AS g_cls, p.cls AS p_cls, g.det_id AS g_det_id, p.det_id AS p_det_id, p.conf AS p_conf, g.w * g.h AS ga, p.w * p.h AS pa,
      (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS i
    FROM gt g JOIN pred p ON g.image_id = p.image_id AND g.x1 < p.x2 AND p.x1 < g.x2 AND g.y1 < p.y2 AND p.y1 < g.y2))"""

#: Validator matching at the thresholds of ``steps`` (t).
MATCHED = """best AS (SELECT * FROM pairs JOIN steps ON iou >= t WHERE g_cls = p_cls
  QUALIFY row_number() OVER (PARTITION BY image_id, t, p_det_id ORDER BY iou DESC, g_det_id DESC) = 1),
matched AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY image_id, t, g_det_id ORDER BY p_conf DESC, p_det_id) = 1)"""

TRACKS = """tracks AS (
  SELECT 0 AS stream, user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
    CAST(CAST(round(coalesce(value, 0) * 100) AS BIGINT) % 640 AS DOUBLE) AS x,
    CAST(coalesce(CAST(props ->> '$.k' AS BIGINT), 0) * 7 % 480 AS DOUBLE) AS y, event_type AS cls FROM events)"""


def sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def registry():
    """An empty table of queries, one of their SQL, and the decorator that fills both (text None: no SQL)."""
    queries, oracle = {}, {}

    def query(text: str | None, *ctes: str):
        def register(f):
            queries[f.__name__] = f
            if text:
                oracle[f.__name__] = sql(text, *ctes)
            return f

        return register

    return queries, oracle, query
