"""Line crossings of tracked points on a stream, with one state for each track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.sources.folders import scratch

STATE = "x double, frame_key string, counted boolean"
OUT = "track_id long, cls string, direction string"


def crossings(points: DataFrame, line_x: float) -> DataFrame:
    """A row (track_id, cls, direction) when a track first meets the vertical line x = ``line_x``; touching counts.

    ``points`` is a stream of track_id, order_key, x, cls. Within a micro-batch points are taken by
    order_key; a point not after the track's last one is late and dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, seen, counted = state.get if state.exists else (None, "", False)
        rows = pd.concat(list(batches)).sort_values("order_key")
        out = []
        for r in rows.itertuples():
            if r.order_key <= seen:
                continue
            if not counted and last is not None and (last - line_x) * (r.x - line_x) <= 0:
                out.append((key[0], r.cls, "IN" if r.x > last else "OUT"))
                counted = True
            last, seen = r.x, r.order_key
        state.update((last, seen, counted))
        yield pd.DataFrame(out, columns=["track_id", "cls", "direction"])

    return points.groupBy("track_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def points_of(events: DataFrame) -> DataFrame:
    x = (F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long") % 640).cast("double")
    order = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return events.select(F.col("user_id").alias("track_id"), order.alias("order_key"), x.alias("x"), F.col("event_type").alias("cls"))


def from_table(spark: SparkSession, path: str, line_x: float) -> DataFrame:
    """Run the stream over a Parquet table to its end and count crossings by class and direction."""
    folder, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    here = scratch(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    found = crossings(points_of(stream), line_x)
    run = found.writeStream.format("parquet").option("path", f"{here}/out").option("checkpointLocation", f"{here}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{here}/out").groupBy("cls", "direction").agg(F.count("*").alias("n"))
