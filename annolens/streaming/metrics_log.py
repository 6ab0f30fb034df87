"""A log of metrics that a stream appends to; a micro-batch that runs again replaces its own rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from annolens.sources.folders import scratch

KEY = "batch_id"


def append_batch(metrics: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch's rows as CSV with a header under their batch id. What an earlier attempt of the same batch left is replaced."""
    metrics.write.mode("overwrite").option("header", "true").csv(f"{path}/{KEY}={batch_id}")


def appended(stream: DataFrame, path: str, metrics: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A writer that logs ``metrics`` of every micro-batch of ``stream`` once, whatever is retried."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: append_batch(metrics(rows), batch_id, path))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All logged rows with their batch_id."""
    return spark.read.schema(f"{schema}, {KEY} long").option("header", "true").csv(path)


def from_table(source: DataFrame, by: str, metrics: Callable[[DataFrame], DataFrame], schema: str, files: int = 4) -> DataFrame:
    """Run the log over a table in ``files`` micro-batches in order of ``by``."""
    spark = source.sparkSession
    here = scratch(spark)
    source.repartitionByRange(files, by).write.parquet(f"{here}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{here}/in")
    appended(stream, f"{here}/log", metrics).option("checkpointLocation", f"{here}/state").trigger(availableNow=True).start().awaitTermination()
    return read_log(spark, f"{here}/log", schema)
