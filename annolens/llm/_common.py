"""Helpers shared by the corpus operators: tables, session settings, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = str(8 << 20)
HOT_SHARE, LEAST_HOT = 1000, 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every operator relies on; none changes a result.

    They hold for later queries of the session too. Arrow batches are kept to 512
    rows and BATCH_BYTES because a row is a whole document, and shuffle files of a
    finished action are removed so that a job made of several written steps holds
    only the files of the step that runs.
    """
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, unless PYTHONPATH already gives it to them."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_annolens_sent", False):
        return
    archive = Path(tempfile.mkdtemp()) / "annolens.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (root / "annolens").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._annolens_sent = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Without that setting only a local master has a folder that all its workers see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{root.rstrip('/')}/annolens/{uuid.uuid4().hex}"
    _files(spark, path, "deleteOnExit")
    return path


def cut(df: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder written by ``cut`` through the file system Spark wrote it with."""
    _files(spark, path, "delete", True)


def _files(spark: SparkSession, path: str, what: str, *more) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), what)(target, *more)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` (cheap to read anew) joined with ``right`` (one row a key) on ``key``, whatever share of rows one key holds.

    ``counts`` (key, __n) may give the rows of ``left`` by key, of all keys or of those with many.

    The HOT_SHARE keys with most rows, of those with more than LEAST_HOT, are joined without a shuffle. Their number
    bounds what is broadcast, and no key that is shuffled has more than one row in HOT_SHARE.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    most = counts.where((F.col("__n") > LEAST_HOT) & F.col(key).isNotNull()).orderBy(F.desc("__n")).limit(HOT_SHARE)
    hot = [r[0] for r in most.select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], f"`{key}` {left.schema[key].dataType.simpleString()}"))
    few = right.join(keys, key, "left_semi")
    cold = left.join(keys, key, "left_anti").join(right, key, how)
    if how == "left":  # a hot key that ``few`` has not gets its one row here, so hot rows are joined once whatever ``how``
        few, how = keys.join(F.broadcast(few), key, "left"), "inner"
    return cold.unionByName(left.join(F.broadcast(few), key, how))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``; lambdas would otherwise re-evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
