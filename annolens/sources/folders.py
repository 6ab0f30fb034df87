"""Folders that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir that goes when the driver ends; without that setting only a local master has one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{root.rstrip('/')}/annolens/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` through a table in a scratch folder: what several steps read is computed once, and lost executors cost no recomputation."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, its session's Python workers having this package: it is sent once a context, unless PYTHONPATH already gives it to them."""
    root, sc = Path(__file__).resolve().parents[2], df.sparkSession.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_annolens_sent", False):
        return df
    archive = Path(tempfile.mkdtemp()) / "annolens.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (root / "annolens").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._annolens_sent = True
    return df
