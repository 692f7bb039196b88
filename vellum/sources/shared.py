"""Folders that all executors share, for tables that several steps read."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, gone when the driver ends; the warehouse's in a local session without that setting, ValueError on a cluster without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name storage that all executors share")
    folder = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/vellum-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, written once and read from there by all that follows; a lost executor costs no more than its part of this."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
