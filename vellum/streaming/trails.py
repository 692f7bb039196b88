"""Heads of growing trails as a stream: an extension, for logs that are appended to while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "job_id string, seq long, ts string, event string, prev_hash string, hash string"


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Entries from JSON lines as files arrive."""
    return spark.readStream.schema(ENTRY).json(folder)


def heads(entries: DataFrame) -> DataFrame:
    """(job_id, entries, head_hash, last_seq) so far; for the complete or update mode. State is one row a job."""
    return entries.groupBy("job_id").agg(F.count(F.lit(1)).alias("entries"), F.max_by("hash", "seq").alias("head_hash"), F.max("seq").alias("last_seq"))


def events_by_hour(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """(window, event, entries) by hour of ts; entries later than ``late`` behind the newest are left out, so state stays bounded."""
    df = entries.withColumn("at", F.try_to_timestamp("ts")).withWatermark("at", late)
    return df.groupBy(F.window("at", "1 hour"), "event").agg(F.count(F.lit(1)).alias("entries"))
