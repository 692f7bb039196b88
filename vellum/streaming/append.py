"""Trails that grow: requests come in from many sides, one stream chains and stores them.

Whoever wants an entry drops a request (JSON lines of REQUEST) into a folder. One stream
per store takes them in batches: each job's requests go on from its stored head, in the
order of ``asked`` and ``request_id``. Entries, new heads and what was turned away are
written to folders of their own for the batch, which a repeated batch overwrites, so that
a batch counts once however often it is tried. The stream's checkpoint lies in the store:
Spark lets one query at a time have it, so a job never has two writers.

What is stored is never changed. A damaged line of a log that was adopted stays as it
is and is reported when the log is read; the chain goes on from the last intact entry.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vellum.functions.jsons import canonical, quoted
from vellum.functions.text import strip
from vellum.operators import audit as A
from vellum.sources.records import parsed_lines, trail_lines

REQUEST = "request_id string, asked string, job_id string, event string, actor struct<name:string,role:string,source:string>, content_hash string, details string"
HEAD = "job_id string, head_seq long, head_hash string, head_ts string, batch long"
# Where an actor can act.
SOURCES = ("web", "cli", "system")


def fault(requests: DataFrame) -> Column:
    """Why a request can't become an entry, the first rule that it breaks; null if it can."""
    kind = F.schema_of_variant(F.try_parse_json("details"))
    return (
        F.when(F.coalesce(strip(F.col("job_id")), F.lit("")) == "", "job_id is empty").when(~F.coalesce(F.col("event").isin(*A.EVENTS), F.lit(False)), "unknown event")
        .when(F.coalesce(strip(F.col("actor.name")), F.lit("")) == "", "actor has no name").when(~F.coalesce(F.col("actor.source").isin(*SOURCES), F.lit(False)), "unknown source of actor")
        .when(F.col("content_hash").isNotNull() & ~A.is_hash(F.col("content_hash")), "content_hash is no SHA-256").when(F.col("details").isNotNull() & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "details are no JSON object")
    )


def heads(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """(job_id, head_seq, head_hash, head_ts) stored, the latest of each job; of batches before one where that is given."""
    try:
        df = spark.read.schema(HEAD).parquet(f"{store}/heads")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], HEAD)
    df = df if before is None else df.where(F.col("batch") < before)
    return df.groupBy("job_id").agg(F.max(F.struct("batch", "head_seq", "head_hash", "head_ts")).alias("h")).select("job_id", "h.head_seq", "h.head_hash", "h.head_ts")


def adopt(entries: DataFrame, store: str) -> None:
    """Makes the heads of trails that were kept elsewhere (as read_trails gives them) those of the store, as its batch -1: each job's last intact entry with a hash."""
    last = entries.where(A.is_hash(F.col("hash"))).groupBy("job_id").agg(F.max(F.struct("file_line", "seq", "hash", "ts")).alias("x"))
    last.select("job_id", F.col("x.seq").alias("head_seq"), F.col("x.hash").alias("head_hash"), F.col("x.ts").alias("head_ts")).write.mode("overwrite").parquet(f"{store}/heads/batch=-1")


def append(requests: DataFrame, store: str, batch: int, now: str | None = None, key: bytes | None = None) -> None:
    """Chains a batch of requests onto the store's trails; running the same batch again replaces what it wrote.

    ``now``: the entries' time, UTC with microseconds and offset; a job's time never goes
    back behind its head's. A repeated request_id of a batch counts once; details that are
    null are {}. With a key every entry has its keyed digest.
    """
    spark = requests.sparkSession
    now = now or datetime.now(timezone.utc).isoformat(timespec="microseconds")
    rows = requests.withColumn("why", fault(requests))
    rows.where("why is not null").write.mode("overwrite").json(f"{store}/rejected/batch={batch}")
    good = rows.where("why is null").groupBy("request_id").agg(F.min(F.struct("asked", "job_id", "event", "actor", "content_hash", "details")).alias("r")).select("request_id", "r.*")
    old = heads(spark, store, batch)
    place = F.row_number().over(W.partitionBy("job_id").orderBy("asked", "request_id"))
    good = good.withColumn("place", place).join(old, "job_id", "left")
    made = A.continued(
        good.select("job_id", (F.coalesce("head_seq", F.lit(0)) + F.col("place")).cast("long").alias("seq"), F.greatest(F.lit(now), "head_ts").alias("ts"), "event", "actor", "content_hash", canonical(F.coalesce("details", F.lit("{}"))).alias("details")), old
    )
    mac = A.hmac_sha256(key, F.col("hash")) if key is not None else F.lit(None).cast("string")
    # the canonical entry: what is hashed, with the hash between event and job_id and the keyed digest before prev_hash
    text = F.concat(F.regexp_replace("payload", r"\}$", ""), F.lit(',"hash":'), quoted(F.col("hash")), F.lit(',"mac":'), F.coalesce(quoted(mac), F.lit("null")), F.lit("}"))
    lines = made.select("job_id", "seq", canonical(text).alias("value")).repartition("job_id").sortWithinPartitions("job_id", "seq")
    lines.select("value").write.mode("overwrite").text(f"{store}/entries/batch={batch}")
    entries = stored_lines(spark, store, batch)
    last = parsed_lines(entries)[0].groupBy("job_id").agg(F.max(F.struct("seq", "hash", "ts")).alias("x"))
    last.select("job_id", F.col("x.seq").alias("head_seq"), F.col("x.hash").alias("head_hash"), F.col("x.ts").alias("head_ts")).write.mode("overwrite").parquet(f"{store}/heads/batch={batch}")


def stored_lines(spark: SparkSession, store: str, batch: int | str = "*") -> DataFrame:
    """Lines of the store in the order of batches and, within one, of files."""
    return trail_lines(spark, f"{store}/entries/batch={batch}/part-*", F.lit(0), F.regexp_extract("path", r"batch=(-?\d+)/", 1).cast("long"))


def read_store(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of the store; problems name the file. Entries of a job are numbered in the order in which they were stored."""
    file = F.regexp_extract("path", r"batch=(-?\d+)/", 1).cast("long")
    entries, problems = parsed_lines(trail_lines(spark, f"{store}/entries/batch=*/part-*", F.col("path"), file).withColumn("batch", file).withColumn("file_line", F.struct("batch", "path", "file_line")))
    entries = entries.withColumn("file_line", F.row_number().over(W.partitionBy("job_id").orderBy("file_line")))
    return entries, problems.withColumn("file_line", F.col("file_line.file_line"))


def appending(spark: SparkSession, inbox: str, store: str, key: bytes | None = None, trigger: dict | None = None) -> StreamingQuery:
    """The stream that chains requests of a folder onto a store; by default it takes what is there and ends."""
    requests = spark.readStream.schema(REQUEST).json(inbox)
    out = requests.writeStream.foreachBatch(lambda df, batch: append(df, store, batch, key=key))
    return out.option("checkpointLocation", f"{store}/_checkpoint").trigger(**(trigger or {"availableNow": True})).start()
