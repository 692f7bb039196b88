"""Files as such: their digests, and taking old job folders away without losing what their trails came to."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import audit as A
from vellum.sources.records import read_trails
from vellum.sources.shared import stored

#: Up to this many bytes a file is digested from its row, beyond it piece by piece; bytes of a piece.
WHOLE, PIECE = 1 << 28, 1 << 20
RETIRED = ".retired"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path within."""
    return (pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("file:", "/")) else pafs.FileSystem.from_uri(path)


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, length, sha256) of every file below a path, of any size but none: Spark's readers pass over empty files. One that vanishes meanwhile raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = []
            for p in b.column(0).to_pylist():
                fs, inner = opened(p)
                digest = hashlib.sha256()
                with fs.open_input_stream(inner) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.string())], names=["path", "length", "sha256"])

    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return small.union(files.where(F.col("length") > whole).select("path", "length").mapInArrow(streamed, "path string, length long, sha256 string"))


def _each(df: DataFrame, act) -> DataFrame:
    """(job_id, error): what ``act`` on the file system did with each job's folders (job_id, source, target), on the executors; an error leaves the others alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = []
            for source, target in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    fs, inner = opened(source)
                    act(fs, inner, opened(target)[1])
                    errors.append(None)
                except (OSError, pa.ArrowException) as e:
                    errors.append(f"{type(e).__name__}: {str(e)[:160]}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string())], names=["job_id", "error"])

    return df.select("job_id", "source", "target").repartition("job_id").mapInArrow(run, "job_id string, error string")


def _aside(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Renames a folder; one that is renamed already, as by a task that was lost, is left as it is."""
    here, there = (fs.get_file_info(x).type != pafs.FileType.NotFound for x in (source, target))
    if there and not here:
        return
    if there:
        raise FileExistsError(f"{target} is there already")
    fs.create_dir(target.rsplit("/", 1)[0])
    fs.move(source, target)


def _deleted(fs: pafs.FileSystem, source: str, _: str) -> None:
    if fs.get_file_info(source).type != pafs.FileType.NotFound:
        fs.delete_dir(source)


def retire(spark: SparkSession, folder: str, store: str, now: str, seconds: int, key: bytes | None = None) -> DataFrame:
    """(job_id, state, head_hash, error) of the job folders ``<folder>/<job>`` whose newest file is older than ``seconds`` before ``now`` (UTC): states "gone" and "kept".

    First a folder is set aside by renaming it; one that can't be is kept and recorded
    nowhere. Then the heads of all trails that were set aside are chained onto the store's
    own trail, named "global", as retention.deleted. Only then are they deleted: what
    survives of a job is on record before it goes. What an earlier run that broke off has
    set aside is recorded and deleted as well, and recorded once only if it was so already.
    """
    from vellum.streaming.append import append, heads, read_store

    aside = f"{folder}/{RETIRED}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    inner = F.regexp_extract("path", re.escape(opened(folder)[1].rstrip("/")) + r"/([^/]+)/", 1)
    newest = files.select(inner.alias("job_id"), "modificationTime").where(~F.col("job_id").isin("", RETIRED)).groupBy("job_id").agg(F.max("modificationTime").alias("at"))
    old = newest.where(F.unix_timestamp("at") < F.unix_timestamp(F.lit(now).cast("timestamp")) - seconds).select("job_id", F.concat(F.lit(f"{folder}/"), "job_id").alias("source"), F.concat(F.lit(f"{aside}/"), "job_id").alias("target"))
    moved = stored(_each(old, _aside), "moved")  # written, so that it happens once
    kept = moved.where("error is not null").select("job_id", F.lit("kept").alias("state"), F.lit(None).cast("string").alias("head_hash"), "error")
    fs, path = opened(aside)
    names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.Directory] if fs.get_file_info(path).type == pafs.FileType.Directory else []
    if not names:
        return kept
    gone = spark.createDataFrame([(n,) for n in sorted(names)], "job_id string")
    last = read_trails(spark, aside)[0].where(A.is_hash(F.col("hash"))).groupBy("job_id").agg(F.max_by("hash", "file_line").alias("head_hash"))
    gone = gone.join(last, "job_id", "left").select("job_id", F.coalesce("head_hash", F.lit(A.GENESIS)).alias("head_hash"))
    gone = stored(gone, "gone")  # before the trails go
    told = F.to_json(F.struct("head_hash", "job_id", F.lit(seconds).alias("retention_seconds")))
    requests = gone.select(
        F.concat(F.lit("retention-"), "job_id").alias("request_id"), F.lit(now).alias("asked"), F.lit("global").alias("job_id"), F.lit("retention.deleted").alias("event"),
        F.struct(F.lit("retention-sweep").alias("name"), F.lit("system").alias("role"), F.lit("system").alias("source")).alias("actor"), F.lit(None).cast("string").alias("content_hash"), told.alias("details"),
    )
    number = heads(spark, store).agg(F.max("head_seq")).first()[0] or 0
    if number:
        known = read_store(spark, store)[0].where("event = 'retention.deleted'").select(F.get_json_object("details", "$.job_id").alias("j"), F.get_json_object("details", "$.head_hash").alias("h")).distinct()
        requests = requests.withColumns({"j": F.get_json_object("details", "$.job_id"), "h": F.get_json_object("details", "$.head_hash")}).join(known, ["j", "h"], "left_anti").drop("j", "h")
    append(requests, store, number + 1, key=key)
    done = _each(gone.select("job_id", F.concat(F.lit(f"{aside}/"), "job_id").alias("source"), F.concat(F.lit(f"{aside}/"), "job_id").alias("target")), _deleted)
    done = stored(done, "done")
    return kept.unionByName(gone.join(done, "job_id").select("job_id", F.when(F.col("error").isNull(), "gone").otherwise("kept").alias("state"), "head_hash", "error"))
