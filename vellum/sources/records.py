"""Job records and event trails from folders of JSON, tolerant of damage: nothing raises, every fault is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.jsons import canonical, quoted
from vellum.functions.text import strip
from vellum.operators import audit as A
from vellum.operators import metrics as M

JOB = "status string, source_filename string, created_at string, first_edit_at string, approved_at string, edits_count int, edit_rounds int, edits_by_category map<string,string>, approval struct<approved_at:string>, training_module struct<learning_objectives:array<string>,sections:array<string>>, assessment struct<questions:array<struct<options:array<string>>>>"


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One row a job folder with a job.json: job_id, readable, and its figures; missing fields get defaults.

    A file that isn't a JSON object is unreadable. Counts that aren't whole numbers (true
    is none) are 0; times that can't be read give null, never 0.
    """
    df = spark.read.text(f"{folder}/*/job.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/job\.json$", 1).alias("job_id"), F.col("value").alias("json"))
    v = F.try_parse_json("json")
    df = df.withColumn("_v", v).withColumn("readable", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    whole = lambda name: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")) == "BIGINT", F.try_variant_get("_v", f"$.{name}", "long"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("_v", path, "variant")) == "STRING", F.try_variant_get("_v", path, "string"))
    n = lambda path: F.coalesce(F.array_size(F.try_variant_get("_v", path, "array<variant>")), F.lit(0))
    options = F.aggregate(F.coalesce(F.try_variant_get("_v", "$.assessment.questions", "array<variant>"), F.expr("array()")), F.lit(0), lambda a, q: a + 1 + F.coalesce(F.array_size(F.try_variant_get(q, "$.options", "array<variant>")), F.lit(0)))
    approved_at = F.coalesce(F.nullif(text("$.approved_at"), F.lit("")), text("$.approval.approved_at"))
    return df.select(
        "job_id", "readable", F.coalesce(F.nullif(text("$.status"), F.lit("")), F.lit("unknown")).alias("status"), text("$.source_filename").alias("source_filename"), F.coalesce(whole("edits_count"), F.lit(0)).alias("edits_count"), F.coalesce(whole("edit_rounds"), F.lit(0)).alias("edit_rounds"),
        *[F.coalesce(whole(f"edits_by_category.{c}"), F.lit(0)).alias(f"edits_{c}") for c in M.CATEGORIES], (n("$.training_module.learning_objectives") + n("$.training_module.sections") + options).cast("long").alias("editable_items"), n("$.assessment.questions").alias("num_questions"),
        M.seconds_between(text("$.created_at"), text("$.first_edit_at")).alias("seconds_to_first_edit"), M.seconds_between(text("$.created_at"), approved_at).alias("seconds_to_approve"),
    )


def trail_lines(spark: SparkSession, paths: str, group: Column, *order: Column) -> DataFrame:
    """(group, path, file_line, line, last) of all log files, a row a line, however the files are split.

    group: what lines are numbered within, of the file's path; order: of a group's files.
    A line's place is the start of the split that it was read in and its order there.
    ``last`` marks a final line without a line feed, which is told by the file's length.
    Bytes that are no UTF-8 become U+FFFD.
    """
    file = lambda f: F.col(f"_metadata.{f}")
    df = spark.read.option("lineSep", "\n").text(paths).select(F.make_valid_utf8("value").alias("line"), F.octet_length("value").alias("bytes"), file("file_path").alias("path"), file("file_size").alias("size"), file("file_block_start").alias("start"))
    df = df.withColumn("at", F.monotonically_increasing_id()).withColumn("group", group)
    own = W.partitionBy("path").orderBy("start", "at")
    read = F.sum(F.col("bytes") + 1).over(own)
    df = df.select("*", (F.lead("at").over(own).isNull() & (read > F.col("size"))).alias("last"))
    return df.select("group", "path", F.row_number().over(W.partitionBy("group").orderBy(*order, "path", "start", "at")).alias("file_line"), "line", "last")


def parsed_lines(lines: DataFrame, job_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of lines (group, path, file_line, line, last); job_id is that of the folder, or else the entry's own."""
    lines = lines.withColumn("v", F.try_parse_json("line"))
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant")), F.lit("-"))
    keys = F.json_object_keys("line")
    fields = F.array(*map(F.lit, sorted(A.FIELDS)))
    missing, unknown = F.array_except(fields, keys), F.array_sort(F.array_except(keys, fields))
    why = F.when(F.col("last"), "incomplete final line").when(strip(F.col("line")) == "", "blank line").when(F.col("v").isNull(), "not valid JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "entry is not an object")
    why = why.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))).when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))).when(kind("seq") != "BIGINT", "seq is not an integer")
    for f in ("ts", "job_id", "event", "prev_hash", "hash"):
        why = why.when(kind(f) != "STRING", f"{f} is not a string")
    for f in ("actor", "details"):
        why = why.when(~kind(f).startswith("OBJECT"), f"{f} is not an object")
    for f in ("content_hash", "mac"):
        why = why.when(~kind(f).isin("STRING", "VOID"), f"{f} is not a string or null")
    lines = lines.withColumn("why", why)
    get = lambda f, t="string": F.try_variant_get("v", f"$.{f}", t)
    part = F.from_json(canonical(F.col("line")), "actor string, details string")
    good = lines.where("why is null").withColumn("part", part)
    hashed = F.concat(
        F.lit('{"actor":'), "part.actor", F.lit(',"content_hash":'), F.coalesce(quoted(get("content_hash")), F.lit("null")), F.lit(',"details":'), "part.details", F.lit(',"event":'), quoted(get("event")), F.lit(',"job_id":'), quoted(get("job_id")), F.lit(',"prev_hash":'), quoted(get("prev_hash")),
        F.lit(',"seq":'), get("seq", "long").cast("string"), F.lit(',"ts":'), quoted(get("ts")), F.lit("}"),
    )
    own = get("job_id") if job_id is None else job_id
    entries = good.select(
        own.alias("job_id"), "file_line", get("seq", "long").alias("seq"), get("ts").alias("ts"), get("job_id").alias("claimed_job_id"), get("event").alias("event"), F.col("part.actor").alias("actor"), get("content_hash").alias("content_hash"), F.col("part.details").alias("details"), get("prev_hash").alias("prev_hash"), get("hash").alias("hash"), get("mac").alias("mac"),
        "line", canonical(hashed).alias("payload"),
    )
    faults = lines.where("why is not null").select(*([job_id.alias("job_id")] if job_id is not None else ["path"]), "file_line", F.col("why").alias("problem"))
    return entries, faults


def read_trails(spark: SparkSession, folder: str, name: str = "audit.jsonl") -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of all trails ``<folder>/<job>/<name>``, read line by line.

    Entries are those intact, with their claimed job id beside the folder's, and the text
    that their hash is of. A blank line, bad JSON, a wrong shape and an unfinished last
    line are problems.
    """
    lines = trail_lines(spark, f"{folder}/*/{name}", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return parsed_lines(lines, F.col("group"))


def expired(jobs: DataFrame, trails: DataFrame, now: str, seconds: int, updated: str = "updated_at") -> DataFrame:
    """(job_id, head_hash): jobs older than so many seconds, with the head of their trail, to be recorded before anything is deleted."""
    heads = trails.groupBy("job_id").agg(F.max_by("hash", "file_line").alias("head_hash"))
    old = F.timestamp_diff("SECOND", F.try_to_timestamp(updated), F.lit(now).cast("timestamp")) > seconds
    return jobs.where(old).select("job_id").join(heads, "job_id", "left").select("job_id", F.coalesce("head_hash", F.lit(A.GENESIS)).alias("head_hash"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON list of samples whose ids are plain names."""
    return spark.read.option("multiLine", "true").json(path).where(F.col("id").rlike("^[a-z0-9_]+$"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
