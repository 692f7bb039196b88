"""Hash-chained event trails: making, verifying and summing them up.

An entry's hash covers its canonical JSON, which holds the hash of the entry before it.
Verification needs each entry and its neighbour only, so it is a window over the job in
file order; a claimed sequence number is checked, never sorted by.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.jsons import canonical, quoted

# Names and fields of the record.
GENESIS = "0" * 64
EVENTS = ("job.created", "content.generated", "review.opened", "content.edited", "content.approved", "package.exported", "download.served", "retention.deleted")
CONTENT_EVENTS = ("content.generated", "content.edited", "content.approved", "package.exported")
FIELDS = ("seq", "ts", "job_id", "event", "actor", "content_hash", "details", "prev_hash", "hash", "mac")
UTC = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(\+00:?00|Z)$"


def payload(prev: Column) -> Column:
    """Canonical JSON of an entry: keys in order, nothing between them, nulls kept. Needs the record's columns; ``details`` is JSON already."""
    own = F.to_json(F.struct(F.col("actor"), F.col("content_hash")), {"ignoreNullFields": "false"})
    rest = F.to_json(F.struct(F.col("event"), F.col("job_id"), prev.alias("prev_hash"), F.col("seq"), F.col("ts")), {"ignoreNullFields": "false"})
    return F.concat(F.regexp_replace(own, r"\}$", ""), F.lit(',"details":'), F.col("details"), F.lit(","), F.regexp_replace(rest, r"^\{", ""))


def content_hash(module: Column, assessment: Column) -> Column:
    """The digest of what a job holds at one moment, of the module's and the assessment's JSON; null if either is no JSON."""
    return F.sha2(F.concat(F.lit('{"assessment":'), canonical(assessment), F.lit(',"training_module":'), canonical(module), F.lit("}")), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest in hexadecimal, by its definition over SHA-256."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda x: F.lit(bytearray(b ^ x for b in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def chained(entries: DataFrame) -> DataFrame:
    """Adds prev_hash and hash to entries (job_id, file_line, seq, ts, event, actor, content_hash, details).

    A chain is made one entry after the other: a job's entries are folded in one row, so a
    single job's trail has to fit a task, as it does the one writer that makes it.
    """
    item = F.struct("file_line", "seq", "ts", "job_id", "event", "actor", "content_hash", "details")
    rows = entries.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def text(x: Column, prev: Column) -> Column:
        opt = {"ignoreNullFields": "false"}
        own = F.to_json(F.struct(x["actor"].alias("actor"), x["content_hash"].alias("content_hash")), opt)
        rest = F.to_json(F.struct(x["event"].alias("event"), x["job_id"].alias("job_id"), prev.alias("prev_hash"), x["seq"].alias("seq"), x["ts"].alias("ts")), opt)
        return F.concat(F.regexp_replace(own, r"\}$", ""), F.lit(',"details":'), x["details"], F.lit(","), F.regexp_replace(rest, r"^\{", ""))

    start = F.array(F.lit(GENESIS))
    hashes = F.aggregate("items", start, lambda s, x: F.concat(s, F.array(F.sha2(text(x, F.element_at(s, -1)), 256))))
    rows = rows.select(F.explode(F.arrays_zip("items", hashes.alias("h"), F.slice(hashes, F.lit(2), F.size("items")).alias("g"))).alias("z")).where("z.items is not null")
    return rows.select("z.items.*", F.col("z.h").alias("prev_hash"), F.col("z.g").alias("hash"))


def continued(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Adds prev_hash and hash to entries (job_id, seq, ts, event, actor, content_hash, details), each job's chain going on from its stored head.

    heads: (job_id, head_hash), at most one a job; jobs without one start anew. Entries of
    a job come in the order of file_line where they have one, else of seq. As one job's entries follow each other, they are
    folded in one row; what is folded is what is new, however long the stored trail.
    """
    front = F.concat(F.lit('{"actor":'), F.to_json("actor"), F.lit(',"content_hash":'), F.coalesce(quoted(F.col("content_hash")), F.lit("null")), F.lit(',"details":'), "details", F.lit(',"event":'), quoted(F.col("event")), F.lit(',"job_id":'), quoted(F.col("job_id").cast("string")), F.lit("}"))
    back = F.concat(F.lit('","seq":'), F.col("seq").cast("string"), F.lit(',"ts":'), quoted(F.col("ts")), F.lit("}"))
    place = F.col("file_line" if "file_line" in entries.columns else "seq")
    items = entries.select("job_id", F.struct(place.alias("place"), "seq", "ts", "event", "actor", "content_hash", "details", F.concat(F.regexp_replace(canonical(front), r"\}$", ""), F.lit(',"prev_hash":"')).alias("front"), back.alias("back")).alias("x"))
    rows = items.groupBy("job_id").agg(F.array_sort(F.collect_list("x")).alias("items"))
    rows = rows.join(heads.select("job_id", "head_hash"), "job_id", "left") if heads is not None else rows.withColumn("head_hash", F.lit(None).cast("string"))
    start = F.array(F.coalesce("head_hash", F.lit(GENESIS)))
    hashes = F.aggregate("items", start, lambda s, x: F.concat(s, F.array(F.sha2(F.concat(x["front"], F.element_at(s, -1), x["back"]), 256))))
    rows = rows.select("job_id", F.explode(F.arrays_zip("items", hashes.alias("h"), F.slice(hashes, F.lit(2), F.size("items")).alias("g"))).alias("z")).where("z.items is not null")
    return rows.select("job_id", *[F.col(f"z.items.{c}") for c in ("place", "seq", "ts", "event", "actor", "content_hash", "details")], F.col("z.h").alias("prev_hash"), F.col("z.g").alias("hash"), F.concat("z.items.front", "z.h", "z.items.back").alias("payload"))


def is_hash(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def problems(trail: DataFrame, key: bytes | None = None) -> DataFrame:
    """(job_id, phase, file_line, sub, seq, problem): every fault of every job's trail, in the order of checks given by phase, file_line, sub.

    ``trail``: the record's columns with file_line; `claimed` job_id where the entry's own may differ, `mac` with a key,
    `payload` where what is hashed was read rather than is to be made from the columns.
    """
    w, all_ = W.partitionBy("job_id").orderBy("file_line"), W.partitionBy("job_id")
    claimed = F.col("claimed_job_id") if "claimed_job_id" in trail.columns else F.col("job_id")
    when = F.when(F.col("ts").rlike(UTC), F.try_to_timestamp("ts"))
    # the last approval in file order, then the last export that claims to come after it
    df = trail.withColumn("_ts", when).withColumn("_prev", F.lag("hash", 1, GENESIS).over(w)).withColumn("_before", F.lag("_ts").over(w)).withColumn("_at", F.row_number().over(w)).withColumn("_line", F.col("_at"))
    df = df.withColumn("_ok", F.max(F.when(F.col("event") == "content.approved", F.struct("file_line", "seq", "content_hash"))).over(all_))
    late = (F.col("event") == "package.exported") & (F.col("seq") > F.col("_ok.seq"))
    df = df.withColumn("_last", F.max(F.when(late, F.col("file_line"))).over(all_))
    one = lambda phase, sub, bad, cond, name: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(phase).alias("phase"), F.lit(sub).alias("sub"), bad.cast("long").alias("seq"), F.lit(name).alias("problem")))
    seq = F.col("seq")
    faults = [
        one(1, 1, seq, F.col("hash") != F.sha2(F.col("payload") if "payload" in trail.columns else payload(F.col("prev_hash")), 256), "contents do not match the hash"),
        one(1, 2, seq, F.col("prev_hash") != F.col("_prev"), "does not chain to the entry before"),
        one(2, 1, F.least(seq, F.col("_at")), seq != F.col("_at"), "seq is not contiguous"),
        one(2, 2, seq, claimed != F.col("job_id"), "belongs to another job"),
        one(2, 3, seq, ~F.col("event").isin(*EVENTS), "unknown event"),
        one(2, 4, seq, F.col("_ts").isNull(), "ts is not a UTC timestamp"),
        one(2, 5, seq, F.col("event").isin(*CONTENT_EVENTS) & ~is_hash(F.col("content_hash")), "carries no content hash"),
        one(3, 1, seq, F.col("_ts") < F.col("_before"), "timestamp goes backwards"),
        one(4, 1, seq, (F.col("_at") == 1) & (F.col("event") != "job.created"), "trail does not start with job.created"),
        one(5, 1, seq, (F.col("event") == "content.edited") & (seq > F.col("_ok.seq")), "edited after approval"),
        one(6, 1, seq, (F.col("file_line") == F.col("_last")) & ~_matches(), "export is not what was approved"),
    ]
    if key is not None:
        faults.insert(2, one(1, 3, seq, F.coalesce(F.col("mac"), F.lit("")) == "", "no MAC"))
        faults.insert(3, one(1, 4, seq, (F.col("mac") != "") & (F.col("mac") != hmac_sha256(key, F.col("hash"))), "MAC does not verify"))
    found = df.select("job_id", "file_line", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f"))
    return found.select("job_id", "f.phase", "file_line", "f.sub", "f.seq", "f.problem")


def _matches() -> Column:
    return is_hash(F.col("content_hash")) & is_hash(F.col("_ok.content_hash")) & (F.col("content_hash") == F.col("_ok.content_hash"))


def verdicts(trail: DataFrame, key: bytes | None = None) -> DataFrame:
    """(job_id, ok, entries, first_bad_seq, reason, problems, head_hash, package_matches): package_matches is null without an approval or an export after it."""
    bad = problems(trail, key).groupBy("job_id").agg(F.count(F.lit(1)).alias("problems"), F.min("seq").alias("first_bad_seq"), F.min(F.struct("phase", "file_line", "sub", "problem"))["problem"].alias("reason"))
    ok = F.max(F.when(F.col("event") == "content.approved", F.struct("file_line", "seq", "content_hash"))).over(W.partitionBy("job_id"))
    late = F.when((F.col("event") == "package.exported") & (F.col("seq") > F.col("_ok.seq")), F.struct("file_line", _matches().alias("m")))
    jobs = trail.withColumn("_ok", ok).groupBy("job_id").agg(F.count(F.lit(1)).alias("entries"), F.max_by("hash", "file_line").alias("head_hash"), F.max(late)["m"].alias("package_matches"))
    df = jobs.join(bad, "job_id", "left")
    return df.select("job_id", F.col("problems").isNull().alias("ok"), "entries", "first_bad_seq", "reason", F.coalesce("problems", F.lit(0)).cast("long").alias("problems"), "head_hash", "package_matches")


def log_lines(trail: DataFrame) -> DataFrame:
    """(job_id, file_line, shown): one line an entry, for listing."""
    return trail.select("job_id", "file_line", F.format_string("%4d  %s  %-18s %s", "seq", "ts", "event", F.substring("hash", 1, 12)).alias("shown"))


def current_state(trail: DataFrame) -> DataFrame:
    """(job_id, state, events): the last event that sets a state decides; states are never changed in place."""
    state = F.when(F.col("event") == "content.approved", "approved").when(F.col("event") == "content.edited", "in_review").when(F.col("event").isin("job.created", "content.generated"), "generated")
    return trail.groupBy("job_id").agg(F.max(F.when(state.isNotNull(), F.struct("file_line", state.alias("s"))))["s"].alias("state"), F.count(F.lit(1)).alias("events"))
