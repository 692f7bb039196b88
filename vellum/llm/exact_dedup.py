"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Each step works on what the step before left open. The lengths in bytes are counted
first; a row whose length occurs once is settled. Of the others the first characters
are hashed and counted by length; a row whose prefix occurs once there is settled too.
Only the rest is hashed in full and grouped by that hash. What a step leaves open is
carried to the next by a blocked Bloom filter of the repeated keys, sized by their
number, so no text ever crosses a shuffle and settled rows cross none at all. (With more
repeated keys than a filter holds, four million, a step passes all of its rows on: that
costs hashing, which is less than moving texts to join them.)

Counts and groups are aggregated before they are shuffled. Where the rows of a group get
its survivor by a join, those of a large group are dealt to many tasks, and its survivor
goes to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.blocked_bloom import Sieve
from vellum.llm.columns import discard, shared_folder

PREFIX = 64
#: Rows of a group beyond which its rows are dealt to PARTS tasks when they are joined.
LARGE, PARTS = 1000, 64


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _repeated(keys: DataFrame, folder: str) -> DataFrame:
    """The keys (all columns) that occur more than once, written and read again."""
    keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows").write.parquet(folder)
    return keys.sparkSession.read.parquet(folder)


def _marked(docs: DataFrame, id_col: str, text_col: str, digest: bool, prefix: int, folder: str) -> DataFrame:
    """Writes and rereads (_id, _row, _full, _digest) of all rows; _full is null where length or prefix settles a row."""
    text = _text(text_col)
    length, head = F.octet_length(text).cast("long"), F.xxhash64(F.substring(text, 1, prefix))
    lengths = Sieve(_repeated(docs.select(length.alias("n")), f"{folder}/lengths"), F.col("n"))
    of_length = lengths.passes(length)
    shapes = Sieve(_repeated(docs.where(of_length).select(length.alias("n"), head.alias("p")), f"{folder}/shapes"), F.xxhash64("n", "p"))
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), text.alias("_text"), F.when(of_length, shapes.passes(F.xxhash64(length, head))).otherwise(F.lit(False)).alias("_open"))
    full = F.unhex(F.sha2("_text", 256))
    if digest:  # asked for every row, so taken once
        rows = rows.withColumn("_digest", full).select("_id", "_row", F.when(F.col("_open"), F.col("_digest")).alias("_full"), "_digest")
    else:
        rows = rows.select("_id", "_row", F.when(F.col("_open"), full).alias("_full"), F.lit(None).cast("binary").alias("_digest"))
    rows.write.parquet(f"{folder}/rows")
    discard(docs.sparkSession, f"{folder}/lengths", f"{folder}/shapes")
    return docs.sparkSession.read.parquet(f"{folder}/rows")


def _groups(rows: DataFrame, folder: str) -> DataFrame:
    """Writes and rereads (_full, _keep, _size) of the texts that occur more than once."""
    found = rows.where("_full is not null").groupBy("_full").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    found.where("_size > 1").write.parquet(f"{folder}/groups")
    return rows.sparkSession.read.parquet(f"{folder}/groups")


def _with_groups(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """The open rows with their group's survivor and size."""
    large = Sieve(groups.where(F.col("_size") > LARGE), F.col("_full")).passes(F.col("_full"))
    rows = rows.where("_full is not null").withColumn("_part", F.when(large, F.pmod(F.xxhash64("_row"), F.lit(PARTS))).otherwise(F.lit(0)))
    parts = F.when(large, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(groups.withColumn("_part", F.explode(parts)), ["_full", "_part"], how).drop("_part")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None, prefix: int = PREFIX) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept; and every text's SHA-256 if ``digest`` names a column for it.

    Texts are equal when identical; a null text counts as empty. Of equal texts the
    row with the largest id stays; of rows that also share that id exactly one has
    ``kept`` true. A null id sorts below all others. An empty table gives no rows.
    Columns of ``docs`` other than the two named ones are not looked at, whatever
    their names. Which rows there are is written once, so what is computed again after
    a loss is the same.
    """
    folder = shared_folder(docs.sparkSession)
    rows = _marked(docs, id_col, text_col, digest is not None, prefix, folder)
    groups = _groups(rows, folder)
    none = groups.schema["_keep"].dataType
    settled = rows.where("_full is null").select("*", F.lit(None).cast(none).alias("_keep"), F.lit(1).cast("long").alias("_size"))
    open_ = _with_groups(rows, groups, "left").select(*rows.columns, "_keep", F.coalesce("_size", F.lit(1)).cast("long").alias("_size"))
    alone = F.col("_keep").isNull()
    return settled.unionByName(open_).select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.col("_size").alias("group_size"),
        (alone | (F.col("_keep._row") == F.col("_row"))).alias("kept"),
        *([F.lower(F.hex("_digest")).alias(digest)] if digest else []),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup() keeps, with all their columns; of rows that agree in id and text one.

    A filter of the ids of dropped rows lets all others through as they are. Of what it
    stops, (id, text hash) tells which rows stay, and only those are moved: a dropped
    text never is. All passes read the same ``docs``, which must give the same rows
    again, as a table does.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = _marked(docs, id_col, text_col, False, PREFIX, folder)
    dropped = _with_groups(rows, _groups(rows, folder), "inner").select("_id", "_full", (F.col("_keep._row") == F.col("_row")).alias("_kept"))
    # a pair that stays and goes, as rows agree in both, stays once
    pairs = dropped.groupBy("_id", "_full").agg(F.max("_kept").alias("_kept"), F.min("_kept").alias("_always")).where("not _always")
    pairs.select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id"), "_full", "_kept").write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    stopped = Sieve(pairs, F.col("_id")).passes(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    key = (F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.unhex(F.sha2(_text(text_col), 256)).alias("_full"))
    # all columns travel in one struct, whatever their names
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    sure = docs.where(~stopped)
    met = docs.where(stopped).select(*key).join(pairs, ["_id", "_full"], "left").where("_kept is null or _kept")
    met.select("_id", "_full", (F.col("_kept").isNotNull()).alias("_once")).distinct().write.parquet(f"{folder}/stay")
    stay = spark.read.parquet(f"{folder}/stay")
    moved = docs.where(stopped).select(whole, *key).where(Sieve(stay, F.xxhash64("_id", "_full")).passes(F.xxhash64("_id", "_full"))).join(stay, ["_id", "_full"])
    rest = moved.where("not _once").select("doc").unionByName(moved.where("_once").dropDuplicates(["_id", "_full"]).select("doc"))
    return sure.unionByName(rest.select("doc.*"))
