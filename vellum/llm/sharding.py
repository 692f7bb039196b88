"""Sharding by a hierarchical weighted hash tree.

A tree is regions of racks of shards with weights. A key descends it level by level:
every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the child's
own path, and the least draw wins. A draw depends on nothing but the key, the child
and the child's weight, so a change of weights moves keys only into (or out of)
subtrees whose weights change. A shard is added as a region of its own, so it takes
keys only into itself.

Within a shard rows stand in the order of a hash of id and checksum. A row's slot is its
rank in the sub-bucket of its hash's first digits plus the sizes of the sub-buckets
before it; there are as many digits as keep sub-buckets at about ROWS rows, and one that
is larger, as rows repeat, is dealt out once more by row. So no task has to hold or sort
a whole shard, nor all rows of an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.columns import shared_folder

Tree = list[list[list[float]]]
#: Rows of a sub-bucket, and up to how many rows a table of sub-buckets is broadcast.
ROWS, BROADCAST = 20_000, 100_000


def tree(shards: int, racks: int = 2, per_rack: int = 5) -> Tree:
    """Equal shards, ``per_rack`` to a rack and ``racks`` to a region; the last ones may be smaller."""
    ids = [1.0] * shards
    rows = [ids[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [rows[i : i + racks] for i in range(0, len(rows), racks)]


def grown(t: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own at the end."""
    return [*t, [[weight]]]


def _uniform(key: Column, path: Column) -> Column:
    """Strictly between 0 and 1, from 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", key, path)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _least(key: Column, weights: Column, most: int, path: Callable[[Column], Column]) -> Column:
    """Index of the child with the least draw, the first of equal ones; a weight of 0 never wins."""

    def draw(i: Column) -> Column:
        w = F.get(weights, i)
        return F.struct(F.when(w > 0, -F.log(_uniform(key, path(i))) / w).otherwise(F.lit(float("inf"))).alias("d"), i.alias("i"))

    return F.array_min(F.transform(F.array(*[F.lit(i) for i in range(most)]), draw))["i"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, even where the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shard_of(key: Column, t: Tree) -> Column:
    """The shard (int) that a string key, not null, comes to, numbered in the order of the tree."""
    most_racks, most = max(map(len, t)), max(len(r) for g in t for r in g)
    num = lambda xs, n: F.array(*[F.lit(float(x)) for x in [*xs, *[0] * (n - len(xs))]])
    regions = num([sum(map(sum, g)) for g in t], len(t))
    racks = F.array(*[num([sum(r) for r in g], most_racks) for g in t])
    leaves = F.array(*[F.array(*[num(r, most) for r in [*g, *[[]] * (most_racks - len(g))]]) for g in t])
    firsts, at = [], 0
    for g in t:
        firsts.append([0] * most_racks)
        for j, r in enumerate(g):
            firsts[-1][j] = at
            at += len(r)
    first = F.array(*[F.array(*map(F.lit, f)) for f in firsts])
    region = _least(key, regions, len(t), lambda i: F.concat(F.lit("g"), i.cast("string")))
    rack = lambda g: _least(key, F.get(racks, g), most_racks, lambda i: F.concat(g.cast("string"), F.lit("|r"), i.cast("string")))
    leaf = lambda g, r: _least(key, F.get(F.get(leaves, g), r), most, lambda i: F.concat(g.cast("string"), F.lit("|"), r.cast("string"), F.lit("|s"), i.cast("string")))
    return _let(region, lambda g: _let(rack(g), lambda r: F.get(F.get(first, g), r) + leaf(g, r))).cast("int")


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The key law: the id and the number of shards decide. A null id is keyed as the empty
    string; a null text has size 16 and the checksum of no bytes. Rows with the same id
    share a shard. An empty table gives no rows; other columns are not looked at. The
    rows without their texts are written once, so slots don't change when something is
    computed again.
    """
    spark, folder, t = docs.sparkSession, shared_folder(docs.sparkSession), tree(shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.select("*", shard_of(key, t).alias("shard"), shard_of(key, grown(t)).alias("grown_shard"), F.md5(F.concat_ws("|", key, "text_crc32")).alias("_hash"))
    rows.write.parquet(f"{folder}/rows")
    rows, digits = spark.read.parquet(f"{folder}/rows"), 2
    total = rows.count()
    while total > ROWS * shards * 16**digits:
        digits += 1
    rows = rows.withColumn("_sub", F.substring("_hash", 1, digits))
    small = (lambda df: F.broadcast(df)) if shards * 16**digits <= BROADCAST else (lambda df: df)
    rows.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n")).write.parquet(f"{folder}/subs")
    subs = spark.read.parquet(f"{folder}/subs").select("shard", "_sub", F.when(F.col("_n") > 2 * ROWS, F.ceil(F.col("_n") / ROWS)).otherwise(F.lit(1)).cast("long").alias("_parts"))
    rows = rows.join(small(subs), ["shard", "_sub"]).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")))
    counts = rows.groupBy("shard", "_sub", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_sub", "_part", (F.sum("_n").over(W.partitionBy("shard").orderBy("_sub", "_part")) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("shard", "_sub", "_part").orderBy("_hash", "_row")) - 1)
    placed = ranked.join(small(before), ["shard", "_sub", "_part"])
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
