"""How far the sources of a language diverge in their words, and by which words.

Terms are counted by (language, source) in the tasks that read the texts, and the counts
dealt into shards by a hash of language and term, so that all counts of a term meet. Each
shard is a small in-memory DuckDB: SQL adds its counts and drops the terms that too few
documents have. Spark adds up the shards' totals, and the kept counts go through shards
once more, with the totals of all groups: SQL makes the shares, each shard's part of every
pair's distance and its best terms of every group; Spark adds the parts and ranks.

A pair's distance over V terms is V times that of the two shares of a term with no
occurrence, corrected by terms that occur: those of one source, counted by their share, and
those of both. So a shard's work grows with what occurs, not with all terms of all pairs,
and a lone term's counts, one a source, are the largest thing that can't be split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.columns import shared_folder, text_slices, trimmed

#: Documents that a kept term is in at least, what is added to its count, the whole that shares are out of, terms of a group that are listed.
DOCUMENTS, ADDED, WHOLE, LISTED = 30, 5, 1_000_000_000, 50
#: Terms that a task counts before it hands them on; bytes of text for a shard, and the most shards; kept rows for a shard of the second pass.
COUNTED, TEXT_BYTES, MOST, ROWS = 300_000, 64_000_000, 20_000, 200_000
#: Rows that go into a shard's table at once, and at how many it is added up.
CHUNK, FULL = 500_000, 2_000_000
TERM = re.compile(rb"[a-z\x80-\xff]+")

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("whole", pa.int64())])
PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

ADD = "select lang, source, term, sum(n)::bigint as n, sum(d)::bigint as d from {} group by all"
#: A shard's kept counts by source, and one row with a null source for the language.
KEEP = f"""
with t as ({ADD.format("counts")}), k as (select lang, term, sum(n)::bigint as whole from t group by all having sum(d) >= {DOCUMENTS})
select t.lang, t.source, t.term, t.n, k.whole from t join k using (lang, term) union all select lang, null, term, whole, whole from k
"""
_share = lambda n, total: f"1 + ({WHOLE}::hugeint * ({n} + {ADDED})) // ({total} + {ADDED}::hugeint * v)"
#: A shard's parts of all distances, by pair in the order of names, and its best terms.
COMPARE = f"""
with z as (select lang, source, total, whole_total, v, {_share("0", "total")} as z from groups where v > 0),
p as (select lang, source, term, z, {_share("n", "total")} as p, {_share("whole", "whole_total")} as q from kept join z using (lang, source)),
h as (select lang, source, z, p, count(*) as k from p group by all),
pairs as (
  select h.lang, least(h.source, z.source) as source, greatest(h.source, z.source) as item, sum(k * (abs(h.p - z.z) - abs(h.z - z.z))) as value
  from h join z on z.lang = h.lang and z.source <> h.source group by all
  union all
  select a.lang, a.source, b.source, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z))
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all),
best as (select lang, source, term, p - q as value from p where p > q qualify row_number() over (partition by lang, source order by p - q desc, term) <= {LISTED})
select lang, source, 'pair' as part, item, sum(value)::bigint as value from pairs group by all
union all select lang, source, 'term', term, value::bigint from best
"""


def terms(text: str) -> list[bytes]:
    """Runs of letters A to Z, in lower case, and of all that isn't ASCII, as UTF-8."""
    return TERM.findall(text.encode("utf-8", "replace").lower())


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by (lang, source), from rows (lang, source, text)."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            k = len(n)
            words = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), words, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], schema=COUNTS)

    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for start, texts in text_slices(b, "text"):
            for lang, source, text in zip(langs[start:], sources[start:], texts, strict=False):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                own, before = terms(text), len(n)
                n.update(own)
                d.update(set(own))
                size += len(n) - before
                if size >= COUNTED:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def database():
    """An in-memory database of one task: one thread, no files."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def answer(con, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in con.sql(sql).to_arrow_reader(100_000):
        yield from pa.Table.from_batches([b]).cast(schema).to_batches()


def kept_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a shard's counts as they come and keeps what enough documents have."""
    con = database()
    con.execute("create table counts (lang varchar, source varchar, term varchar, n bigint, d bigint)").fetchall()
    held, size, rows = [], 0, 0

    def add() -> int:
        con.register("chunk", pa.Table.from_batches(held, COUNTS))
        con.execute(f"insert into counts {ADD.format('chunk')}").fetchall()
        con.unregister("chunk")
        return con.execute("select count(*) from counts").fetchall()[0][0]

    full = FULL
    for b in batches:
        held.append(b.cast(COUNTS) if b.schema != COUNTS else b)
        size += b.num_rows
        if size >= CHUNK:
            rows, held, size = add(), [], 0
            if rows >= full:
                for sql in (f"create table added as {ADD.format('counts')}", "drop table counts", "alter table added rename to counts"):
                    con.execute(sql).fetchall()
                full = max(FULL, 2 * con.execute("select count(*) from counts").fetchall()[0][0])
    if held:
        add()
    yield from answer(con, KEEP, KEPT)
    con.close()


def compared(kept: pa.Table, groups: pa.Table) -> pa.Table:
    """A shard's parts of distances and its best terms, from its kept counts and all groups' totals."""
    con = database()
    con.register("kept", kept)
    con.register("groups", groups)
    out = pa.Table.from_batches(answer(con, COMPARE, PARTS), PARTS)
    con.close()
    return out


def divergence(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    Part "pair": the other sources of the language by the sum of differences of shares over
    all kept terms, all of them. Part "term": the kept terms whose share in the source is
    above that in the language by most, at most LISTED. A share is 1 + floor(WHOLE * (count
    + ADDED) / (total + ADDED * V)), in whole numbers; ranks go by value downwards, then by
    the item's UTF-8. Null text, lang and source are empty; without kept terms all pairs
    have 0; a language's only source has no pairs; repeated rows count again; an empty table
    gives no rows; other columns are not looked at.

    ``shards``: of the first pass; without it as many as the texts' bytes need.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    full = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(full("lang"), full("source"), full("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = min(MOST, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_BYTES)))
    dealt = rows.mapInArrow(trimmed(counted), "lang string, source string, term string, n long, d long").repartition(shards, "lang", "term")
    dealt.mapInArrow(trimmed(kept_counts), "lang string, source string, term string, n long, whole long").write.parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")
    langs = kept.where("source is null").groupBy("lang").agg(F.sum("n").alias("whole_total"), F.count(F.lit(1)).alias("v"))
    own = kept.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("whole_total"), zero("v"))
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    # the second pass: every shard with all groups
    second = -(-kept.count() // ROWS) or 1
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(second)).alias("shard")
    counts = kept.where("source is not null").select(shard, "lang", "source", "term", "n", "whole").groupBy("shard")
    every = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(second - 1).cast("long")))).groupBy("shard")
    parts = counts.cogroup(every).applyInArrow(compared, "lang string, source string, part string, item string, value long")
    parts.write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    # what two sources differ by where neither has a term, for every pair
    none = F.expr(f"1 + {WHOLE * ADDED} div nullif(total + {ADDED} * v, 0)")
    sides = groups.select("lang", "source", "v", F.when(F.col("v") > 0, none).otherwise(F.lit(0)).cast("long").alias("z"))
    other = sides.select("lang", F.col("source").alias("item"), F.col("z").alias("other"))
    base = sides.repartition("lang", "source").join(other, "lang").where("source < item").select("lang", "source", "item", (F.col("v") * F.abs(F.col("z") - F.col("other"))).alias("value"))
    sums = base.unionByName(parts.where("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = sums.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    best = parts.where("part = 'term'")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(best).where(F.col("rank") <= LISTED))
