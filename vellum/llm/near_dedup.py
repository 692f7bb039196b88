"""Near-duplicate classes by Order MinHash and banded alignment.

A text's k-mers are its runs of five words, each labelled with how often it occurred
before. One sketch value is made of the LENGTH k-mers with the least hashes, in the
order in which they stand in the text, so two texts share it with a probability that
falls with their edit distance; COUNT such values are drawn. A text of at most SHORT
k-mers, where few values can differ, gets a value for each way to leave out up to two of
them besides, which misses no similar pair of such texts. Texts that share a value are
candidates. A candidate pair is verified by aligning the two k-mer sequences within
the band that the threshold leaves: the longest common subsequence L of sequences of
lengths m and n must have L / (m + n - L) >= 0.8.

Scale: identical texts are collapsed first, so that copies cost one row each. In a
bucket every member is compared with a hub only, the member that shares most buckets
with most others, and the links found give classes. Then members of
different classes that still share a bucket are compared with each other, so no link
between classes is lost to the hubs' economy. Pairs within a class are never made.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.blocked_bloom import Sieve
from vellum.llm.columns import MIX, MORE, discard, mixed, shared_folder, table_of, text_slices, trimmed, word_hashes
from vellum.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: Of U k-mers of either text, L common ones make a shared value with a probability of C(L, 4) / C(U, 4): 0.41 at the threshold for long texts, 0.36 for the shortest that aren't SHORT (L = 12, U = 15). No value of 28 is shared by such a pair with one of 4e-7 to 4e-6.
LENGTH, COUNT = 4, 28
#: Similar texts of m and n k-mers differ in (m + n) / 9 of them at most, which is two up to here.
SHORT, LEFT_OUT = 10, 2
#: Times that buckets are linked through hubs before what is still apart is compared in full.
HUB_TURNS = 1
#: Buckets with more members than this are looked at by what their texts share before pairs are made.
CROWD, RARE = 8, 8
SEEDS = np.array([int.from_bytes(hashlib.sha256(f"order {i}".encode()).digest()[:8], "little") | 1 for i in range(256)], np.uint64)


def labelled_kmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the texts' labelled k-mers in their order, where each text's begin and the end).

    Words are in lower case and split at white space. A text of one to four words has
    one k-mer, an empty one none. Within a text all of them differ.
    """
    h, bounds = word_hashes(texts)
    words = np.diff(bounds)
    count = np.where(words > 0, np.maximum(words - WORDS + 1, 1), 0)
    upto = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    first = bounds[doc] + np.arange(upto[-1]) - upto[doc]
    h = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    g = np.zeros(len(first), np.uint64)
    for j in range(WORDS):
        word = h[first + j]
        word[first + j >= bounds[doc + 1]] = 0
        g = g * MORE + word
    g = mixed(g)
    with_doc = g ^ mixed(doc.astype(np.uint64) + MIX)
    order = np.argsort(with_doc, kind="stable")
    s = with_doc[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    if not new.all():
        place = np.arange(len(s))
        before = place - np.maximum.accumulate(np.where(new, place, 0))
        occurrence = np.empty(len(s), np.uint64)
        occurrence[order] = before
        g = np.where(occurrence > 0, mixed(g + occurrence * MIX), g)
    return g, upto


def sketches(texts: list[str], count: int = COUNT, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(texts x count sketch values, number of k-mers); texts without k-mers have zeros."""
    g, upto = labelled_kmers(texts)
    n = np.diff(upto)
    out = np.zeros((len(texts), count), np.int64)
    if not len(g):
        return out, n
    doc = np.repeat(np.arange(len(texts)), n)
    share = np.minimum(1.0, 6.0 * length / np.maximum(n, 1))
    below = np.where(share < 1, share * 2.0**64, 0).astype(np.uint64) - np.uint64(1)  # most k-mers can't be among the least
    below_each = below[doc]
    need = np.minimum(n, length)
    for i in range(count):
        v = g * SEEDS[i] + SEEDS[i + 128]
        few = np.flatnonzero(v <= below_each)
        short = np.flatnonzero(np.bincount(doc[few], minlength=len(texts)) < need)
        if len(short):
            few = np.union1d(few, np.concatenate([np.arange(upto[d], upto[d + 1]) for d in short.tolist()]))
        few = few[np.lexsort((v[few], doc[few]))]
        d = doc[few]
        begin = np.searchsorted(d, np.arange(len(texts)))
        rank = np.arange(len(d)) - begin[d]
        few = np.sort(few[rank < length])  # back in the order of the text
        value = np.zeros(len(texts), np.uint64)
        d = doc[few]
        rank = np.arange(len(d)) - np.searchsorted(d, np.arange(len(texts)))[d]
        for r in range(length):
            own = few[rank == r]
            value[doc[own]] = mixed(value[doc[own]] * MIX + g[own])
        out[:, i] = value.view(np.int64)
    return out, n


def short_values(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(values, of which text each is) of texts with 1 to SHORT k-mers: one for each way to leave out LEFT_OUT of them at most."""
    g, upto = labelled_kmers(texts)
    n = np.diff(upto)
    out, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in range(1, SHORT + 1):
        own = np.flatnonzero(n == size)
        rows = g[upto[own][:, None] + np.arange(size)] if len(own) else np.zeros((0, size), np.uint64)
        for less in range(min(LEFT_OUT, size - 1) + 1) if len(own) else ():
            for kept in combinations(range(size), size - less):
                value = np.full(len(own), MIX)
                for k in kept:
                    value = mixed(value * MIX + rows[:, k])
                out.append(value.view(np.int64))
                of.append(own)
    return np.concatenate(out), np.concatenate(of)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (m + n - L) of two k-mer sequences by banded alignment; 0 if it is surely below ``least``.

    All of a sequence's k-mers differ, so a common subsequence is an increasing run of
    the positions of common k-mers; those farther apart than the band can't be in one
    that reaches the threshold.
    """
    m, n = len(a), len(b)
    if not m or not n:
        return float(m == n)
    if min(m, n) < least * max(m, n):
        return 0.0
    _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(x) < least * (m + n - len(x)):
        return 0.0
    band = int((1 - least) * (m + n - len(x))) + 1
    near = np.abs(x - y) <= band
    y = y[near][np.argsort(x[near])]
    if (np.diff(y) > 0).all():
        common = len(y)
    else:
        tops: list[int] = []
        for p in y.tolist():
            k = bisect_left(tops, p)
            tops[k : k + 1] = [p]
        common = len(tops)
    return common / (m + n - common)


def _prepared(docs: DataFrame, text_col: str, folder: str, count: int, length: int) -> DataFrame:
    """Writes and rereads (row, digest, n, sketch, and all columns of ``docs`` in the struct ``doc``), and adds ``text``, which is read from there.

    sketch: the values by their number, then those of short texts.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kind, place = rows.schema["doc"].dataType.simpleString(), docs.columns.index(text_col)
    schema = pa.schema([("row", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for start, texts in text_slices(pa.record_batch([b.column(0).flatten()[place]], names=["text"]), "text"):
                values, n = sketches(texts, count, length)
                few = np.flatnonzero((n > 0) & (n <= SHORT))
                more, of = short_values([texts[i] for i in few.tolist()])
                own = np.concatenate([np.repeat(np.arange(len(texts)), count), few[of]])
                order = np.argsort(own, kind="stable")
                ends = np.searchsorted(own[order], np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([values.ravel(), more])[order]))
                made = table_of(schema, row=np.arange(at, at + len(texts)), digest=[hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], n=n, sketch=lists.cast(pa.list_(pa.int64())))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), *made.columns], names=["doc", *schema.names])

    rows.mapInArrow(trimmed(sketch), f"doc {kind}, row long, digest binary, n long, sketch array<long>").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder).withColumn("text", F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")))


def _members(prepared: DataFrame, id_col: str, folder: str) -> DataFrame:
    """Writes and rereads (row, id, node, n, sketch): node is the first row with the same text, which alone has the sketch.

    Only rows whose digest may be repeated are joined; the copies' table is written
    before, so that a large group of copies is split.
    """
    spark = prepared.sparkSession
    copies = prepared.groupBy(F.col("digest").alias("_d")).agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("_rows"))
    copies.where("_rows > 1").select("_d", "node").write.parquet(f"{folder}/copies")
    copies = spark.read.parquet(f"{folder}/copies")
    repeated = Sieve(copies, F.col("_d")).passes(F.col("digest"))
    rows = prepared.select("row", F.col(f"doc.`{id_col}`").alias("id"), "digest", "n", "sketch")
    rest = rows.where(repeated).join(copies, F.col("digest") == F.col("_d"), "left").withColumn("node", F.coalesce("node", "row"))
    every = rows.where(~repeated).withColumn("node", F.col("row")).select("row", "id", "node", "n", "sketch").unionByName(rest.select("row", "id", "node", "n", F.when(F.col("node") == F.col("row"), F.col("sketch")).alias("sketch")))
    every.write.parquet(f"{folder}/members")
    return spark.read.parquet(f"{folder}/members")


def _verified(pairs: DataFrame, prepared: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are similar. Only texts that a filter of the pairs' rows lets pass are moved."""
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row")))
    texts = prepared.where(Sieve(wanted, F.col("row")).passes(F.col("row"))).select("row", "text")
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers = lru_cache(64)(lambda text: labelled_kmers([text])[0])
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                out = [(x, y) for x, y, s, t in zip(*(part.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b")), strict=True) if similarity(kmers(s), kmers(t), least) >= least]
                yield table_of(schema, a=[x for x, _ in out], b=[y for _, y in out])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(check), "a long, b long")


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): the members of each bucket with the bucket's hub, where their classes differ.

    The hub is the member that shares most buckets with most others. In a family of
    edited copies that is the text from which all were made: it is closer to every copy
    than they are to each other.
    """
    degree = buckets.groupBy("node").agg(F.sum("size").alias("degree"))
    known = buckets.join(degree, "node")
    hubs = known.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("m"), "comp")).alias("h")).select("bucket", (-F.col("h.m")).alias("hub"), F.col("h.comp").alias("hub_comp"))
    pairs = buckets.join(hubs, "bucket").where("hub <> node and hub_comp <> comp")
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _rest(buckets: DataFrame, prepared: DataFrame, members: DataFrame, least: float, folder: str) -> DataFrame:
    """(a, b): members of different classes that share a bucket and can be similar.

    In crowded buckets a text's rare k-mers, those in at most RARE texts of all crowded
    buckets, tell most pairs apart. Two texts with m and n k-mers, r and s of them rare
    and c of those in common, share at most min(m - r, n - s) + c. Pairs with c > 0 are
    read off the rare k-mers themselves, at most RARE texts each; for all others c = 0,
    and texts that could then reach the threshold with nothing are left out before pairs
    are made. Both bounds are exact: no similar pair is lost.
    """
    spark, ratio = prepared.sparkSession, least / (1 + least)
    crowded = buckets.where(F.col("size") > CROWD)
    nodes = crowded.select(F.col("node").alias("row")).distinct()
    texts = prepared.where(Sieve(nodes, F.col("row")).passes(F.col("row"))).select("row", "text").join(nodes, "row", "left_semi")

    def kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(b.schema.get_field_index("row")).to_numpy()
            for start, part in text_slices(b, "text"):
                g, upto = labelled_kmers(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[start : start + len(part)], np.diff(upto))), pa.array(g.view(np.int64))], names=["node", "kmer"])

    texts.mapInArrow(trimmed(kmers), "node long, kmer long").write.option("compression", "zstd").parquet(f"{folder}/kmers")
    all_kmers = spark.read.parquet(f"{folder}/kmers")
    rare = all_kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") <= RARE)
    all_kmers.join(rare, "kmer").write.option("compression", "zstd").parquet(f"{folder}/rare")
    rare = spark.read.parquet(f"{folder}/rare")
    known = crowded.select("node", "n", "comp").distinct().join(rare.groupBy("node").agg(F.count(F.lit(1)).alias("r")), "node", "left").withColumn("can", F.col("n") - F.coalesce("r", F.lit(0))).drop("r")
    known.write.parquet(f"{folder}/crowd")
    known = spark.read.parquet(f"{folder}/crowd")
    two = rare.where("texts > 1").select("kmer", "node")
    other = two.select("kmer", F.col("node").alias("node_"))
    together = two.join(other, "kmer").where("node < node_").groupBy("node", "node_").agg(F.count(F.lit(1)).alias("c"))
    named = lambda df: df.select(*[F.col(c).alias(f"{c}_") for c in ("node", "n", "comp", "can")])
    common = together.join(known, "node").join(named(known), "node_").where((F.col("comp") != F.col("comp_")) & (F.least("can", "can_") + F.col("c") >= ratio * (F.col("n") + F.col("n_")) - 1e-6))
    out = common.select(F.col("node").alias("a"), F.col("node_").alias("b"))
    few = buckets.where(F.col("size") <= CROWD).withColumn("can", F.col("n"))
    many = crowded.join(known.where(F.col("can") >= least * F.col("n")).select("node", "can"), "node")
    sketch = members.where("sketch is not null").select("node", "sketch")
    for part in (few, many):
        left = part.select("bucket", "i", "node", "n", "comp", "can").join(sketch, "node")
        right = left.select("bucket", *[F.col(c).alias(f"{c}_") for c in ("node", "n", "comp", "can", "sketch")])
        fits = (F.col("node") < F.col("node_")) & (F.col("comp") != F.col("comp_")) & (F.least("can", "can_") >= ratio * (F.col("n") + F.col("n_")) - 1e-6)
        # a pair is made in the first bucket that it shares only
        earlier = F.exists(F.arrays_zip(F.slice("sketch", F.lit(1), F.col("i")).alias("x"), F.slice("sketch_", F.lit(1), F.col("i")).alias("y")), lambda z: z["x"] == z["y"])
        out = out.union(left.join(right, (left["bucket"] == right["bucket"]) & fits & ~earlier).select(F.col("node").alias("a"), F.col("node_").alias("b")))
    return out.distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = COUNT, length: int = LENGTH, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, prepared): row, id, class_id, class_size, kept; and all of ``docs`` by row, in the struct ``doc``.

    Two texts are linked if the alignment of their five-word runs is at least ``least``;
    a class is whatever links connect. class_id is the least id of the class (null only
    if all are null), and the row that has it is kept, exactly one a class even where
    ids repeat. Empty, null and blank texts hold no words: those that are identical make
    a class, with null as empty. Columns of ``docs`` may have any names; an empty table
    gives no rows.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    prepared = _prepared(docs, text_col, f"{folder}/prepared", count, length)
    members = _members(prepared, id_col, folder)
    # sketch values of different texts, by bucket; blank texts are in none
    spread = members.where("sketch is not null and n > 0").select("node", "n", F.posexplode("sketch").alias("i", "value"))
    spread = spread.select(F.xxhash64(F.least("i", F.lit(count)), "value").alias("bucket"), F.least("i", F.lit(count)).alias("i"), "node", "n").distinct()
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    spread.join(shared, "bucket").select("bucket", "i", "node", "n", F.col("node").alias("comp"), "size").write.parquet(f"{folder}/buckets")
    buckets, done, comps = spark.read.parquet(f"{folder}/buckets"), None, None
    for turn in range(HUB_TURNS + 1):
        if turn < HUB_TURNS:
            pairs = _hub_pairs(buckets)
        else:
            pairs = _rest(buckets, prepared, members, least, folder)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs.write.parquet(f"{folder}/pairs-{turn}")
        pairs = spark.read.parquet(f"{folder}/pairs-{turn}")
        _verified(pairs, prepared, least).write.parquet(f"{folder}/edges-{turn}")
        found = spark.read.parquet(f"{folder}/edges-{turn}")
        if comps is None or found.limit(1).count():
            links = found if comps is None else comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found)
            comps = components(links, f"{folder}/classes-{turn}")
        if turn < HUB_TURNS:
            done = pairs if done is None else done.union(pairs)
            named = buckets.select("bucket", "i", "node", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            apart = named.groupBy("bucket").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count(F.lit(1)).alias("size")).where("p <> q").select("bucket", "size")
            named.join(apart, "bucket").write.parquet(f"{folder}/apart-{turn}")
            buckets = spark.read.parquet(f"{folder}/apart-{turn}")
    members.select("row", "id", "node").join(comps, "node", "left").select("row", "id", F.coalesce("comp", "node").alias("comp")).write.parquet(f"{folder}/classed")
    classed = spark.read.parquet(f"{folder}/classed")
    # written first, so that the rows of a large class are split when they are joined
    classed.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.count(F.lit(1)).alias("class_size")).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    discard(spark, *[f"{folder}/{x}" for x in ("copies", "members", "buckets", "kmers", "rare", "crowd", *(f"{y}-{turn}" for y in ("pairs", "edges", "apart", "classes") for turn in range(HUB_TURNS + 1)))])
    rows = classed.join(classes, "comp").select("row", "id", F.col("best.id").alias("class_id"), "class_size", (F.col("best.row") == F.col("row")).alias("kept"))
    return rows.withColumnRenamed("id", id_col), prepared


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that near_classes() keeps, with all their columns.

    A filter of the dropped rows lets all others through as they are; only the rows it
    stops, few more than those dropped, go through a join.
    """
    rows, prepared = near_classes(docs, id_col, text_col)
    folder = shared_folder(docs.sparkSession)
    rows.where("not kept").select("row").write.parquet(f"{folder}/dropped")
    out = docs.sparkSession.read.parquet(f"{folder}/dropped")
    stopped = Sieve(out, F.col("row")).passes(F.col("row"))
    sure = prepared.where(~stopped).select("doc.*")
    return sure.unionByName(prepared.where(stopped).join(out, "row", "left_anti").select("doc.*"))
