"""Nearest neighbours by inner product from a forest of random-projection trees.

Every tree halves the vectors again and again by their projection on a random direction,
another one at each level, orthogonal to those above it. The thresholds are medians of a
bounded sample: a node has one of its own as long as the sample has vectors there, below
that all nodes of a level share one. Trees are as deep as leaves of about LEAF vectors
need, however many vectors there are. A query walks all trees at once through one
priority queue of branches, ordered by the squared distance by which the query lies on
the wrong side of the splits above, and takes leaves off it until it has its number of
leaves. The vectors of those leaves are its candidates, and nothing else is; they are
scored exactly, in double precision.

How many leaves a query takes is measured, not guessed: held-out queries are answered by
brute force over the whole table, and the number is the least with which the forest
finds TARGET of their true neighbours.

Identical vectors are one row in trees and leaves, whatever their number; of each at
most K + 1 ids are ever needed. A cell is a subtree of leaves; it gets its vectors and
the queries that visit any of its leaves, once each. Cells are counted, and those with
many vectors or queries are searched as blocks of bounded size.

For vectors of unequal lengths the trees see them with one more component that brings
all to the greatest length, so a near vector is one with a large inner product.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.columns import shared_folder, table_of

K = 20
#: Vectors that thresholds are fitted on at most, and queries that the number of leaves is: those with the least hashes of the id.
SAMPLE, HELD_OUT, TARGET = 16384, 256, 0.95
TREES, LEAF = 8, 32
#: Rows of the sample that a node's own threshold takes.
OWN = 8
#: Vectors of a cell about, and rows of a block of vectors or of queries at most.
CELL, BLOCK = 2048, 8192


@dataclass
class Forest:
    directions: np.ndarray  # trees x depth x (dimensions + 1)
    own: list[np.ndarray]  # by level, trees x nodes of the level: thresholds as far as nodes have their own
    shared: np.ndarray  # trees x depth: thresholds of the levels below
    longest: float
    leaves: int = 1

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """With the component that brings vectors to the greatest length; queries get none and are scaled to that length."""
        norm = np.linalg.norm(x, axis=1)
        if query:
            return np.hstack([x * (self.longest / norm)[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - norm**2, 0))[:, None]])

    def projected(self, y: np.ndarray) -> np.ndarray:
        """vectors x trees x depth."""
        return (y @ self.directions.reshape(-1, self.directions.shape[2]).T).reshape(len(y), *self.directions.shape[:2])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """vectors x trees: the leaf of each."""
        p, tree = self.projected(self.lifted(x, False)), np.arange(len(self.directions))
        node = np.zeros((len(x), len(tree)), np.int64)
        for level in range(self.depth):
            at = self.own[level][tree, node] if level < len(self.own) else self.shared[:, level]
            node = 2 * node + (p[:, :, level] > at)
        return node

    def visits(self, x: np.ndarray, leaves: int | None = None) -> Iterator[np.ndarray]:
        """The leaves of each query, best first, as tree << depth | leaf."""
        own, shared = [t.tolist() for t in self.own], self.shared.tolist()
        most = min(len(self.directions) << self.depth, leaves or self.leaves)
        for p in self.projected(self.lifted(x, True)).tolist():
            yield np.array(self._walk(p, own, shared, most), np.int64)

    def _walk(self, p: list[list[float]], own: list[list[list[float]]], shared: list[list[float]], most: int) -> list[int]:
        depth, known = self.depth, len(own)
        queue = [(0.0, t, 0, 0) for t in range(len(p))]
        out: list[int] = []
        while queue and len(out) < most:
            far, t, level, node = heapq.heappop(queue)
            mine = p[t]
            while level < depth:
                m = mine[level] - (own[level][t][node] if level < known else shared[t][level])
                level, node = level + 1, 2 * node + (m > 0)
                heapq.heappush(queue, (far + m * m, t, level, node ^ 1))
            out.append(t << depth | node)
        return out


def grow(sample: np.ndarray, count: int, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = 20) -> Forest:
    """A forest for ``count`` vectors from a sample of them."""
    depth = max(0, int(np.ceil(np.log2(max(1, count) / leaf))))
    r, d = np.random.default_rng(seed), sample.shape[1] + 1
    made = [np.vstack([np.linalg.qr(r.normal(size=(d, d)))[0] for _ in range(-(-depth // d))])[:depth] if depth else np.zeros((0, d)) for _ in range(trees)]
    forest = Forest(np.array(made).reshape(trees, depth, d), [], np.zeros((trees, depth)), longest)
    p = forest.projected(forest.lifted(sample, False))
    node = np.zeros((len(sample), trees), np.int64)
    for level in range(depth):
        forest.shared[:, level] = np.median(p[:, :, level], axis=0) if len(p) else 0.0
        at = np.repeat(forest.shared[:, level : level + 1], 1 << min(level, 30), axis=1) if len(sample) >= OWN << level else None
        for t in range(trees if at is not None else 0):
            order = np.lexsort((p[:, t, level], node[:, t]))
            bounds = np.searchsorted(node[order, t], np.arange((1 << level) + 1))
            some = np.flatnonzero(np.diff(bounds))
            low, high = (bounds[some] + bounds[some + 1] - 1) // 2, (bounds[some] + bounds[some + 1]) // 2
            at[t, some] = (p[order[low], t, level] + p[order[high], t, level]) / 2
        if at is not None:
            forest.own.append(at)
            node = 2 * node + (p[:, :, level] > at[np.arange(trees), node])
    return forest


def enough_leaves(forest: Forest, queries: np.ndarray, near: list[np.ndarray], target: float) -> int:
    """The least number of leaves with which the queries find the target share of their neighbours; near: those of each."""
    most = len(forest.directions) << forest.depth
    when: list[int] = []
    for q, x in zip(queries, near, strict=True):
        if not len(x):
            continue
        wanted = (np.arange(len(forest.directions)) << forest.depth) + forest.leaf_of(x)
        left, tries = np.full(len(x), most), 64
        while (left == most).any():  # the walk is repeated, longer, until it has met all
            turn = {leaf: i for i, leaf in enumerate(next(forest.visits(q[None], tries)).tolist())}
            left = np.array([min((turn.get(w, most) for w in row), default=most) for row in wanted.tolist()])
            if tries >= most:
                break
            tries *= 4
        when += left.tolist()
    return min(most, int(np.quantile(when, target, method="higher")) + 1) if when else 1


def _best(q: np.ndarray, x: np.ndarray, firsts: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, exact score) of each query's vectors with the largest inner products, best first, ties to the smaller id.

    scores: queries x vectors, those products nearly, minus infinity where a vector is no candidate.
    """
    most = min(most, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    floor = np.where(np.isfinite(floor), floor - 1e-9 * np.abs(floor), -np.finfo(float).max)
    row, at = np.nonzero(scores >= floor[:, None])
    exact = (x[at] * q[row]).sum(1)
    order = np.lexsort((firsts[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    begin = np.searchsorted(row, np.arange(len(q)))
    kept = np.arange(len(row)) - begin[row] < most
    return row[kept], at[kept], exact[kept]


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _bytes(x: np.ndarray) -> list[bytes]:
    """Vectors as little-endian floats, of half the size where that loses nothing."""
    small = x.astype("<f4")
    half = (small == x).all(1)
    return [a.tobytes() if h else b.tobytes() for a, b, h in zip(small, x.astype("<f8"), half.tolist(), strict=True)]


def _vectors(blobs: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return np.array([np.frombuffer(b, "<f4" if len(b) == 4 * d else "<f8") for b in blobs.to_pylist()], np.float64).reshape(-1, d)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, leaf: int = LEAF, trees: int = TREES, target: float = TARGET, leaves: int | None = None, effort: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``queries`` holds, its own id apart.

    Nearest first, equal scores by the smaller id. Vectors that are null, empty, all
    zeros, or hold null or non-finite components take no part, nor do rows with a null
    id. Vectors are searched among those of their own dimension, each dimension with a
    forest of its own. Rows that repeat both id and vector count once. An empty table
    gives no rows; columns not named are not looked at. ``leaves`` sets the number of
    leaves a query takes, which is else measured; ``effort`` adds ``scored``, the number
    of inner products that a query took.
    """
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession)
    values = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), values.alias("v"), queries.alias("asks")).where(_usable(F.col("v")))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
    for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect():  # one row a dimension
        out = out.unionByName(_of_dimension(rows.where(F.size("v") == r.d).select("id", "v", F.coalesce("asks", F.lit(False)).alias("asks")), r.d, f"{folder}/{r.d}", k, leaf, trees, target, leaves))
    return out if effort else out.drop("scored")


def _classes(rows: DataFrame, d: int, folder: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Writes and rereads (rows: id, asks, key) and (classes: key, v, norm, asks, first, ids) of vectors that are told apart by ``key``."""
    spark = rows.sparkSession
    schema = pa.schema([("id", pa.int64()), ("asks", pa.bool_()), ("key", pa.binary()), ("norm", pa.float64()), ("v", pa.binary())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d) + 0.0  # no negative zeros
            made = _bytes(x)
            yield table_of(schema, id=b.column(0), asks=b.column(2), key=[hashlib.blake2b(v, digest_size=16).digest() for v in made], norm=np.linalg.norm(x, axis=1), v=made)

    rows.mapInArrow(keyed, "id long, asks boolean, key binary, norm double, v binary").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    # of equal vectors, the smallest k + 1 ids; the window's limit is applied before the shuffle
    few = rows.select("key", "id").withColumn("n", F.dense_rank().over(W.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    each = rows.groupBy("key").agg(F.max("norm").alias("norm"), F.max("asks").alias("asks"), F.first("v").alias("v"))
    each.join(ids, "key").select("key", "v", "norm", "asks", F.col("ids")[0].alias("first"), "ids").write.parquet(f"{folder}/classes")
    return rows, spark.read.parquet(f"{folder}/classes")


def _true_neighbours(classes: DataFrame, asked: np.ndarray, own: list[bytes], d: int, k: int) -> list[np.ndarray]:
    """The k classes nearest to each of a bounded number of queries but for its own, by a pass over all classes."""
    schema = pa.schema([("q", pa.int32()), ("score", pa.float64()), ("first", pa.int64()), ("v", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, d)))] * len(asked)
        for whole in batches:
            for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                x, firsts, keys = _vectors(b.column(1), d), b.column(2).to_numpy(), b.column(0).to_pylist()
                place = {key: i for i, key in enumerate(keys)}
                s = asked @ x.T
                for i, key in enumerate(own):
                    if key in place:
                        s[i, place[key]] = -np.inf
                row, at, score = _best(asked, x, firsts, s, k)
                bounds = np.searchsorted(row, np.arange(len(asked) + 1))
                for i in range(len(asked)):
                    mine = slice(bounds[i], bounds[i + 1])
                    score_, first_, x_ = (np.concatenate([a, c]) for a, c in zip(held[i], (score[mine], firsts[at[mine]], x[at[mine]]), strict=True))
                    top = np.lexsort((first_, -score_))[:k]
                    held[i] = score_[top], first_[top], x_[top]
        for i, (score, first, x) in enumerate(held):
            fine = np.isfinite(score)
            yield table_of(schema, q=np.full(fine.sum(), i, np.int32), score=score[fine], first=first[fine], v=_bytes(x[fine]))

    found = classes.select("key", "v", "first").mapInArrow(scan, "q int, score double, first long, v binary")
    found = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("n") <= k)
    near: list[list[bytes]] = [[] for _ in asked]
    for r in found.select("q", "v").collect():  # at most HELD_OUT * k rows
        near[r.q].append(bytes(r.v))
    return [_vectors(pa.array(x, pa.binary()), d) for x in near]


def _of_dimension(rows: DataFrame, d: int, folder: str, k: int, leaf: int, trees: int, target: float, leaves: int | None) -> DataFrame:
    spark = rows.sparkSession
    rows, classes = _classes(rows, d, folder, k)
    count, longest = classes.agg(F.count(F.lit(1)), F.max("norm")).first()
    drawn = classes.orderBy(F.xxhash64("first"), "first").limit(SAMPLE).select("v").collect()
    forest = grow(_vectors(pa.array([bytes(r.v) for r in drawn], pa.binary()), d), count, longest or 1.0, trees, leaf)
    if leaves is None and forest.depth:
        asked = classes.orderBy(F.xxhash64("first", F.lit(1)), "first").limit(HELD_OUT).select("key", "v").collect()
        q = _vectors(pa.array([bytes(r.v) for r in asked], pa.binary()), d)
        leaves = enough_leaves(forest, q, _true_neighbours(classes, q, [bytes(r.key) for r in asked], d, k), target)
    forest.leaves = leaves or trees
    low = min(forest.depth, max(0, int(np.ceil(np.log2(CELL / leaf)))))  # levels within a cell
    fields = "key binary, v binary, cell long, leaves array<int>, ids array<long>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once a tree, with its leaf in the cell."""
        for b in batches:
            x = _vectors(b.column(1), d)
            at = ((np.arange(trees) << forest.depth) + forest.leaf_of(x)).ravel()
            of = b.select(["key", "v", "ids"]).take(pa.array(np.repeat(np.arange(len(x)), trees)))
            yield pa.RecordBatch.from_arrays([of.column(0), of.column(1), pa.array(at >> low), _lists(at & (1 << low) - 1, np.ones(len(at), int), pa.int32()), of.column(2)], names=["key", "v", "cell", "leaves", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once a cell that it visits, with the leaves there."""
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                of, cells, inside, counts = [], [], [], []
                for i, at in enumerate(forest.visits(_vectors(b.column(1), d))):
                    at = np.sort(at)
                    cell, n = np.unique(at >> low, return_counts=True)
                    of.append(np.full(len(cell), i))
                    cells.append(cell)
                    inside.append(at & (1 << low) - 1)
                    counts.append(n)
                rows_ = b.select(["key", "v"]).take(pa.array(np.concatenate(of)))
                yield pa.RecordBatch.from_arrays([*rows_.columns, pa.array(np.concatenate(cells)), _lists(np.concatenate(inside), np.concatenate(counts), pa.int32()), pa.nulls(rows_.num_rows, pa.list_(pa.int64()))], names=["key", "v", "cell", "leaves", "ids"])

    classes.select("key", "v", "ids").mapInArrow(place, fields).write.parquet(f"{folder}/placed")
    classes.where("asks").select("key", "v").mapInArrow(ask, fields).write.parquet(f"{folder}/asked")
    placed, asked = spark.read.parquet(f"{folder}/placed"), spark.read.parquet(f"{folder}/asked")
    # blocks of a cell's vectors and of its queries; each block of the one meets each of the other
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("q")), "cell")
    sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("q") / BLOCK).cast("int").alias("askers")).write.parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")
    place_of = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = placed.join(cells, "cell").select("cell", "key", "v", "leaves", "ids", place_of("parts").alias("part"), every("askers").alias("asker"))
    asked = asked.join(cells, "cell").select("cell", "key", "v", "leaves", every("parts").alias("part"), place_of("askers").alias("asker"))
    schema = pa.schema([("key", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("scored", pa.int64())])

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        """The best k + 1 ids of the block for each query that visits it, and how many vectors were scored for it."""
        out = [[], [], [], [], []]
        if len(ours) and len(theirs):
            ours, theirs = ours.combine_chunks(), theirs.combine_chunks()
            leaf_of = np.asarray(ours["leaves"].combine_chunks().flatten())
            order = np.argsort(leaf_of, kind="stable")
            x, ids = _vectors(ours["v"], d)[order], [ours["ids"][i].as_py() for i in order.tolist()]
            firsts, bounds = np.array([i[0] for i in ids], np.int64), np.searchsorted(leaf_of[order], np.arange((1 << low) + 1))
            more = np.array([len(i) for i in ids]).max() > 1
            for a in range(0, len(theirs), 512):
                part = theirs.slice(a, 512)
                q, visits = _vectors(part["v"], d), part["leaves"].combine_chunks()
                asker, visited = np.repeat(np.arange(len(q)), np.asarray(visits.value_lengths())), np.asarray(visits.flatten())
                scores = np.full((len(q), len(x)), -np.inf)
                by_leaf = np.argsort(visited, kind="stable")
                cuts = np.searchsorted(visited[by_leaf], np.arange((1 << low) + 1))
                for f in range(1 << low):
                    who = asker[by_leaf[cuts[f] : cuts[f + 1]]]
                    if len(who) and bounds[f] < bounds[f + 1]:
                        scores[who, bounds[f] : bounds[f + 1]] = q[who] @ x[bounds[f] : bounds[f + 1]].T
                row, at, exact = _best(q, x, firsts, scores, k + 1)
                real = np.isfinite(scores[row, at])
                row, at, exact = row[real], at[real], exact[real]
                near = firsts[at]
                if more:  # copies: all ids of each, and the best of those
                    copies = np.array([len(ids[i]) for i in at.tolist()], np.int64)
                    near = np.array([j for i in at.tolist() for j in ids[i]], np.int64)
                    row, exact = np.repeat(row, copies), np.repeat(exact, copies)
                    order_ = np.lexsort((near, -exact, row))
                    row, near, exact = row[order_], near[order_], exact[order_]
                    kept = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] <= k
                    row, near, exact = row[kept], near[kept], exact[kept]
                for o, new in zip(out, (part["key"].to_pylist(), near, exact, np.bincount(row, minlength=len(q)), np.isfinite(scores).sum(1)), strict=True):
                    o.append(new)
        if not out[0]:
            return schema.empty_table()
        keys, (near, exact, counts, scored) = [key for part in out[0] for key in part], map(np.concatenate, out[1:])
        return pa.table([pa.array(keys, pa.binary()), _lists(near, counts, pa.int64()), _lists(exact, counts, pa.float64()), pa.array(scored)], schema=schema)

    block = ["cell", "part", "asker"]
    found = placed.groupBy(*block).cogroup(asked.groupBy(*block)).applyInArrow(search, "key binary, ids array<long>, scores array<double>, scored long")

    def merge(table: pa.Table) -> pa.Table:
        """The best k + 1 of what a query's blocks found; a vector found in several trees counts once."""
        near, score = (np.asarray(table[c].combine_chunks().flatten()) for c in ("ids", "scores"))
        order = np.lexsort((near, -score))
        near, score = near[order], score[order]
        new = np.concatenate([[True], (near[1:] != near[:-1]) | (score[1:] != score[:-1])]) if len(near) else np.zeros(0, bool)
        near, score = near[new][: k + 1], score[new][: k + 1]
        return pa.table([table["key"].slice(0, 1), pa.array([near.tolist()], pa.list_(pa.int64())), pa.array([score.tolist()], pa.list_(pa.float64())), pa.array([sum(table["scored"].to_pylist())])], schema=schema)

    lists = found.groupBy("key").applyInArrow(merge, "key binary, ids array<long>, scores array<double>, scored long")
    each = rows.where("asks").select("key", F.col("id").alias("query_id")).distinct().join(lists, "key")
    pairs = F.filter(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score")), lambda x: x["id"] != F.col("query_id"))
    near = each.select("query_id", "scored", F.posexplode(F.slice(pairs, 1, k)).alias("rank", "x"))
    return near.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"), "scored")
