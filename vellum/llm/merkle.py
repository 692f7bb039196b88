"""A Merkle manifest of a table, with a proof for every row.

A row's leaf is the digest of its fields. Leaves of a language, in the order of ids, are
joined two by two, a last one alone, up to the language's root; the languages' roots are
joined likewise up to the root of the table. A row's proof is the digests beside its way
up, and folding its leaf with them must give the root.

Trees are made in blocks of WIDTH neighbours, one block a group: a block gives all its
nodes up to the one that stands for it, and these are the leaves of the next round. So a
round moves each node once, a tree of 10^12 rows takes four rounds, and no group is larger
than a block, however many rows one language has. Proofs go the other way: from the
top round down, a unit's way up is its own coordinates within its block (its place and its
tree's size tell which siblings there are), joined with the table of nodes, and then the
way of its block. Nothing but the size of the largest tree reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.columns import shared_folder

#: Levels that a round climbs, and nodes of a block.
LEVELS = 10
WIDTH = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WAY = "array<struct<digest:binary,left:boolean>>"
NODES = "grp string, size long, level int, pos long, digest binary"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256, as lower-case hex, of the fields one after the other: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    one = lambda s: F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[one(f.cast("string")) for f in fields]), 256)


def ranked(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """The rows (grp and others) with pos, their place in their grp by ``order`` from 0, and size, the grp's rows.

    Places are counted in range partitions, which cut large groups, and shifted by the
    partitions before; rows that tie in everything are told apart by an arbitrary number.
    """
    names = rows.columns
    cut = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("grp", *order, "_tie").sortWithinPartitions("grp", *order, "_tie").drop("_tie").withColumn("_part", F.spark_partition_id())
    at = names.index("grp")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(at))
            ends, values = runs.run_ends.to_numpy(), runs.values.to_pylist()
            local, start = np.arange(b.num_rows, dtype=np.int64), 0
            for end, value in zip(ends.tolist(), values, strict=True):
                count = count if value == last else 0
                local[start:end] += count - start
                last, count, start = value, count + end - start, end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "_local"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    cut.mapInArrow(numbered, f"{fields}, _local long").write.parquet(f"{folder}/cut")
    cut = rows.sparkSession.read.parquet(f"{folder}/cut")
    parts = cut.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_n"))
    shifts = parts.select("grp", "_part", (F.sum("_n").over(W.partitionBy("grp").orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy("grp")).alias("size"))
    return cut.join(shifts, ["grp", "_part"]).select(*names, (F.col("_before") + F.col("_local")).alias("pos"), "size")


def block() -> Column:
    return F.shiftright("pos", LEVELS)


def height(size: Column) -> Column:
    """Levels above the leaves of a tree: 0 for one leaf."""
    return F.when(size > 1, F.length(F.conv((size - 1).cast("string"), 10, 2))).otherwise(F.lit(0)).cast("int")


def climbed(table: pa.Table) -> pa.Table:
    """All nodes of a block below the one that stands for it, which has the highest level: its place is the block's."""
    table = table.sort_by("pos")
    grp, size, first = table["grp"][0].as_py(), table["size"][0].as_py(), table["pos"][0].as_py()
    own = [d.hex().encode() for d in table["digest"].to_pylist()]
    levels, poss, digests = [], [], []
    for level in range(min(LEVELS, (size - 1).bit_length()) + 1):
        if level:
            own = [hashlib.sha256(own[i] + own[i + 1] if i + 1 < len(own) else own[i]).hexdigest().encode() for i in range(0, len(own), 2)]
        levels += [level] * len(own)
        poss += range(first >> level, (first >> level) + len(own))
        digests += [bytes.fromhex(d.decode()) for d in own]
    n = len(levels)
    return pa.table([pa.array([grp] * n, pa.string()), pa.array([size] * n, pa.int64()), pa.array(levels, pa.int32()), pa.array(poss, pa.int64()), pa.array(digests, pa.binary())], names=["grp", "size", "level", "pos", "digest"])


class Forest:
    """The nodes of many trees, in rounds; ``units[r]`` (grp, size, pos, digest and, of leaves, more) are what round r starts from."""

    def __init__(self, leaves: DataFrame, folder: str):
        spark, self.units, self.nodes, tops = leaves.sparkSession, [leaves], [], []
        largest = leaves.agg(F.max("size")).first()[0] or 0
        while True:
            made = self.units[-1].select("grp", "size", "pos", "digest", block().alias("block")).groupBy("grp", "block").applyInArrow(climbed, NODES)
            made.write.parquet(f"{folder}/nodes-{len(self.nodes)}")
            nodes = spark.read.parquet(f"{folder}/nodes-{len(self.nodes)}")
            self.nodes.append(nodes)
            top = nodes.where(F.col("level") == F.least(F.lit(LEVELS), height(F.col("size")))).select("grp", F.ceil(F.col("size") / WIDTH).alias("size"), "pos", "digest")
            tops.append(top.where("size = 1").select("grp", "digest"))
            largest = -(-largest // WIDTH)
            if largest <= 1:
                break
            self.units.append(top.where("size > 1"))
        #: (grp, digest) of the roots of all trees, by the round that gave them.
        self.tops = tops

    def ways(self, above: DataFrame) -> DataFrame:
        """The leaves with their columns, ``way`` and the columns of ``above``.

        above: (grp, way, ...) of every root, what follows upwards of it. A way is an array
        of (digest, left) from below to above, null digests where a node is alone.
        """
        more = [c for c in above.columns if c not in ("grp", "way")]
        upper: DataFrame | None = None
        for r in range(len(self.units) - 1, -1, -1):
            parents = above.join(self.tops[r].select("grp"), "grp").withColumn("block", F.lit(0).cast("long"))
            if upper is not None:
                parents = upper.select("grp", "way", *more, F.col("pos").alias("block")).unionByName(parents)
            upper = self._within(r, parents, more)
        return upper

    def _within(self, r: int, parents: DataFrame, more: list[str]) -> DataFrame:
        """Units with the way from each of them to its block's node, and on: blocks of units meet their nodes and the way of their parent, which is a row of its own among the nodes."""
        units, nodes = self.units[r], self.nodes[r]
        below = nodes.where(F.col("level") < F.least(F.lit(LEVELS), height(F.col("size")))).select("grp", F.expr(f"shiftright(shiftleft(pos, level), {LEVELS})").alias("block"), "level", "pos", "digest")
        sides = below.unionByName(parents.select("grp", "block", F.struct("way", *more).alias("above")), allowMissingColumns=True)
        types = {f.name: f.dataType.simpleString() for f in units.schema.fields} | {f.name: f.dataType.simpleString() for f in parents.schema.fields}
        kept = units.columns
        names = [*kept, *more]
        fields = ", ".join(f"`{c}` {types[c]}" for c in names) + f", way {WAY}"

        def met(own: pa.Table, beside: pa.Table) -> pa.Table:
            is_node = pc.is_valid(beside["level"])
            found, parent = beside.filter(is_node).sort_by([("level", "ascending"), ("pos", "ascending")]), beside.filter(pc.invert(is_node))["above"].to_pylist()[0]
            level, pos, digests = found["level"].to_numpy(), found["pos"].to_numpy(), found["digest"].to_pylist()
            starts = np.searchsorted(level, np.arange(LEVELS + 1))
            place, height_ = own["pos"].to_numpy(), int(level.max()) + 1 if len(level) else 0
            # the sibling's coordinates of every unit and level, and where the sorted nodes have them
            sibling = (place[:, None] >> np.arange(height_)) ^ 1
            first, count = (pos[starts[:height_]], np.diff(starts)[:height_]) if height_ else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            offset = sibling - first
            at = np.where((offset >= 0) & (offset < count), starts[:height_] + offset, -1).tolist()
            lefts = (sibling & 1 == 0).tolist()
            ways = [[*({"digest": digests[a] if a >= 0 else None, "left": s} for a, s in zip(x, y, strict=True)), *parent["way"]] for x, y in zip(at, lefts, strict=True)]
            n = len(own)
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("left", pa.bool_())]))
            columns = [*(own[c] for c in kept), *(pa.array([parent[c]] * n, beside.schema.field("above").type.field(c).type) for c in more), pa.array(ways, kind)]
            return pa.table(columns, names=[*names, "way"])

        own = units.withColumn("block", block())
        return own.groupBy("grp", "block").cogroup(sides.groupBy("grp", "block")).applyInArrow(met, fields)


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""
    text = lambda s: F.lower(F.hex(s["digest"]))
    return F.aggregate(way, leaf, lambda h, s: F.sha2(F.when(s["digest"].isNull(), h).when(s["left"], F.concat(text(s), h)).otherwise(F.concat(h, text(s))), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` (a condition on doc_id, source, lang, n_chars, text) picks rows whose
    n_chars is read one greater when the proof is checked. Digests are lower-case hex;
    proof_sha256 is that of all digests of the proof, of nothing where a row is alone.
    Null ids come first and are never tampered with, nor are null n_chars; null is a
    language of its own, before all others. Rows with one id stand in the order of their
    leaves; repeated rows repeat. An empty table gives no rows; columns other than those
    named are not looked at.
    """
    folder = shared_folder(docs.sparkSession)
    c = {f: F.col(f) for f in FIELDS}
    leaf = leaf_digest(*c.values())
    changed = leaf_digest(*[(c[f] + 1 if f == "n_chars" else c[f]) for f in FIELDS])
    flag = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select(F.when(c["lang"].isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c["lang"])).alias("grp"), F.unhex(leaf).alias("digest"), c["doc_id"].alias("id"), F.when(flag, F.unhex(changed)).alias("other"))
    ranked(rows, ["id", "digest"], f"{folder}/rows").write.parquet(f"{folder}/leaves")
    trees = Forest(docs.sparkSession.read.parquet(f"{folder}/leaves"), f"{folder}/trees")
    roots = trees.tops[0]
    for t in trees.tops[1:]:
        roots = roots.union(t)
    one = ranked(roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"], f"{folder}/roots")
    one.write.parquet(f"{folder}/subroots")
    whole = Forest(docs.sparkSession.read.parquet(f"{folder}/subroots"), f"{folder}/root")
    none = F.array().cast(WAY)
    end = whole.tops[-1].select("grp", none.alias("way"), F.col("digest").alias("root"))
    above = whole.ways(end).select(F.col("of").alias("grp"), "way", F.col("digest").alias("subroot"), "root")
    hex_ = lambda x: F.lower(F.hex(x))
    out = trees.ways(above).select(
        F.col("id").alias("doc_id"), hex_("digest").alias("leaf"), hex_("subroot").alias("subroot"), hex_("root").alias("root"),
        F.sha2(F.array_join(F.transform("way", lambda s: hex_(s["digest"])), ""), 256).alias("proof_sha256"), folded(hex_(F.coalesce("other", "digest")), F.col("way")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
