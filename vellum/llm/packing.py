"""Mixture-controlled packing of tokenized documents into sequences.

Deficit round-robin over one queue a source: in every window each queue is due its
share of the tokens, and what rounding leaves owing (the deficit) is carried to the
next window, so every prefix of windows holds the target proportions to within a few
tokens a queue. A queue that runs dry drops out and the others share its part.

The turns of the round-robin depend only on the queues' totals, so they are worked out
for any window without running the ones before it: token j of queue s falls due at
time (j + 1/2) / share, and window w ends at the time by which (w + 1) * size tokens
are due. A partition of documents can thus be packed by itself once the tokens of its
queues before it are known; these counts are all that crosses partitions.

Two passes: the first tokenizes and writes the ids once to the shared folder, with
each document's place in its partition's part of the queue; the second adds the
tokens of earlier partitions and cuts. Ids are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.bpe import vocabulary
from vellum.llm.columns import shared_folder, table_of, text_slices, trimmed

SIZE = 4096
END_ID = 2
#: With more sources than this, those without a target share of their own share queues, by a hash: a queue is a group of sources then.
QUEUES = 1024
#: Of the table of counts before each partition; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


class Schedule:
    """Which tokens of which queue each window takes.

    ``totals``: tokens by queue; ``shares``: target proportions (default: as the totals
    are, so that all queues run dry together). Queues without a share come last.
    """

    def __init__(self, totals: np.ndarray, shares: np.ndarray | None = None, size: int = SIZE):
        self.totals, self.size = np.asarray(totals, np.int64), size
        w = self.totals.astype(float) if shares is None else np.asarray(shares, float)
        self.total = int(self.totals.sum())
        w = np.where(self.totals > 0, w, 0.0)
        first = w > 0
        if first.any() and (self.totals[~first] > 0).any():  # the rest starts to matter only once the others are all but done
            w = np.where(first, w, self.totals / max(1, self.total) * w[first].min() * 1e-9)
        self.share = np.where(self.totals > 0, w / max(w.sum(), 1e-300), 1.0)
        dry = np.sort(self.totals / self.share)
        self.times = np.concatenate([[0.0], dry])
        self.due = np.minimum(self.share * self.times[:, None], self.totals).sum(1)
        self.full = self.total // size

    def _counts(self, t: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(self.share * t[:, None] + 0.5).astype(np.int64), self.totals)

    def taken(self, windows: np.ndarray) -> np.ndarray:
        """Tokens by queue that all windows before each given one take; sums to windows * size, or to the total."""
        want = np.minimum(windows.astype(np.int64) * self.size, self.total)
        n = len(self.totals)
        lo = np.maximum(np.interp(np.maximum(want - n, 0), self.due, self.times) - 1e-9, 0)
        lo, hi = np.where(want > n, lo, 0.0), np.interp(np.minimum(want + n, self.total), self.due, self.times) + 1 / self.share.min()
        lo = np.where(self._counts(lo).sum(1) <= want, lo, 0.0)
        for _ in range(64):
            mid = (lo + hi) / 2
            over = self._counts(mid).sum(1) > want
            lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
        least, most = self._counts(lo), self._counts(hi)
        owed = want - least.sum(1)  # of queues whose next tokens fall due at the same time, the first ones are served
        room = most - least
        before = np.cumsum(room, 1) - room
        return least + np.clip(owed[:, None] - before, 0, room)

    def near(self, queue: int, first: int, last: int) -> tuple[int, int]:
        """A range of windows that surely holds the queue's tokens first to last."""
        n = len(self.totals)
        at = [float(np.interp(t / self.share[queue], self.times, self.due)) for t in (first - 1, last + 2)]
        return max(0, int((at[0] - 2 * n) // self.size) - 1), min(self.full + 1, int((at[1] + 2 * n) // self.size) + 2)


def tail_pieces(rest: int) -> list[int]:
    """Lengths of the sequences that hold the last tokens: powers of two, so without padding."""
    return [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def cut(schedule: Schedule, queue: int, start: int, length: int, windows: np.ndarray, taken: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of the pieces of a document at ``start`` of its queue.

    windows: consecutive; taken: of this queue by window; offsets: where this queue's part of each window begins.
    """
    out, at, end = [], start, start + length
    i = int(np.searchsorted(taken, at, side="right")) - 1
    while at < end:
        stop = min(end, int(taken[i + 1]))
        if stop > at:
            w, off = int(windows[i]), int(offsets[i]) + at - int(taken[i])
            if w < schedule.full:
                out.append((at - start, stop - at, w, off))
            else:  # the last, partial window: sequences of powers of two
                base, a = 0, at
                for k, n in enumerate(tail_pieces(schedule.total % schedule.size)):
                    if off < base + n and a < stop:
                        m = min(stop - a, base + n - off)
                        out.append((a - start, m, w + k, off - base))
                        a, off = a + m, off + m
                    base += n
            at = stop
        i += 1
    return out


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, queue: str, folder: str) -> DataFrame:
    """Writes and rereads (_id, queue, part, before, n, ids); before: tokens of the queue earlier in the partition."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(queue).alias("queue"))
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part, so_far = vocabulary(path), TaskContext.get().partitionId(), {}
        narrow = "<u2" if max(v.token) < 65536 else "<u4"
        for b in batches:
            queues = b.column(2).to_pylist()
            for start, texts in text_slices(b, "_text"):
                before, n, ids = [], [], []
                for q, (x, _) in zip(queues[start : start + len(texts)], v.encode(texts), strict=True):
                    before.append(so_far.get(q, 0))
                    n.append(len(x) // 4 + 1)
                    so_far[q] = before[-1] + n[-1]
                    ids.append(np.frombuffer(x, "<u4").astype(narrow).tobytes())
                made = table_of(schema, part=[part] * len(n), before=before, n=n, ids=ids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), b.column(2).slice(start, len(texts)), *made.columns], names=["_id", "queue", *schema.names])

    kind = rows.schema["_id"].dataType.simpleString()
    made = rows.mapInArrow(trimmed(encode), f"_id {kind}, queue string, part int, before long, n long, ids binary")
    made.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shares: Mapping[str, float] | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    Each document's ids and the end id lie in exactly one piece each; sequences are full,
    but for the last tokens, which make sequences of powers of two: nothing is padded. A
    null text is an empty one (its end id alone is packed), a null source a queue named
    ``""``; repeated rows are packed each for itself; an empty table gives no rows. Other
    columns of ``docs`` are not looked at. ``shares``: target proportions by source,
    sources without one come last; None keeps the proportions that the documents have.
    With more than QUEUES sources those without a target are put into that many queues
    by a hash, and each such queue has the share of all its sources; targets hold as
    ever, for any number of sources.
    The pieces' order within a window is that of the queues' names.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(source_col), F.lit(""))
    if docs.select(name.alias("q")).distinct().limit(QUEUES + 1).count() > QUEUES:
        shared = F.concat(F.lit("#"), F.pmod(F.xxhash64(name), F.lit(QUEUES)).cast("string"))
        name = F.when(name.isin(list(shares)), name).otherwise(shared) if shares else shared
    folder = shared_folder(spark)
    ids = tokenized(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), name.alias("_queue")), path, "_id", "_text", "_queue", f"{folder}/ids")
    counts = ids.groupBy("part", "queue").agg(F.sum("n").alias("tokens"))
    counts.select("part", "queue", "tokens", (F.sum("tokens").over(W.partitionBy("queue").orderBy("part")) - F.col("tokens")).alias("earlier")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    totals = {r.queue: r.n for r in counts.groupBy("queue").agg(F.sum("tokens").alias("n")).orderBy("queue").collect()}  # a row a queue
    names = sorted(totals)
    index = {q: i for i, q in enumerate(names)}
    plan = Schedule(np.array([totals[q] for q in names], np.int64), None if shares is None else np.array([shares.get(q, 0.0) for q in names]), size)
    earlier = counts.select("part", "queue", "earlier")
    placed = ids.join(F.broadcast(earlier) if counts.count() <= BROADCAST_ROWS else earlier, ["part", "queue"]).select("_id", "queue", (F.col("earlier") + F.col("before")).alias("at"), "n", "ids")
    schema = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                queues, at, n = b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy()
                turns = {}
                for q in set(queues):
                    own = np.array([x == q for x in queues])
                    k = index[q]
                    # a queue's documents of a batch lie side by side, but where rows were shuffled on the way here
                    order = np.flatnonzero(own)[np.argsort(at[own], kind="stable")]
                    runs = np.split(order, np.flatnonzero(at[order][1:] > (at + n)[order][:-1] + 16 * size) + 1)
                    for run in runs:
                        lo, hi = plan.near(k, int(at[run[0]]), int((at + n)[run].max()))
                        windows = np.arange(lo, hi + 1)
                        taken = plan.taken(windows)
                        part = np.diff(taken, axis=0)
                        offsets = part[:, :k].sum(1)
                        for i in run.tolist():
                            turns[i] = k, windows, taken[:, k], offsets
                out: list[tuple] = []
                of: list[int] = []
                for i in range(b.num_rows):
                    raw = b.column(4)[i].as_py()
                    x = np.concatenate([np.frombuffer(raw, "<u2" if len(raw) == 2 * (n[i] - 1) else "<u4").astype("<u4"), end])
                    k, windows, taken, offsets = turns[i]
                    for start, length, seq, off in cut(plan, k, int(at[i]), int(n[i]), windows, taken, offsets):
                        out.append((start, length, zlib.crc32(x[start : start + length]), int(n[i]), seq, off))
                        of.append(i)
                made = table_of(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                keys = b.select(["_id", "queue"]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([keys.column(0), *made.columns, keys.column(1)], names=["_id", *schema.names, "queue"])

    kind = placed.schema["_id"].dataType.simpleString()
    return placed.mapInArrow(trimmed(pieces), f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string").withColumnRenamed("_id", id_col)
