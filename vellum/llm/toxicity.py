"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text: each
holds the words that recur over its documents, the most frequent ones last, and what
ordinary text says as often is left out of the toxic one. A window of WINDOW words is
compressed twice, with the ordinary dictionary and with both; its gain is the bytes that
the toxic one saves less those that it leaves. Toxic wording gains several bytes, other
wording loses, as a rare word costs the same twice. A document's evidence is how many of its windows gain at least so
many bytes, for each of GAINS; weights on these counts and the offset, the threshold, are
calibrated on labelled documents that the dictionaries haven't seen.

(zstandard's own trainer cuts segments at any byte: on 8000 labelled documents its
dictionaries of the same words gave a gain of 4 bytes to 95 % of toxic documents and
0.6 % of others, whole words to all and 0.9 %, and of two such windows to 86 % and 99 %.)

Windows stand between two marks that both dictionaries end with, as the format saves
nothing on the last bytes of a short input and pays a few bytes for the first match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.columns import shared_folder, text_slices, trimmed
from vellum.llm.line_quality import held_out

#: Labelled documents of each label that a fit uses at most, words of a window, bytes of each dictionary at most.
SAMPLE, WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 4000, 1, 200_000, 32_000
#: Documents that a word of a dictionary is in at least, and one in how many of its label's.
RECURS, SHARE = 3, 100
GAINS = (1, 2, 3, 4, 6, 8)
THRESHOLD = 0.5
#: Windows whose gain a task remembers.
KNOWN = 200_000
WORD = re.compile(r"[^\W\d_]+")
MARK = b"\x00window\x01of\x02text\x03"


def words(text: str) -> list[str]:
    """The runs of letters, in lower case."""
    return WORD.findall(text.lower())


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """With the search that looks everywhere in the dictionary, so that a window's length depends on nothing else."""
    dictionary = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        window_log=18, hash_log=17, chain_log=18, search_log=9, min_match=4, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2,
    )
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@dataclass
class Model:
    """ordinary, toxic: contents of the dictionaries; weights: of the log-counts of GAINS and of 1, for "toxic"."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    _made: tuple | None = field(default=None, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights = state
        self._made, self._known = None, {}

    def gain(self, window: str) -> int:
        """Bytes that the toxic dictionary saves on a window, less what it still takes beyond the marks."""
        got = self._known.get(window)
        if got is None:
            if self._made is None:
                one, both = compressor(self.ordinary), compressor(self.ordinary + self.toxic)
                self._made = one, both, len(both.compress(MARK + b" " + MARK))
            if len(self._known) >= KNOWN:
                self._known.clear()
            x = MARK + b" " + window.encode("utf-8", "replace") + b" " + MARK
            one, both, base = self._made
            left = len(both.compress(x))
            got = self._known[window] = len(one.compress(x)) - left - max(0, left - base)
        return got

    def evidence(self, text: str) -> np.ndarray:
        """Logarithms of one more than the windows that gain at least each of GAINS, then 1."""
        own = words(text)
        if not self.toxic or not own:
            counts = [0] * len(GAINS)
        else:
            windows = own if WINDOW == 1 else [" ".join(own[i : i + WINDOW]) for i in range(max(1, len(own) - WINDOW + 1))]
            gains = [g for g in map(self.gain, windows) if g >= GAINS[0]]
            counts = [sum(g >= t for g in gains) for t in GAINS]
        return np.array([*np.log1p(counts), 1.0])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.evidence(text) @ self.weights, -30, 30))))


def dictionary(counts: list[tuple[str, int]], most: int) -> bytes:
    """Words by how many documents they are in, the most frequent ones last, as near matches are cheapest; the rarest are left out beyond ``most`` bytes."""
    out, size = [], 0
    for w, _ in sorted(counts, key=lambda c: (-c[1], c[0])):
        piece = f" {w} ".encode()
        if size + len(piece) > most:
            break
        out.append(piece)
        size += len(piece)
    return b"".join(reversed(out))


def calibrated(x: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression with a small penalty, by Newton's steps; evidence never speaks for the other side."""
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else 8.0 if y[0] else -8.0
        return np.array([*np.zeros(x.shape[1] - 1), base])
    keep = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(keep.sum())
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, keep] @ w, -30, 30)))
            h = (x[:, keep] * (p * (1 - p))[:, None]).T @ x[:, keep] / len(y) + decay * np.eye(len(w))
            step = np.linalg.solve(h, x[:, keep].T @ (y - p) / len(y) - decay * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        wrong = (w[:-1] < 0).nonzero()[0]
        if not len(wrong):
            break
        keep[np.flatnonzero(keep[:-1])[wrong]] = False
    out = np.zeros(x.shape[1])
    out[keep] = w
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that are not held out, of each label at most ``sample`` by the least hash of the id.

    Three quarters of them train the dictionaries, the rest calibrates. Copies of a text
    count once. Labels that are null, and ids without a document or with several labels,
    are passed over; without both labels every score is the same. The driver gets words
    up to the dictionaries' sizes and a row of counts for each calibrating document.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_other")).where("_y = _other").select("_id", "_y", F.xxhash64("_id").alias("_h"))
    known = known.where("_y = 0").orderBy("_h", "_id").limit(sample).union(known.where("_y = 1").orderBy("_h", "_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(known), "_id")  # at most twice `sample` rows
    rows = rows.groupBy("_y", F.sha2("_text", 256).alias("_sum")).agg(F.min(F.struct("_h", "_id", "_text")).alias("x")).select("_y", (F.pmod("x._h", F.lit(4)) == 0).alias("_late"), "x._text")
    folder = shared_folder(docs.sparkSession)
    rows.write.parquet(f"{folder}/sample")
    rows = docs.sparkSession.read.parquet(f"{folder}/sample")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, str]]:
        for b in batches:
            ys, late = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, texts in text_slices(b, "_text"):
                yield from zip(ys[start:], late[start:], texts, strict=False)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, late, text in each(batches):
            own = [] if late else sorted(set(words(text)))
            if not late:
                yield pa.RecordBatch.from_arrays([pa.array([y] * (len(own) + 1), pa.int32()), pa.array([*own, None], pa.string())], names=["y", "word"])

    found = rows.mapInArrow(trimmed(distinct), "y int, word string")
    found.groupBy("word").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).write.parquet(f"{folder}/words")
    counts = docs.sparkSession.read.parquet(f"{folder}/words")
    total = counts.where("word is null").first()
    n0, n1 = (total.n0, total.n1) if total else (0, 0)
    enough = max(RECURS, n1 // SHARE)
    usual = max(2.0, enough * n0 / max(1, 4 * n1))  # a quarter of the toxic words' share makes a word ordinary
    counts = counts.where("word is not null").select("word", "n0", "n1", (F.col("n0") >= usual).alias("usual"))
    # the shortest word takes three bytes
    plain = counts.where("usual").orderBy(F.desc("n0"), "word").limit(ORDINARY_BYTES // 3).collect()
    toxic = counts.where(f"not usual and n1 >= {enough}").orderBy(F.desc("n1"), "word").limit(TOXIC_BYTES // 3).collect()
    size = len(GAINS) + 1
    model = Model(dictionary([(r.word, r.n0) for r in plain], ORDINARY_BYTES), dictionary([(r.word, r.n1) for r in toxic], TOXIC_BYTES), np.zeros(size))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, _, text in each(batches):
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([model.evidence(text).tolist()], pa.list_(pa.float64()))], names=["y", "x"])

    got = sorted((tuple(r.x), r.y) for r in rows.where("_late").mapInArrow(trimmed(counted), "y int, x array<double>").collect())
    model.weights = calibrated(np.array([x for x, _ in got]).reshape(-1, size), np.array([y for _, y in got]))
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score.

    The score is between 0 and 1, higher where label 1 is likelier, and depends on the
    text alone. A null or empty text, or one without letters, has no evidence; repeated
    rows repeat; an empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in text_slices(b, "_text"):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array([model.score(t) for t in texts], pa.float64())], names=["_id", "score"])

    out = rows.mapInArrow(trimmed(score), f"_id {rows.schema['_id'].dataType.simpleString()}, score double")
    return out.select(F.col("_id").alias(id_col), "score")
