"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are its own surface statistics
and those of its neighbouring lines; the labels of neighbouring lines are tied by
transition weights. The marginal probability of "good" of each line comes from the
forward-backward recursion, and a document's score is the mean of its lines'
marginals, weighted by their lengths.

Training: the lines of a labelled document carry the document's label. The fit uses
at most SAMPLE labelled documents, those with the smallest hash of their id, and of
their chains of CHAIN lines at most CHAINS, those with the smallest hash of id and
number; it runs in numpy on the driver, which thus gets at most CHAIN * CHAINS lines,
about 100 MB, however long documents are. (A line's neighbours are seen across the ends
of a chain; only the tie between two chains is not learnt from.) Features are made on
the executors, where the sampled documents are also scored whole, for the score's scale
and shift. Scoring is one narrow pass over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.columns import table_of, text_slices, trimmed

#: Labelled documents that a fit uses at most, lines of a chain, chains that a fit uses at most.
SAMPLE, CHAIN, CHAINS = 4000, 32, 16384
THRESHOLD = 0.3
NAMES = ("upper", "symbols", "bars", "bangs", "digits", "marks", "repeats", "distinct", "words", "word length", "capitals", "short lines", "wide letters")
SYMBOLS = re.compile(r"[#$%&*@^~_=+<>\\{}\[\]]")
MARKS = re.compile(r"[.,;:?]")
DIGITS = re.compile(r"\d")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def line_features(line: str) -> list[float]:
    """The surface statistics named in NAMES; each between 0 and about 1."""
    n, words = len(line), line.split()
    k = len(words)
    if not k:
        return [0.0] * 11 + [1.0, 0.0]
    letters = max(1, n - k)
    return [
        len(UPPER.findall(line)) / letters if not line.islower() else 0.0,
        min(1.0, 4 * len(SYMBOLS.findall(line)) / letters),
        min(1.0, 2 * line.count("|") / k),
        min(1.0, line.count("!") / k),
        len(DIGITS.findall(line)) / letters,
        min(1.0, 4 * len(MARKS.findall(line)) / letters),
        sum(map(eq, words, words[1:])) / k,
        len(set(words)) / k if k > 20 else 1.0,
        min(1.0, k / 100),
        min(1.0, n / k / 20),
        sum(map(str.isupper, words)) / k,
        1.0 if k < 4 else 0.0,
        0.0 if line.isascii() else 1.0,
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', lengths). A text without lines is one empty line."""
    lines = text.split("\n")
    own = np.array([line_features(x) for x in lines], np.float64)
    edge = np.zeros((1, own.shape[1]))
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    ends = np.zeros((len(lines), 2))
    ends[0, 0] = ends[-1, 1] = 1.0
    return np.hstack([np.ones((len(lines), 1)), own, before, after, ends]), np.array([len(x) for x in lines], np.float64)


@dataclass
class Model:
    """weights: of the features for "good" against "bad"; ties: transition scores between (bad, good); scale, shift: of the score's logit."""

    weights: np.ndarray
    ties: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def good(self, text: str) -> float:
        """The marginals of "good" of all lines, weighted by their lengths."""
        features, lengths = document_features(text)
        weight = np.maximum(lengths, 1.0)
        return float(marginals(features @ self.weights, self.ties) @ weight / weight.sum())

    def score(self, text: str) -> float:
        p = self.good(text)
        logit = np.log(max(p, 1e-12) / max(1 - p, 1e-12))
        return float(1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30))))


def marginals(emission: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward; emission: log-odds of good from the features."""
    n = len(emission)
    e = 1 / (1 + np.exp(-np.clip(emission, -30, 30)))
    (bb, bg), (gb, gg) = np.exp(ties).tolist()
    ahead, out, x = [], [0.0] * n, None
    for p in e.tolist():  # P(good) of the lines up to here
        q = p if x is None else (r := p * ((1 - x) * bg + x * gg)) / (r + (1 - p) * ((1 - x) * bb + x * gb))
        ahead.append(q)
        x = q
    back = 0.5
    for i in range(n - 1, -1, -1):
        f = ahead[i]
        g, b = f * back, (1 - f) * (1 - back)
        out[i] = g / (g + b) if g + b > 0 else 0.5
        p = float(e[i])
        g, b = p * back, (1 - p) * (1 - back)  # to the line before: what it sees of this one and all after
        to_g, to_b = gg * g + gb * b, bg * g + bb * b
        back = to_g / (to_g + to_b) if to_g + to_b > 0 else 0.5
    return np.array(out)


def _gradient(x: np.ndarray, length: np.ndarray, y: np.ndarray, w: np.ndarray, ties: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of padded documents whose lines all carry their document's label, and its gradient.

    x: documents x lines x features; length: lines of each; y: labels.
    """
    n, t, _ = x.shape
    on = np.arange(t) < length[:, None]
    e = np.stack([np.zeros((n, t)), x @ w], 2)
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    ahead, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    ahead[:, 0] = e[:, 0]
    for i in range(1, t):
        ahead[:, i] = np.where(on[:, i, None], lse(ahead[:, i - 1, :, None] + ties, 1) + e[:, i], ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        back[:, i] = np.where(on[:, i + 1, None], lse(ties + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2), 0.0)
    z = lse(ahead[np.arange(n), length - 1], 1)
    p = np.exp(np.clip(ahead + back - z[:, None, None], -50, 0))
    gold = np.where(y == 1, (e[..., 1] * on).sum(1), 0.0) + ties[y, y] * (length - 1)
    d = ((y[:, None] - p[..., 1]) * on)[..., None]
    pair = np.exp(np.clip(ahead[:, :-1, :, None] + ties + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None], -50, 0)) * on[:, 1:, None, None]
    g = -pair.sum((0, 1))
    g[0, 0] += ((y == 0) * (length - 1)).sum()
    g[1, 1] += ((y == 1) * (length - 1)).sum()
    return float((gold - z).sum()), (d * x).sum((0, 1)), g


def train(chains: list[tuple[np.ndarray, int]], steps: int = 150, decay: float = 1e-3) -> Model:
    """Fits weights and ties by Adam on the penalised likelihood.

    chains: (features, label). With one label only, or none, the model scores everything
    1 or 0, or 0.5.
    """
    labels = {y for _, y in chains}
    size = 1 + 3 * len(NAMES) + 2
    if len(labels) < 2:
        return Model(np.zeros(size), np.zeros((2, 2)), 0.0, 0.0 if not labels else 20.0 if labels == {1} else -20.0)
    chains = sorted(chains, key=lambda c: len(c[0]))
    groups = []
    for i in range(0, len(chains), 512):
        part = chains[i : i + 512]
        t = max(len(f) for f, _ in part)
        x = np.zeros((len(part), t, size))
        for k, (f, _) in enumerate(part):
            x[k, : len(f)] = f
        groups.append((x, np.array([len(f) for f, _ in part]), np.array([y for _, y in part])))
    theta, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, steps + 1):
        g = -decay * len(chains) * theta
        for x, n, y in groups:
            _, gw, gt = _gradient(x, n, y, theta[:size], theta[size:].reshape(2, 2))
            g += np.concatenate([gw, gt.ravel()])
        g /= len(chains)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:size], theta[size:].reshape(2, 2))


def calibrated(model: Model, p: np.ndarray, y: np.ndarray) -> Model:
    """The model with the scale and shift that fit the labels y of documents with the marginals p, with a little of both classes everywhere."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    logit, a, b = np.log(p / (1 - p)), 1.0, 0.0
    for _ in range(300):
        q = 1 / (1 + np.exp(-(a * logit + b)))
        a, b = a - 0.05 * (((q - y) * logit).mean() + 0.01 * (a - 1)), b - 0.05 * ((q - y).mean() + 0.01 * b)
    return Model(model.weights, model.ties, max(a, 0.05), b)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that are not held out, at most ``sample`` of them by the least hash of the id.

    Labels that are null, and ids without a document or with several, are passed over.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_other")).where("_y = _other").orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_id", "_y")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(known), "_id")  # at most `sample` rows
    schema, width = pa.schema([("id", pa.string()), ("y", pa.int32()), ("no", pa.int64()), ("features", pa.binary())]), 1 + 3 * len(NAMES) + 2

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
        for b in batches:
            ys, ids = b.column(b.schema.get_field_index("_y")).to_pylist(), b.column(b.schema.get_field_index("_id")).to_pylist()
            for start, texts in text_slices(b, "_text"):
                yield from zip(map(str, ids[start:]), ys[start:], texts, strict=False)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, y, text in each(batches):
            f = document_features(text)[0].astype("<f4")
            chains = [f[i : i + CHAIN].tobytes() for i in range(0, len(f), CHAIN)]
            yield table_of(schema, id=[id_] * len(chains), y=[y] * len(chains), no=list(range(len(chains))), features=chains)

    chains = rows.mapInArrow(trimmed(features), "id string, y int, no long, features binary")
    got = chains.orderBy(F.xxhash64("id", "no"), "id", "no", "y", "features").limit(CHAINS).collect()
    model = train([(np.frombuffer(r.features, "<f4").astype(float).reshape(-1, width), r.y) for r in got])
    if not model.scale:
        return model

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, y, text in each(batches):
            yield pa.RecordBatch.from_pydict({"id": [id_], "y": pa.array([y], pa.int32()), "p": [model.good(text)]})

    got = rows.mapInArrow(trimmed(marginal), "id string, y int, p double").orderBy("id", "y", "p").collect()
    return calibrated(model, np.array([r.p for r in got]), np.array([r.y for r in got]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, score, and the columns that ``keep`` names.

    The score is between 0 and 1, higher where label 1 is likelier, and depends on the
    text alone. A null or empty text is one empty line; repeated rows repeat; an empty
    table gives no rows; columns not named are not looked at, whatever their names.
    """
    keep = keep or []
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)] or [F.lit(1).alias("k")]).alias("_keep"), F.col(text_col).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in text_slices(b, "_text"):
                made = pa.array([model.score(t) for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), b.column(1).slice(start, len(texts)), made], names=["_id", "_keep", "score"])

    types = dict((f.name, f.dataType.simpleString()) for f in rows.schema.fields)
    out = rows.mapInArrow(trimmed(score), f"_id {types['_id']}, _keep {types['_keep']}, score double")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep.k{i}").alias(c) for i, c in enumerate(keep)], "score")
