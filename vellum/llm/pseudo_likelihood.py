"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts every token of a document from the WINDOW tokens on its left and
right: ``softmax([tanh(sum of context[o][token at offset o] + inner), 1] out)``. A
document is scored by the sum of the log-probabilities of all its tokens, each masked in
turn, and by that sum a token, so that documents of different lengths compare.

The network's outcomes are word classes: the CLASSES - RARE - 1 words that lead the most
frequent hash buckets have a class each, which holds nothing else; other words share RARE
classes by their hash; class 0 stands for what lies beyond the document's edges. A shared
class is cut into subclasses by the words' hash, as many as its tokens fill at SHARE each,
so their number grows with the corpus. What is scored is always the word:

    P(word | window) = P(class | classes of the window) P(subclass | class) P(word | subclass, left, right)

The last factor comes from counts of whole words: how often the word stands between these
two, after the left one, before the right one, and alone, each less a DISCOUNT whose mass
goes to the next, and at last to an outcome for words never seen. These counts are as many
as the corpus has windows; they are dealt by subclass, and each subclass is counted and
scored where it lies.

The network is trained in numpy on every token of every document. Documents are dealt
into ROUNDS; in a round every task goes over its documents of that round in mini-batches,
by Adam, from the same network, and the round's network is the mean of the tasks', by
tokens. Small corpora are gone over several times, so that about LEAST tokens are seen.
Networks are summed on the executors; the driver gets one for each 4096 tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.columns import table_of, text_slices, trimmed, word_hashes

CLASSES, RARE, BUCKETS = 192, 16, 1 << 16
WINDOW, HIDDEN = 3, 16
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
#: Steps of Adam by round, documents' rounds, tokens of a mini-batch, tokens to see at least by going over all again, at most so often.
RATES, BATCH, LEAST, AGAIN = (0.02, 0.005), 2048, 2_000_000, 12
ONES = np.ones(CLASSES, np.float32)
#: Below this no sum of exponentials overflows, so their largest need not be taken off.
SAFE = 60.0
#: Tokens a subclass has about, tokens a task deals at a time, rows whose sums go together.
SHARE, DEALT, BLOCK = 1 << 20, 1 << 21, 1 << 12
DISCOUNT = 0.75


@dataclass
class Network:
    classes: np.ndarray  # of each bucket, uint8
    context: np.ndarray  # offsets x classes x HIDDEN
    inner: np.ndarray
    out: np.ndarray  # HIDDEN + 1 x classes: the bias is that of a hidden value that is always 1
    own: np.ndarray | None = None  # hash of each class's only word; without it whole buckets are classes
    totals: np.ndarray | None = None  # tokens of each class
    corpus: DataFrame | None = field(default=None, repr=False)  # the documents whose words are counted, by text
    text_col: str = "text"

    def subclasses(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of subclasses, number of the first one) of each class; 0 of classes of one word."""
        parts = np.where(np.arange(CLASSES) >= CLASSES - RARE, 1 + self.totals.astype(np.int64) // SHARE, 0)
        return parts, np.cumsum(parts) - parts

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.inner, self.out]

    def copied(self, flat: np.ndarray | None = None) -> Network:
        """The same network with parameters of its own, or with those of one vector."""
        shapes = [p.shape for p in self.parameters()]
        flat = np.concatenate([p.ravel() for p in self.parameters()]) if flat is None else flat.astype(np.float32)
        cuts = np.cumsum([int(np.prod(x)) for x in shapes])[:-1]
        return Network(self.classes, *[p.reshape(x).copy() for p, x in zip(np.split(flat, cuts), shapes, strict=True)], self.own, self.totals)

    def hidden(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """tokens x HIDDEN + 1; padded: classes of texts with WINDOW zeros around each, at: places in it."""
        out = np.ones((len(at), HIDDEN + 1), np.float32)
        h = self.inner + self.context[0][padded[at + OFFSETS[0]]]
        for o, x in zip(OFFSETS[1:], self.context[1:], strict=True):
            h += x[padded[at + o]]
        np.tanh(h, out=out[:, :HIDDEN])
        return out

    def outcomes(self, h: np.ndarray) -> np.ndarray:
        """tokens x classes: what the softmax is taken of, up to a number by token."""
        z = h @ self.out
        if np.abs(self.out).sum(0).max() > SAFE:  # hidden values are within one
            z -= z.max(1, keepdims=True)
        return z

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """That of the class of each of these tokens."""
        z = self.outcomes(self.hidden(padded, at))
        own = z[np.arange(len(at)), padded[at]]
        return own - np.log(np.exp(z, out=z) @ ONES)


def classed(h: np.ndarray, classes: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Classes of hashed words. A word in the bucket of a class that is another word's shares a class by its hash."""
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    c = classes[bucket]
    if own is not None:
        c = np.where((c < CLASSES - RARE) & (own[c] != h), CLASSES - RARE + bucket % RARE, c).astype(np.uint8)
    return c


def beside(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands left and right of each token in its text; 0 beyond the edges."""
    if not len(x):
        return x, x
    zero = np.zeros(1, x.dtype)
    left, right = np.concatenate([zero, x[:-1]]), np.concatenate([x[1:], zero])
    some = np.flatnonzero(np.diff(bounds))
    left[bounds[some]] = 0
    right[bounds[some + 1] - 1] = 0
    return left, right


def padded_classes(c: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all words with WINDOW zeros around each text's, the words' places in it)."""
    at = np.arange(len(c)) + WINDOW * (1 + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
    padded = np.zeros(len(c) + WINDOW * len(bounds), np.uint8)
    padded[at] = c
    return padded, at


def tokens(texts: list[str], classes: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded classes, the words' places in it, where each text's begin and the end)."""
    h, bounds = word_hashes(texts)
    return *padded_classes(classed(h, classes, own), bounds), bounds


def word_classes(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each bucket, hash of each class's only word, tokens of each class), by the buckets' counts over all documents and, in the first of them, the words'."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
    rows = docs.select(F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, texts in text_slices(b, "text"):
                n += np.bincount((word_hashes(texts)[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield table_of(schema, bucket=some.astype(np.int32), n=n[some])

    counts = rows.mapInArrow(trimmed(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    of_bucket = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # BUCKETS rows
        of_bucket[r.bucket] = r.n
    top = np.lexsort((np.arange(BUCKETS), -of_bucket))[: min(CLASSES - RARE - 1, np.count_nonzero(of_bucket))]
    out = (CLASSES - RARE + np.arange(BUCKETS) % RARE).astype(np.uint8)
    out[top] = np.arange(len(top)) + 1

    words = pa.schema([("class", pa.int32()), ("word", pa.int64()), ("n", pa.int64())])

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in text_slices(b, "text", 8_000_000):
                h = word_hashes(texts)[0]
                c = out[(h % np.uint64(BUCKETS)).astype(np.int64)]
                h, n = np.unique(h[c < CLASSES - RARE], return_counts=True)
                yield table_of(words, **{"class": out[(h % np.uint64(BUCKETS)).astype(np.int64)].astype(np.int32), "word": h.view(np.int64), "n": n})

    counts = rows.mapInArrow(trimmed(leading), "class int, word long, n long").groupBy("class", "word").agg(F.sum("n").alias("n"))
    own, totals = np.zeros(CLASSES, np.uint64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy("class").agg(F.max(F.struct("n", "word")).alias("most")).collect():  # one row a class
        own[r["class"]], totals[r["class"]] = np.int64(r.most.word).astype(np.uint64), r.most.n
    # what is not a bucket's own word is in the class that the bucket shares
    others = of_bucket - np.where(out < CLASSES - RARE, totals[out], 0)
    totals[CLASSES - RARE :] = np.bincount(np.arange(BUCKETS) % RARE, others, RARE).astype(np.int64)
    return out, own, totals


def first_network(classes: np.ndarray, totals: np.ndarray, seed: int = 10) -> Network:
    r = np.random.default_rng(seed)
    small = lambda *shape: (0.1 * r.normal(size=shape)).astype(np.float32)
    alone = totals + 1.0
    return Network(classes, small(len(OFFSETS), CLASSES, HIDDEN), np.zeros(HIDDEN, np.float32), np.vstack([small(HIDDEN, CLASSES), np.log(alone / alone.sum())]).astype(np.float32), totals=totals)


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.turn = net, rate, 0
        self.first, self.second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))

    def step(self, padded: np.ndarray, at: np.ndarray) -> None:
        """One mini-batch: the tokens at these places."""
        net, n = self.net, len(at)
        h = net.hidden(padded, at)
        z = net.outcomes(h)
        np.exp(z, out=z)
        z *= 1.0 / (n * (z @ ONES))[:, None]
        z[np.arange(n), padded[at]] -= np.float32(1.0 / n)
        dh = (z @ net.out[:HIDDEN].T) * (1 - h[:, :HIDDEN] ** 2)
        context = np.zeros_like(net.context)
        for k, o in enumerate(OFFSETS):  # sums by class
            c = padded[at + o]
            order = np.argsort(c, kind="stable")
            c = c[order]
            begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            context[k, c[begin]] = np.add.reduceat(dh[order], begin, axis=0)
        self.turn += 1
        for p, g, a, b in zip(net.parameters(), (context, dh.sum(0), (z.T @ h).T), self.first, self.second, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.98
            b += 0.02 * g * g
            p -= (self.rate / (1 - 0.9**self.turn)) * a / (np.sqrt(b / (1 - 0.98**self.turn)) + 1e-8)


def trained_on(net: Network, texts: list[list[str]], rate: float, passes: int = 1, seed: int = 0) -> tuple[Network, int]:
    """(the network after mini-batches of all tokens of the texts, which come in slices, tokens seen)."""
    r, net = np.random.default_rng(seed), net.copied()
    adam, seen = Adam(net, rate), 0
    for some in texts:
        padded, at, _ = tokens(some, net.classes, net.own)
        for _ in range(passes):
            order = r.permutation(at)
            for i in range(0, len(order), BATCH):
                adam.step(padded, order[i : i + BATCH])
        seen += len(at)
    return net, seen


def _round(docs: DataFrame, text_col: str, net: Network, turn: int, passes: int) -> Network:
    """The mean of the networks that tasks make of their documents of a round."""
    rate, rounds = RATES[turn], len(RATES)
    bare = net.copied()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0

        def slices() -> Iterator[list[str]]:
            nonlocal at
            for b in batches:
                for _, texts in text_slices(b, "text", 8_000_000):
                    own = [t for i, t in enumerate(texts) if (at + i + part) % rounds == turn]
                    at += len(texts)
                    yield own

        made, n = trained_on(bare, slices(), rate, passes, seed=rounds * part + turn)
        if n:
            flat = np.concatenate([p.ravel() for p in made.parameters()]).astype(np.float64) * n
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [n], "sums": [flat.tobytes()]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())]))

    def summed(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in table["sums"].to_pylist()], axis=0)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "n": [sum(table["n"].to_pylist())], "sums": [total.tobytes()]})

    found, kind = docs.select(F.col(text_col).alias("text")).mapInArrow(trimmed(work), "part int, n long, sums binary"), "part int, n long, sums binary"
    for bits in (4, 12):
        found = found.groupBy(F.shiftright("part", bits)).applyInArrow(summed, kind)
    rows = found.collect()  # one for each 4096 tasks
    n = sum(r.n for r in rows)
    return net.copied(np.sum([np.frombuffer(r.sums, np.float64) for r in rows], axis=0) / n) if n else net


def fit(docs: DataFrame, text_col: str = "text") -> Network:
    """The network trained on all of ``docs``, whose words are what its scores count; nulls count as empty."""
    classes, own, totals = word_classes(docs, text_col)
    net = first_network(classes, totals)
    net.own = own
    passes = min(AGAIN, -(-LEAST // max(1, int(totals.sum()))))
    for turn in range(len(RATES)):
        net = _round(docs, text_col, net, turn, passes)
    net.corpus, net.text_col = docs, text_col
    return net


def score_tokens(net: Network, padded: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the conditional log-probabilities of the tokens' classes of each text: the network's part of the score."""
    upto = np.zeros(len(at) + 1)
    for i in range(0, len(at), BATCH):
        upto[i + 1 : i + 1 + BATCH] = net.log_probabilities(padded, at[i : i + BATCH])
    upto = np.cumsum(upto)
    return upto[bounds[1:]] - upto[bounds[:-1]]


def score_texts(texts: list[str], net: Network) -> tuple[np.ndarray, np.ndarray]:
    """(the network's part of the score, number of tokens) of each text."""
    padded, at, bounds = tokens(texts, net.classes, net.own)
    return score_tokens(net, padded, at, bounds), np.diff(bounds)


def packed_tokens(word: np.ndarray, left: np.ndarray, right: np.ndarray, row: np.ndarray) -> bytes:
    """48 bits of the word, 32 of each neighbour and the row as compressed columns, in the order of words."""
    order = np.argsort(word)
    w = word[order].view(np.uint8).reshape(-1, 8)[:, :6].T
    near = [(x[order] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for x in (left, right)]
    return len(word).to_bytes(8, "little") + pa.compress(w.tobytes() + near[0] + near[1] + row[order].astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpacked_tokens(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=18 * n, codec="zstd", asbytes=True), np.uint8)
    word = np.zeros((n, 8), np.uint8)
    word[:, :6] = raw[: 6 * n].reshape(6, n).T
    left, right, row = raw[6 * n :].copy().view("<u4").reshape(3, n)
    return word.view("<u8").ravel(), left, right, row


def word_probabilities(word: np.ndarray, left: np.ndarray, right: np.ndarray, known: np.ndarray, own: np.ndarray) -> np.ndarray:
    """P(word | subclass, left, right) of the tokens of one subclass; those that are ``known`` are what is counted, but none of ``own`` counts for itself.

    So a token that is itself part of the corpus is predicted from all others: at every
    level its own occurrence is taken off the counts of its word, of its context and of
    the kinds of words seen there.
    """
    w = np.unique(word, return_inverse=True)[1]
    size, off = int(w.max()) + 1, (known & own).astype(np.int64)

    def discounted(context: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        c = np.unique(context, return_inverse=True)[1]
        pairs, pair = np.unique(c * size + w, return_inverse=True)
        seen = np.bincount(pair[known], minlength=len(pairs))
        n = seen[pair] - off
        whole = np.bincount(c[known], minlength=int(c.max()) + 1)[c] - off
        kinds = np.bincount((pairs // size)[seen > 0], minlength=int(c.max()) + 1)[c] - (off & (n == 0))
        return np.where(whole > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * otherwise) / np.maximum(whole, 1), otherwise)

    each = np.bincount(w[known], minlength=size)
    kinds = np.count_nonzero(each) - (off & (each[w] == 1))
    alone = discounted(np.zeros(len(w), np.int64), 1.0 / (kinds + 1))
    either = (discounted(left, alone) + discounted(right, alone)) / 2
    return discounted((left.astype(np.uint64) << np.uint64(32)) | right, either)


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, log_likelihood, score.

    log_likelihood is the sum over all tokens, score that sum a token; a null, empty or
    blank text has 0 tokens, a sum of 0 and a null score. Repeated rows repeat; an empty table gives no rows; other columns are not looked at.
    The words counted are those of the documents that the network is fitted on; where those
    are ``docs`` itself, every token is dealt once and is masked in the counts as well: no
    occurrence speaks for itself.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    own_corpus = net.corpus is docs and net.text_col == text_col
    kind = rows.schema["_id"].dataType.simpleString()
    parts, first = net.subclasses()
    total, share = net.totals, int(parts.sum())
    bare = net.copied()
    #: Either a document (row, _id, n_tokens, score) or tokens of a subclass (base, known, blob).
    fields = f"sub int, row long, _id {kind}, n_tokens long, score double, base long, known boolean, blob binary"

    def dealer(scored: bool, known: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, size, schema = TaskContext.get().partitionId() << 36, [], 0, None
            for b in batches:
                if schema is None:
                    of_id = b.schema.field(0).type
                    schema = pa.schema([("sub", pa.int32()), ("row", pa.int64()), ("_id", of_id), ("n_tokens", pa.int64()), ("score", pa.float64()), ("base", pa.int64()), ("known", pa.bool_()), ("blob", pa.binary())])
                for start, texts in text_slices(b, "_text", 8_000_000):
                    h, bounds = word_hashes(texts)
                    row = np.arange(at, at + len(texts))
                    c = classed(h, bare.classes, bare.own)
                    if scored:
                        s, n = score_tokens(bare, *padded_classes(c, bounds), bounds), np.diff(bounds)
                        none = pa.nulls(len(texts))
                        yield pa.RecordBatch.from_arrays([pa.array((row % share).astype(np.int32)), pa.array(row), b.column(0).slice(start, len(texts)), pa.array(n.astype(np.int64)), pa.array(s), none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(pa.binary())], schema=schema)
                    left, right = beside(h, bounds)
                    some = np.flatnonzero(c >= CLASSES - RARE)
                    c, h = c[some], h[some]
                    sub = (first[c] + ((h >> np.uint64(24)) % np.maximum(parts[c], 1).astype(np.uint64)).astype(np.int64)).astype(np.int32)
                    held.append((sub, h, left[some], right[some], np.repeat(row, np.diff(bounds))[some]))
                    size, at = size + len(some), at + len(texts)
                    if size >= DEALT:
                        yield from dealt(schema, held, known)
                        held, size = [], 0
            if size:
                yield from dealt(schema, held, known)

        def dealt(schema: pa.Schema, held: list, known: bool) -> Iterator[pa.RecordBatch]:
            sub, word, left, right, row = (np.concatenate(x) for x in zip(*held, strict=True))
            base = int(row.min())
            order = np.argsort(sub)
            cuts = np.flatnonzero(np.diff(sub[order])) + 1
            for own in np.split(order, cuts):
                yield pa.RecordBatch.from_pylist([{"sub": int(sub[own[0]]), "base": base if scored else -1, "known": known, "blob": packed_tokens(word[own], left[own], right[own], row[own] - base)}], schema=schema)

        return deal

    def words(table: pa.Table) -> pa.Table:
        """Documents as they came, and the sums of this subclass's log-probabilities by block of documents."""
        done = [table.filter(pc.is_valid(table["row"])).select(["row", "_id", "n_tokens", "score"])]
        done[0] = done[0].add_column(0, "block", pa.array(done[0]["row"].to_numpy() // BLOCK, pa.int64())).append_column("blob", pa.nulls(len(done[0]), pa.binary()))
        some = table.filter(pc.is_valid(table["blob"]))
        if len(some):
            bases, known = some["base"].to_pylist(), some["known"].to_pylist()
            got = [unpacked_tokens(x) for x in some["blob"].to_pylist()]
            sizes = [len(x[0]) for x in got]
            word, left, right, row = (np.concatenate(x) for x in zip(*got, strict=True))
            base, known = np.repeat(np.array(bases, np.int64), sizes), np.repeat(np.array(known, bool), sizes)
            of = int(np.searchsorted(first, some["sub"][0].as_py(), "right")) - 1
            asked = base >= 0
            off = known & asked
            log_p = np.log(word_probabilities(word, left, right, known, asked)) + np.log((known.sum() - off + 1) / (total[of] + parts[of] - off))
            rows, at = np.unique(base[asked] + row[asked], return_inverse=True)
            if len(rows):
                sums = np.bincount(at, log_p[asked])
                cuts = np.flatnonzero(np.diff(rows // BLOCK)) + 1
                blobs = [(r % BLOCK).astype("<u2").tobytes() + x.astype("<f4").tobytes() for r, x in zip(np.split(rows, cuts), np.split(sums, cuts), strict=True)]
                none = pa.nulls(len(blobs))
                done.append(pa.table([pa.array(rows[np.concatenate([[0], cuts])] // BLOCK), none.cast(pa.int64()), none.cast(table.schema.field("_id").type), none.cast(pa.int64()), none.cast(pa.float64()), pa.array(blobs, pa.binary())], schema=done[0].schema))
        return pa.concat_tables(done)

    def summed(table: pa.Table) -> pa.Table:
        more = np.zeros(BLOCK)
        for x in table["blob"].to_pylist():
            if x is not None:
                n = len(x) // 6
                more[np.frombuffer(x, "<u2", n)] += np.frombuffer(x, "<f4", n, 2 * n)
        own = table.filter(pc.is_valid(table["row"]))
        score = own["score"].to_numpy() + more[own["row"].to_numpy() % BLOCK]
        return pa.table([own["_id"], own["n_tokens"], pa.array(score)], names=["_id", "n_tokens", "score"])

    tokens_of = rows.mapInArrow(trimmed(dealer(True, own_corpus)), fields)
    if not own_corpus and net.corpus is not None:
        corpus = net.corpus.select(F.lit(None).cast(kind).alias("_id"), F.col(net.text_col).alias("_text"))
        tokens_of = tokens_of.unionByName(corpus.mapInArrow(trimmed(dealer(False, True)), fields))
    sums = tokens_of.groupBy("sub").applyInArrow(words, f"block long, row long, _id {kind}, n_tokens long, score double, blob binary")
    out = sums.groupBy("block").applyInArrow(summed, f"_id {kind}, n_tokens long, score double")
    return out.select(F.col("_id").alias(id_col), "n_tokens", F.col("score").alias("log_likelihood"), F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("score"))
