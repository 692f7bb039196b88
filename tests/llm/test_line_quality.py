"""The line CRF: inference by enumeration, gradient by differences, held-out accuracy."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import line_quality as lq
from vellum.llm.queries import op4_line_quality


def enumerated(emission, ties):
    n, total, good = len(emission), 0.0, np.zeros(len(emission))
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(emission[i] * y for i, y in enumerate(path)) + sum(ties[a, b] for a, b in itertools.pairwise(path)))
        total += w
        good += w * np.array(path)
    return good / total, np.log(total)


def test_marginals():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 7):
        e, t = r.normal(size=n), r.normal(size=(2, 2))
        assert np.allclose(lq.marginals(e, t), enumerated(e, t)[0])


def test_gradient():
    r = np.random.default_rng(1)
    x, n, y = r.normal(size=(3, 4, 2)), np.array([4, 1, 2]), np.array([1, 0, 0])
    x[1, 1:], x[2, 2:] = 0, 0
    w, t = r.normal(size=2), r.normal(size=(2, 2))
    f = lambda w, t: lq._gradient(x, n, y, w, t)[0]
    want = sum((x[i, : n[i]] @ w).sum() * y[i] + t[y[i], y[i]] * (n[i] - 1) - enumerated(x[i, : n[i]] @ w, t)[1] for i in range(3))
    assert np.isclose(f(w, t), want)
    _, gw, gt = lq._gradient(x, n, y, w, t)
    for k in range(2):
        d = np.eye(2)[k] * 1e-6
        assert np.isclose((f(w + d, t) - f(w - d, t)) / 2e-6, gw[k], atol=1e-4)
        for j in range(2):
            d2 = np.zeros((2, 2))
            d2[k, j] = 1e-6
            assert np.isclose((f(w, t + d2) - f(w, t - d2)) / 2e-6, gt[k, j], atol=1e-4)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = op4_line_quality(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert out.count() == docs.count()
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all((r.score >= 0.3) == r.predicted and 0 <= r.score <= 1 for r in rows)


def textbook(emission, ties):
    """Forward-backward in logarithms."""
    n, ahead, back = len(emission), [np.array([0.0, emission[0]])], [np.zeros(2)]
    for e in emission[1:]:
        ahead.append(np.logaddexp(ahead[-1][0] + ties[0], ahead[-1][1] + ties[1]) + np.array([0.0, e]))
    for e in emission[:0:-1]:
        x = back[0] + np.array([0.0, e])
        back.insert(0, np.logaddexp(ties[:, 0] + x[0], ties[:, 1] + x[1]))
    both = np.array(ahead) + np.array(back)
    return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1])) if n else np.zeros(0)


def test_every_score_of_the_query(spark):
    """All documents of the smallest tables against the textbook's recursion and a sigmoid."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = lq.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r.score for r in op4_line_quality(spark, d).collect()}
    want = {}
    for r in docs.collect():
        x, lengths = lq.document_features(r.text or "")
        w = np.maximum(lengths, 1)
        p = textbook(np.clip(x @ model.weights, -30, 30), model.ties) @ w / w.sum()
        want[r.doc_id] = 1 / (1 + np.exp(-np.clip(model.scale * np.log(max(p, 1e-12) / max(1 - p, 1e-12)) + model.shift, -30, 30)))
    assert set(got) == set(want) and all(np.isclose(got[i], want[i], atol=1e-6) for i in want)


def test_the_driver_gets_a_bounded_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(lq, "CHAINS", 10)
    rows = [(i, ("good words in a line.\n" if i % 2 else "| ! | x\n") * 2000) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(lq, "train", lambda chains, real=lq.train: seen.extend(chains) or real(chains))
    model = lq.fit(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert len(seen) == 10 and max(len(f) for f, _ in seen) == lq.CHAIN
    assert model.score(rows[1][1]) > 0.7 > 0.3 > model.score(rows[0][1])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a" * 100_000), (4, "a" * 100_000), (None, "x | y | z |"), (5, "good line of words.\n" * 5000)]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (3, None, "x"), (None, 1, "x"), (6, 1, "x"), (4, 1, "x"), (4, 0, "x")], "doc_id long, quality int, text string")
    model = lq.fit(df, labels)
    out = lq.score_documents(df, model, keep=["quality"]).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 and r.quality == 1 for r in out)
    assert lq.fit(df.limit(0), labels).score("x") == 0.5
    assert lq.score_documents(df.limit(0), model).count() == 0
    assert lq.score_documents(df, model).where(F.isnan("score")).count() == 0
