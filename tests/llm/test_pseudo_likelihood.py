"""The window network against its own definition."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import pseudo_likelihood as pl


def test_network_scores():
    r = random.Random(4)
    texts = [" ".join(r.choice(["the cat sat on a mat", "one dog ran to the house"]) for _ in range(20)) for _ in range(60)]
    classes = (pl.CLASSES - pl.RARE + np.arange(pl.BUCKETS) % pl.RARE).astype(np.uint8)
    words = sorted({w for t in texts for w in t.split()})
    h, _ = pl.word_hashes([" ".join(words)])
    for i, b in enumerate((h % np.uint64(pl.BUCKETS)).astype(int)):
        classes[b] = i + 1
    padded, at, bounds = pl.tokens([*texts, "", "one"], classes)
    assert len(at) == bounds[-1] == 60 * 120 + 1 and (padded[at] > 0).all() and np.count_nonzero(padded) == len(at)
    net = pl.first_network(classes, np.bincount(padded[at], minlength=pl.CLASSES))
    for rate in pl.RATES:
        net, seen = pl.trained_on(net, [texts], rate, passes=8)
    assert seen == 60 * 120
    every = np.arange(pl.CLASSES).astype(np.uint8)
    for i in at[:5]:
        ways = [np.concatenate([padded[:i], [c], padded[i + 1 :]]) for c in every]
        assert math.isclose(sum(math.exp(net.log_probabilities(w, np.array([i]))[0]) for w in ways), 1, rel_tol=1e-4)
    score, n = pl.score_texts([texts[0], " ".join(r.sample(texts[0].split(), len(texts[0].split()))), "", "  "], net)
    assert n.tolist() == [120, 120, 0, 0] and score[0] / n[0] > -0.4 and score[0] > score[1] + 50 and score[2] == score[3] == 0


def by_definition(text, net):
    """The summed log-probability of the classes of a text's words, word by word, from the network's definition."""
    c = [int(pl.classed(pl.word_hashes([w])[0], net.classes, net.own)[0]) for w in text.split()]
    total = 0.0
    for i, own in enumerate(c):
        h = net.inner.astype(float).copy()
        for k, o in enumerate(pl.OFFSETS):
            h += net.context[k][c[i + o] if 0 <= i + o < len(c) else 0]
        z = np.append(np.tanh(h), 1.0) @ net.out.astype(float)
        total += z[own] - z.max() - math.log(np.exp(z - z.max()).sum())
    return total


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(1)
    classes = (r.integers(1, pl.CLASSES, pl.BUCKETS)).astype(np.uint8)
    net = pl.first_network(classes, np.ones(pl.CLASSES))
    padded, at, _ = pl.tokens(["a b c d e f g", "b a"], classes)
    loss = lambda n: -n.log_probabilities(padded, at).astype(float).mean()
    adam = pl.Adam(net.copied(), 0.0)
    adam.step(padded, at)
    for k, p in enumerate(net.parameters()):
        g = adam.first[k].ravel() / 0.1
        for i in np.argsort(-np.abs(g))[:3]:
            moved = [net.copied() for _ in range(2)]
            for m, e in zip(moved, (1e-2, -1e-2), strict=True):
                m.parameters()[k].ravel()[i] += e
            assert math.isclose((loss(moved[0]) - loss(moved[1])) / 2e-2, g[i], rel_tol=0.05, abs_tol=1e-4)


def test_network_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"))
    df = df.union(spark.createDataFrame([(-1, None, "x"), (-2, " \n", "x"), (None, "a b", "x"), (-3, "a b", "x"), (-3, "a b", "x")], "doc_id long, text string, score string"))
    net = pl.fit(df)
    out = {r.doc_id: r for r in pl.score_documents(df, net).collect()}
    assert pl.score_documents(df, net).count() == df.count()
    assert out[-1].n_tokens == out[-2].n_tokens == 0 and out[-1].log_likelihood == 0 and out[-1].score is None
    texts = [r.text for r in df.where("doc_id >= 0 and length(text) > 400").collect()]
    r = random.Random(5)
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in texts]
    a, n = pl.score_texts(texts, net)
    b, _ = pl.score_texts(mixed, net)
    assert np.mean(a / n > b / n) > 0.9
    assert np.allclose(pl.score_texts(texts[:5], net)[0], [by_definition(t, net) for t in texts[:5]], rtol=1e-4)
    # words garbled or replaced by such as occur once, against the texts as they are
    garbled = [" ".join("".join(r.sample(w, len(w))) if i % 2 else w for i, w in enumerate(t.split())) for t in texts]
    rare = [" ".join(f"{w}q{r.randrange(10**9)}" if i % 3 == 0 else w for i, w in enumerate(t.split())) for t in texts]
    scored = spark.createDataFrame(list(enumerate([*texts, *garbled, *rare])), "doc_id long, text string")
    score = np.array([x.score for x in sorted(pl.score_documents(scored, net).collect(), key=lambda x: x.doc_id)]).reshape(3, -1)
    assert np.mean(score[0] > score[1]) > 0.97 and np.mean(score[0] > score[2]) > 0.97
    empty = pl.fit(df.limit(0))
    assert pl.score_documents(df.limit(0), empty).count() == 0
    assert np.isfinite(pl.score_texts(["a b"], empty)[0]).all()


def discounted(word, between, counted):
    """P(word | left, right) among the words of one subclass, from plain counts."""

    def level(same, below):
        own = [w for w, a, b in counted if same(a, b)]
        return (max(own.count(word) - pl.DISCOUNT, 0) + pl.DISCOUNT * len(set(own)) * below) / len(own) if own else below

    left, right = between
    alone = level(lambda a, b: True, 1 / (len({w for w, _, _ in counted}) + 1))
    either = (level(lambda a, b: a == left, alone) + level(lambda a, b: b == right, alone)) / 2
    return level(lambda a, b: (a, b) == between, either)


def test_rare_words_are_told_apart(spark):
    """Words beyond those with a class of their own, against plain counts; the vocabulary is larger than the classes."""
    r = random.Random(6)
    texts = [" ".join([*(f"often{r.randrange(300)}" for _ in range(60)), *(f"rare{r.randrange(900)}" for _ in range(20))]) for _ in range(60)]
    asked = ["often1 rare5 often2", "often1 rare6 often2", "often1 neverseen often2", "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = pl.fit(docs)
    got = {x.doc_id: x.log_likelihood for x in pl.score_documents(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), net).collect()}
    same = {x.doc_id: x.log_likelihood for x in pl.score_documents(docs, net).collect()}

    def words(t):
        w = t.split()
        return list(zip(w, [None, *w][: len(w)], [*w[1:], None][: len(w)], strict=True))

    name = lambda w: int(pl.classed(pl.word_hashes([w])[0], net.classes, net.own)[0])
    of = {w: name(w) for t in [*texts, *asked] for w in t.split()}
    counted = {}
    for t in texts:
        for x in words(t):
            counted.setdefault(of[x[0]], []).append(x)
    assert all(len({x[0] for x in own}) == 1 for c, own in counted.items() if c < pl.CLASSES - pl.RARE)
    for i, t in enumerate(asked):
        want = pl.score_texts([t], net)[0][0]
        for w, a, b in words(t):
            if of[w] >= pl.CLASSES - pl.RARE:
                own = counted.get(of[w], [])
                want += math.log(discounted(w, (a, b), own) * (len(own) + 1) / (net.totals[of[w]] + 1))
        assert math.isclose(got[i], want, rel_tol=1e-5, abs_tol=1e-5), t
    # within the corpus every token is predicted from all others
    for i in (0, 7, 59):
        want = pl.score_texts([texts[i]], net)[0][0]
        for x in words(texts[i]):
            if of[x[0]] >= pl.CLASSES - pl.RARE:
                own = list(counted[of[x[0]]])
                own.remove(x)
                want += math.log(discounted(x[0], x[1:], own) * (len(own) + 1) / net.totals[of[x[0]]])
        assert math.isclose(same[i], want, rel_tol=1e-5), i
    assert same[0] < got[4]


def test_junk_in_the_corpus_is_told_apart(spark):
    """Texts, copies of them with half of their words garbled, and texts of random letters, all in the one table that is fitted and scored."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 300 and 5000").orderBy("doc_id").limit(660).select("text")
    texts = sorted({r.text for r in df.collect()})
    r = random.Random(9)
    garble = lambda t: " ".join("".join(r.sample(w, len(w))) if r.random() < 0.5 else w for w in t.split())
    garbled = [garble(t) for t in texts[::10]]
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(200)) for _ in range(60)]
    rows = [*((0, i, t) for i, t in enumerate(texts)), *((1, 10 * i, t) for i, t in enumerate(garbled)), *((2, i, t) for i, t in enumerate(junk))]
    docs = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    score = {x.doc_id: x.score for x in pl.score_documents(docs, pl.fit(docs)).collect()}
    by = [{i: score[k] for k, (kind, i, _) in enumerate(rows) if kind == want} for want in range(3)]
    worse = np.mean([by[0][i] > s for i, s in by[1].items()])
    assert worse >= 0.97, worse
    assert max(by[2].values()) < np.quantile(list(by[0].values()), 0.02), (max(by[2].values()), min(by[0].values()))


def test_words_of_one_class_differ(spark):
    """Two words in one shared class, one in its usual place, one not: the classes can't tell, the words do."""
    filler = [f"often{i}" for i in range(250)]
    by_class = {}
    for i in range(2000):
        h = int(pl.word_hashes([f"rare{i}"])[0][0] % pl.BUCKETS)
        by_class.setdefault(h % pl.RARE, []).append(f"rare{i}")
    one, two = by_class[0][:2]
    texts = [" ".join(filler * 3)] * 4 + [f"often1 {one} often2", f"often3 {two} often4"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = pl.fit(docs)
    out = {x.doc_id: x.log_likelihood for x in pl.score_documents(spark.createDataFrame([(0, f"often1 {one} often2"), (1, f"often1 {two} often2")], "doc_id long, text string"), net).collect()}
    a, b = pl.score_texts([f"often1 {one} often2", f"often1 {two} often2"], net)[0]
    assert a == b and out[0] > out[1] + 0.5
