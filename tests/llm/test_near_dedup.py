"""Order MinHash classes against all pairs, aligned by the textbook table."""

import random
from collections import Counter

import numpy as np

from vellum.llm import components, near_dedup


def kmers(text):
    words = text.lower().split()
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) > 4 else [tuple(words)] if words else []
    seen, out = Counter(), []
    for r in runs:
        out.append((r, seen[r]))
        seen[r] += 1
    return out


def aligned(a, b):
    if not a or not b:
        return float(a == b)
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def corpus(seed, families=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(r.randint(1, 4)))
    vocabulary = [word() for _ in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for f in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 60, 150, 300]))]
        if f % 3 == 0:
            base[len(base) // 2 : 0] = passage
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 1, 3, 8])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 12])):
                i = r.randrange(len(w) + 1)
                w[i : i + r.choice([0, 1])] = [r.choice(vocabulary)] * r.choice([0, 1])
            texts.append(" ".join(w))
    texts += ["a b " * 50, "a b " * 51, "a b " * 30, "One  two\nthree four FIVE six seven", "one two three four five six seven", "", "", "  "]
    return texts


def test_kmers_differ_and_match_their_text():
    texts = [*corpus(3, 6), "x" * 70 + " y" * 9, "é\xa0b c d e f", "é b c d e f"]
    g, upto = near_dedup.labelled_kmers(texts)
    name = {}
    for i, t in enumerate(texts):
        own = g[upto[i] : upto[i + 1]].tolist()
        want = kmers(t)
        assert len(own) == len(set(own)) == len(want)
        for h, k in zip(own, want, strict=True):
            assert name.setdefault(h, k) == k
    alone = [near_dedup.labelled_kmers([t])[0].tolist() for t in texts]
    assert alone == [g[upto[i] : upto[i + 1]].tolist() for i in range(len(texts))]


def test_alignment():
    texts = corpus(5, 8)
    ids = {}
    arrays = [np.array([ids.setdefault(k, len(ids)) for k in kmers(t)]) for t in texts]
    for a in arrays:
        for b in arrays:
            want = aligned(a.tolist(), b.tolist())
            got = near_dedup.similarity(a, b)
            assert np.isclose(got, want) if want >= 0.8 else got < 0.8


def test_sketch_depends_on_the_order():
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join([*[f"w{i}" for i in range(100, 200)], *[f"w{i}" for i in range(100)]])
    c = " ".join(f"w{i}" for i in range(2, 200))
    values, n = near_dedup.sketches([a, b, c, "", "q"])
    assert (values[0] == values[2]).sum() > 2 * (values[0] == values[1]).sum()
    assert n.tolist() == [196, 196, 194, 0, 1] and not values[3].any()


def pairs_at_the_threshold(common, left, right, count, seed=9):
    """Pairs of texts that have so many five-word runs in common, in one stretch, and so many of their own."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**9)}"
    for _ in range(count):
        middle = [word() for _ in range(common + 4)]
        yield tuple(" ".join([*(word() for _ in range(k // 2)), *middle, *(word() for _ in range(k - k // 2))]) for k in (left, right))


def shared(a, b):
    values, _ = near_dedup.sketches([a, b])
    more, of = near_dedup.short_values([a, b])
    return bool((values[0] == values[1]).any() or set(more[of == 0].tolist()) & set(more[of == 1].tolist()))


def test_short_texts_miss_nothing():
    """All ways in which two texts of up to ten runs can be similar."""
    for common, left, right in ((4, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0), (8, 1, 1), (8, 2, 0), (9, 1, 0), (9, 1, 1), (8, 0, 2), (4, 0, 1)):
        assert common / (common + left + right) >= 0.8
        for a, b in pairs_at_the_threshold(common, left, right, 400):
            assert aligned(kmers(a), kmers(b)) >= 0.8 and shared(a, b)


def test_recall_by_length():
    """At exactly the threshold; a value of 28 is missed with at most 4e-6, so none of these is."""
    for common, left, right in ((12, 2, 1), (16, 2, 2), (20, 5, 0), (40, 5, 5), (200, 25, 25)):
        assert all(shared(a, b) for a, b in pairs_at_the_threshold(common, left, right, 600))


def test_classes(spark):
    texts = corpus(1)
    rows = [(i * 3 % 211, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n int").repartition(3)
    out, _ = near_dedup.near_classes(df)
    k = [kmers(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (k[i] and k[j] and aligned(k[i], k[j]) >= 0.8):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {rows[i][0]: (min(rows[j][0] for j in range(len(texts)) if group[j] == group[i]), group.count(group[i])) for i in range(len(texts))}
    got = {r.doc_id: (r.class_id, r.class_size) for r in out.collect()}
    assert got == want
    kept = near_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z")], "doc_id long, text string")
    out, _ = near_dedup.near_classes(df)
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.class_size, r.kept) for r in out.collect()))
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, False), (3, 3, 2, True)]
    assert near_dedup.near_classes(df.limit(0))[0].count() == 0


def test_components(spark, tmp_path):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (300, 300), (150, 200)]
    out = components.components(spark.createDataFrame(chain, "a long, b long"), str(tmp_path))
    assert {r.node: r.comp for r in out.collect()} == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}
