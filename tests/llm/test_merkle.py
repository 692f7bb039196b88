"""Manifests against trees made one node after the other, small blocks and odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def levels(xs):
    out = [xs]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def beside(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [levels([leaf(r) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            way = beside(t, i) + beside(top, k)
            h = leaf((*r[:3], r[3] + 1, r[4])) if tampered(r) and r[3] is not None else leaf(r)
            for s, left in way:
                h = sha(h) if s is None else sha(s, h) if left else sha(h, s)
            root = top[-1][0]
            out.append((r[0], leaf(r), t[-1][0], root, sha(*[s for s, _ in way if s]), h, h == root))
    return sorted(out, key=repr)


def seventh(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0


def made(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, merkle.manifest(df, F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 0).collect()), key=repr)


def some_rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "ü", None]), rng.choice(["en", "en", "en", "de", "é", None]), rng.choice([None, 3, 10]), rng.choice([None, "", "tëxt", "x" * 50])) for i in range(n)]


@pytest.mark.parametrize("levels_", [1, 2, 10])
@pytest.mark.parametrize("n", [1, 2, 3, 37, 90])
def test_equals_the_plain_tree(spark, monkeypatch, levels_, n):
    """With blocks of two and of four, so that trees have several rounds of uneven heights."""
    monkeypatch.setattr(merkle, "LEVELS", levels_)
    monkeypatch.setattr(merkle, "WIDTH", 1 << levels_)
    rows = some_rows(n, n)
    assert made(spark, rows) == brute(rows, seventh)


def test_odd_rows(spark):
    """Repeated rows, one id with different rows, null ids, one row of a language, a very long text; and what tampering changes."""
    rows = [(7, "a", "en", 1, "x")] * 5 + [(7, "b", "en", 2, "y"), (None, None, None, None, None), (None, "s", "en", 4, "z"), (9, "a", "one", 1, "ö" * 1_000_000)] + [(i, "s", "en", i, f"t{i}") for i in range(100, 140)]
    got = made(spark, rows)
    assert got == brute(rows, seventh)
    assert {r[-1] for r in got} == {True, False}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df).count() == 0
    rows = some_rows(9, 1)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as grp", "2 as pos", "3 as size", "4 as digest", "5 as leaf", "6 as _part", "7 as other")
    assert sorted(map(tuple, merkle.manifest(wide).collect()), key=repr) == brute(rows, lambda r: False)


def test_places_in_hot_groups(spark):
    rows = [("a", i % 3, i) for i in range(3000)] + [("b", 1, 1)]
    import tempfile

    got = merkle.ranked(spark.createDataFrame(rows, "grp string, x int, y int"), ["x", "y"], tempfile.mkdtemp(prefix="spark-") + "/r").collect()
    assert sorted((r.x, r.y, r.pos) for r in got if r.grp == "a") == [(x, y, i) for i, (x, y) in enumerate(sorted((x, y) for g, x, y in rows if g == "a"))]
    assert {r["size"] for r in got if r.grp == "a"} == {3000}
