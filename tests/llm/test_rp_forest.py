"""The forest against brute force."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vellum.llm import rp_forest


def brute(rows, k):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 6}
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in usable if i != q)
            out[q] = near[:k]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def test_forest_on_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).astype("f4").tolist()) for i in range(300)]
    same = rows[40][1]
    rows += [(i, same) for i in range(1000, 1100)]  # a large group of copies, five of which ask
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (None, same), (2100, [1.0, 2.0]), (20, rows[20][1])]
    got = {}
    for x in rp_forest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, leaf=2048).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows, 20)
    assert set(got) == set(want)
    for q, near in want.items():
        own = sorted(got[q])
        assert [x for x, _, _ in own] == list(range(1, 21))
        assert [i for _, i, _ in own] == [i for _, i in near]
        assert np.allclose([s for _, _, s in own], [-s for s, _ in near], rtol=0, atol=1e-12)


def test_forest_of_few_or_none(spark):
    df = vectors(spark, [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])])
    out = rp_forest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert rp_forest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_forest_of_each_dimension(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(30)]
    got = rp_forest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=3).collect()
    near = {}
    for r in got:
        near.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(n)] for q, n in near.items()} == {0: [1, 2, 3], 20: [29, 28, 27], 100: [101, 102, 103], 120: [129, 128, 127]}


def recall(found, ids, x, k=20):
    hit = []
    for q, own in found.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit.append(len(own & set(ids[np.argsort(-s, kind="stable")[:k]].tolist())) / k)
    return np.mean(hit)


def test_recall_and_effort_on_many_vectors(spark, tmp_path):
    """50,000 vectors around 600 centres: the forest finds nine of ten neighbours and scores less than a third; with one leaf it doesn't find them."""
    r = np.random.default_rng(5)
    x = (r.normal(size=(600, 48))[r.integers(0, 600, 50_000)] + 0.7 * r.normal(size=(50_000, 48))).astype("f4")
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 48).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    df, ids, y = spark.read.parquet(str(tmp_path / "v.parquet")), np.arange(50_000), x.astype(float)
    share = {}
    for leaves in (None, 1):
        found, scored = {}, {}
        for row in rp_forest.nearest(df, F.col("vec_id") % 200 == 0, leaves=leaves, effort=True).collect():
            found.setdefault(row.query_id, set()).add(row.vec_id)
            scored[row.query_id] = row.scored
        assert len(found) == 250
        share[leaves] = recall(found, ids, y), np.mean(list(scored.values())) / len(x)
    assert share[None][0] >= 0.9 and share[None][1] < 1 / 3
    assert share[1][0] < 0.5


def test_recall_on_the_table(spark):
    """These vectors lie in no clusters, so a query has to visit much; the forest alone finds them, one leaf does not."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = map(np.array, zip(*[(r.vec_id, np.array(r.embedding, float)) for r in df.collect()], strict=True))
    for leaves in (None, 1):
        found = {}
        for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0, leaves=leaves).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        assert (recall(found, ids, x) >= 0.9) == (leaves is None)


def test_queue_takes_leaves_in_order():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 5))
    f = rp_forest.grow(x, 400, float(np.linalg.norm(x, axis=1).max()), trees=4, leaf=20)
    assert f.depth == 5 and len(f.own) == 5
    assert np.bincount(f.leaf_of(x)[:, 0], minlength=32).max() <= 14
    y = f.lifted(x[:3], True)
    for q, visits in zip(y, f.visits(x[:3], 1 << 30), strict=True):
        assert len(set(visits.tolist())) == len(visits) == 4 * 32
        far = []
        for at in visits.tolist():
            t, leaf = divmod(at, 32)
            w = 0.0
            for level in range(5):
                node, way = leaf >> (5 - level), leaf >> (4 - level) & 1
                m = float(f.directions[t, level] @ q - f.own[level][t, node])
                w += m * m if (m > 0) != way else 0.0
            far.append(w)
        assert np.allclose(far, sorted(far))


def test_trees_deeper_than_the_sample():
    r = np.random.default_rng(6)
    x = r.normal(size=(64, 4))
    f = rp_forest.grow(x, 64 * 1024, 9.0, leaf=32)
    assert f.depth == 11 and len(f.own) == 4
    assert f.leaf_of(x).max() < 1 << 11
    assert all(len(set(v.tolist())) == 40 for v in f.visits(x, 40))
