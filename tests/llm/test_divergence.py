"""Distances and terms against counting in plain Python, shards of many parts, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from vellum.llm import divergence as V

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """rows: (lang, source, text)."""
    n, whole, df, groups = Counter(), Counter(), Counter(), defaultdict(set)
    for lang, source, text in ((x or "" for x in r) for r in rows):
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups[lang].add(source)
        n.update((lang, source, t) for t in own)
        whole.update((lang, t) for t in own)
        df.update((lang, t) for t in set(own))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), k in df.items() if x == lang and k >= 30]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares({t: n[lang, s, t] for t in kept}) for s in sources}
        q = shares({t: whole[lang, t] for t in kept})
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[u][t]) for t in kept), u) for u in sources if u != s]
            term = [(p[s][t] - q[t], t) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, xs, most in (("pair", pair, None), ("term", term, 50)):
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(sorted(xs, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def made(spark, rows, **k):
    return sorted(map(tuple, V.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), **k).collect()))


def some_rows(n, seed, words=80):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcßéж") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    rows = []
    for _ in range(n):
        s = rng.choice(["a", "a", "a", "b", "ü", "", None, "z"])
        text = " ".join(rng.choice([str.upper, str.lower])(rng.choice(names[: rng.randint(2, words)])) + rng.choice(["", "7", "_x", ",", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", "de", None, ""]), s, text if rng.random() > 0.02 else None))
    return rows


def test_equals_plain_counting(spark):
    rows = some_rows(1200, 3)
    want = brute(rows)
    assert len({r[2] for r in want}) == 2 and len(want) > 100
    assert made(spark, rows) == want


def test_small_chunks_and_many_shards(spark, monkeypatch):
    """Counts handed on often, tables added up often, and several shards in both passes."""
    for name, value in (("COUNTED", 50), ("CHUNK", 20), ("FULL", 40), ("ROWS", 30)):
        monkeypatch.setattr(V, name, value)
    rows = some_rows(700, 8)
    assert made(spark, rows, shards=7) == brute(rows)


def test_a_shard_in_small_steps(monkeypatch):
    """The functions of the tasks themselves, here where the sizes are small."""
    for name, value in (("COUNTED", 50), ("CHUNK", 20), ("FULL", 40)):
        monkeypatch.setattr(V, name, value)
    rows = [(lang or "", source or "", text or "") for lang, source, text in some_rows(400, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])
    got = pa.Table.from_batches(V.kept_counts(V.counted(iter([batch])))).to_pylist()
    n, df = Counter(), Counter()
    for lang, source, text in rows:
        own = [t.decode() for t in V.terms(text)]
        n.update((lang, source, t) for t in own)
        n.update((lang, None, t) for t in own)
        df.update((lang, t) for t in set(own))
    assert {(r["lang"], r["source"], r["term"]): r["n"] for r in got} == {k: x for k, x in n.items() if df[k[0], k[2]] >= 30}


def test_odd_rows(spark):
    """No kept terms, one source alone, null everything, a very long text, repeated rows, clashing columns, an empty table."""
    rows = [("en", "a", "x y"), ("en", "b", None), ("en", "c", "123"), (None, None, None), ("fr", "only", "q " * 500_000)] + [("fr", "only", "q r")] * 40 + [("de", s, "gleich") for s in "ab" for _ in range(20)]
    assert made(spark, rows) == brute(rows)
    wide = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as n", "3 as shard", "4 as v", "5 as part")
    assert sorted(map(tuple, V.divergence(wide).collect())) == brute(rows)
    assert V.divergence(wide.limit(0)).count() == 0


def test_counts_beyond_sixty_three_bits():
    """Shares of counts whose product with WHOLE passes 64 bits stay exact."""
    n = 10**15
    kept = pa.table([["en"] * 3, ["a", "a", "b"], ["x", "y", "x"], [n, 3 * n, n], [2 * n, 3 * n, 2 * n]], schema=V.KEPT)
    groups = pa.table([["en"] * 2, ["a", "b"], [4 * n, n], [5 * n, 5 * n], [2, 2]], names=["lang", "source", "total", "whole_total", "v"])
    share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 10)
    got = {(r["part"], r["source"], r["item"]): r["value"] for r in V.compared(kept, groups).to_pylist()}
    assert got["term", "a", "y"] == share(3 * n, 4 * n) - share(3 * n, 5 * n)
    none = lambda total: share(0, total)
    apart = abs(share(n, 4 * n) - share(n, n)) + abs(share(3 * n, 4 * n) - none(n))
    assert got["pair", "a", "b"] + 2 * abs(none(4 * n) - none(n)) == apart
