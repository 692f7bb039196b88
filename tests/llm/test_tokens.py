"""BPE against the tokenizers library, packing against a token-by-token round trip."""

import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellum.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "Hello, World! it's 10% é ñ 'the'  a\n\nb", "a<|endoftext|>b <|startoftext|>", "x\x1cy \x1f z\x00\x7f", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ é ́a 日本語 😀😀 ١٢ ²½", "don't I'LL we'Ve ''s's",
       "​﻿\xad a\xa0b　c᠎d\x85e", "x" * 5000, "no. no, no.. no., n.o .no ,.", "H̱ É", "donaudampfschifffahrtsgesellschaftskapitän " * 3]


def same(v, texts):
    for t, (ids, entries) in zip(texts, v.encode(texts), strict=True):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert v.decoded(entries).decode() == LIBRARY.decode(want, skip_special_tokens=False), t


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(PATH, True, 300)  # a small table, so that it starts anew again and again


def test_odd_texts(vocab):
    same(vocab, ODD)
    for t in ODD:
        same(vocab, [t])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aAbZ'st re0129!?.,<|>éÉñßΣς̧́İ日😀\xa0\x1c\x85 \t\n", max_size=60)), max_size=4))
def test_any_text(vocab, texts):
    same(vocab, texts)


def test_cuts_are_certain(vocab):
    """No token of the vocabulary holds a pair that is cut, and some pairs are cut inside words."""
    assert all(a + b in vocab.inside for t in LIBRARY.get_vocab() if not t.startswith("<|") for a, b in pairwise(t.removesuffix("</w>")))
    assert not vocab.joined[ord("j"), ord("q")]


def test_documents(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, None])] + [(2, ODD[2], "x", 1), (None, "a", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = bpe.encode_documents(df, PATH).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in out) == Counter((i, np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t, *_ in rows)
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.encode_digests(df, PATH).collect()}[0] == 0


def check_packed(out, rows, size):
    docs = defaultdict(list)
    for i, t, s in rows:
        docs[i].append((np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), s or ""))
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for off, n in sorted(s):
            assert off == at and n > 0
            at += n
        assert at == size or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    for i, copies in docs.items():
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens, r.queue) for r in out if r.doc_id == i)
        if len(copies) == 1:
            ids, source = copies[0]
            at = 0
            for start, n, crc, total, s in own:
                assert start == at and crc == zlib.crc32(ids[start : start + n]) and total == len(ids) and s == source
                at += n
            assert at == len(ids)
        else:
            assert sum(n for _, n, *_ in own) == sum(len(x) for x, _ in copies)


def test_packing_round_trip(spark):
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, " ".join(words[(i * j) % 6] for j in range(i * 7 % 90)), "hot" if i % 3 else f"s{i % 5}") for i in range(200)] + [(900, None, None), (901, "", "s1"), (902, "word " * 3000, "s2"), (7, "again", "hot")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, start int").repartition(3)
    out = packing.pack(df, PATH, size=64).collect()
    check_packed(out, rows, 64)
    by = defaultdict(Counter)
    for r in out:
        by[r.sequence_id][r.queue] += r.length
    total = Counter()
    for r in out:
        total[r.queue] += r.length
    n = sum(total.values())
    full = [s for s in by if sum(by[s].values()) == 64]
    so_far = Counter()
    for s in sorted(full):  # each prefix of windows holds the proportions, to within a few tokens
        so_far += by[s]
        for q, t in total.items():
            assert abs(so_far[q] - 64 * (s + 1) * t / n) <= 3
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_packing_with_target_shares(spark):
    rows = [(i, "a b c d e f g h " * 20, "x" if i % 2 else "y" if i % 4 else "z") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(df, PATH, shares={"x": 1.0, "y": 3.0}, size=128).collect()
    check_packed(out, rows, 128)
    first = [r for r in out if r.sequence_id < 30]
    assert abs(sum(r.length for r in first if r.queue == "y") / (30 * 128) - 0.75) < 0.01
    assert not any(r.queue == "z" for r in first)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=12), st.sampled_from([1, 7, 64]), st.booleans())
def test_schedule(totals, size, even):
    plan = packing.Schedule(np.array(totals), np.ones(len(totals)) if even else None, size)
    taken = plan.taken(np.arange(plan.full + 2))
    assert (taken.sum(1) == np.minimum(np.arange(plan.full + 2) * size, sum(totals))).all()
    assert (np.diff(taken, axis=0) >= 0).all() and (taken[-1] == totals).all()
    for q, t in enumerate(totals):
        for x in {0, t // 2, t - 1} if t else ():
            lo, hi = plan.near(q, x, x)
            assert plan.taken(np.array([lo]))[0, q] <= x < plan.taken(np.array([hi]))[0, q]


def test_more_sources_than_queues(spark, monkeypatch):
    """Targets hold with any number of sources; the others share queues."""
    monkeypatch.setattr(packing, "QUEUES", 8)
    df = spark.createDataFrame([(i, "word " * 40, "y" if i % 2 else f"s{i}") for i in range(400)], "doc_id long, text string, source string")
    out = packing.pack(df, PATH, shares={"y": 3.0, "none": 1.0}, size=128).collect()
    assert len({r.queue for r in out}) <= 9 and {r.doc_id for r in out} == set(range(400))
    first = [r for r in out if r.sequence_id < 60]
    assert all(r.queue == "y" for r in first)
    assert {r.queue for r in packing.pack(df, PATH, size=128).collect()} <= {f"#{i}" for i in range(8)}
