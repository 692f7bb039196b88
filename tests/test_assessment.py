"""Invariants of the questions: independent, balanced, ungameable where the document allows, deterministic."""

import json
from collections import Counter, defaultdict

import pytest

from vellum.operators import assessment as A
from vellum.operators import quiz as Z
from vellum.plans import corpus_queries
from vellum.plans import structure_queries as Q

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def questions(spark):
    docs = Q.sops(spark, D)
    f = A.facts(docs)
    q = A.placed(A.assessments(f, (5, 8), (False, True)))
    return f, [r.asDict() for r in q.collect()]


def runs(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"], r["medical"], r["requested"]].append(r)
    return out


def test_shape(questions):
    f, rows = questions
    assert f.count() == 200 and len(runs(rows)) == 800
    for (_, medical, n), own in runs(rows).items():
        assert len(own) <= n and [r["ord"] for r in sorted(own, key=lambda r: r["ord"])] == list(range(1, len(own) + 1))
        assert len({r["id"] for r in own}) == len(own)
        assert sum(r["category"] == "md_required" for r in own) == (2 if medical else 0)
        for r in own:
            assert 2 <= len(r["options"]) <= 4 and len(set(r["options"])) == len(r["options"]) and 0 <= r["correct_answer"] < len(r["options"])
            assert all(0 < len(o) <= 180 for o in r["options"])
            key = " ".join("".join(c if c.isalnum() else " " for c in r["options"][r["correct_answer"]].lower()).split())
            assert A.digest(r["salt"], key) == r["answer_hash"]


def test_independent(questions):
    """No right option is a wrong one of another question."""
    for own in runs(questions[1]).values():
        right = {r["id"]: r["options"][r["correct_answer"]] for r in own if r["type"] != "true_false"}
        leaks = sum(o in [v for k, v in right.items() if k != r["id"]] for r in own if r["type"] != "true_false" for i, o in enumerate(r["options"]) if i != r["correct_answer"])
        assert leaks <= max(r["leaks"] for r in own)
        assert len(set(right.values())) == len(right)


def test_positions_are_even(questions):
    four = Counter(r["correct_answer"] for r in questions[1] if len(r["options"]) == 4)
    assert sum(four.values()) > 40 and max(four.values()) <= 0.45 * sum(four.values())


def test_truth_is_balanced(questions):
    for own in runs(questions[1]).values():
        tf = [r["correct_answer"] for r in own if r["type"] == "true_false" and r["category"] != "md_required"]
        assert sum(tf) >= len(tf) // 2


def test_deterministic(spark, questions):
    again = A.placed(A.assessments(A.facts(Q.sops(spark, D).repartition(3)), (5, 8), (False, True))).collect()
    key = lambda r: (r["doc_id"], r["medical"], r["requested"], r["ord"])
    assert sorted((r.asDict() for r in again), key=key) == sorted(questions[1], key=key)


def test_relayout_after_an_edit(spark, questions):
    """An unedited record comes out as it was; an edited one keeps its texts and gets the same balanced positions."""
    own = [r for r in questions[1] if r["doc_id"] < 20 and r["requested"] == 5 and r["medical"]]
    df = spark.createDataFrame([{k: v for k, v in r.items() if k != "n_options"} for r in own], A.SCHEMA)
    again = {(r.doc_id, r.id): r for r in A.relaid(df).collect()}
    assert len(again) == len(own)
    for r in own:
        new = again[r["doc_id"], r["id"]]
        assert new.correct_answer == r["correct_answer"] and sorted(new.options) == sorted(r["options"]) and new.options[new.correct_answer] == r["options"][r["correct_answer"]]


def test_wrong_options_straddle():
    t = lambda s: A.Text(s, s, s.lower(), "statement")
    out = A.wrong_options(t("m" * 20), [t("a" * 10), t("b" * 30), t("c" * 18), t("d" * 25), t("m" * 20), t("m" * 25), t("")], "s")
    assert [o.clip[0] for o in out] == ["d", "c", "b"]


def test_bisection():
    assert [i for n, _, i in Z.bisection(9) if n == 9] == [4, 1, 6, 0, 2, 5, 7, 3, 8]
    assert all(sorted(i for n, _, i in Z.bisection(12) if n == k) == list(range(k)) for k in range(1, 13))


def test_spread_of_many(spark):
    """Ranks of documents with more items than any table of the SQL holds, against the bisection itself."""
    sizes = [1, 2, 3, 9, 64, 65, 66, 100, 129, 500]
    items = spark.createDataFrame([(n, i + 1) for n in sizes for i in range(n)], "doc_id long, ord long")
    got = {(r.doc_id, r.ord - 1): r.spread for r in Z.spread(items).collect()}
    assert len(got) == sum(sizes)
    for n in sizes:
        spans, order = [(0, n - 1)], []
        while spans:
            low, high = spans.pop(0)
            if low <= high:
                mid = (low + high) // 2
                order.append(mid)
                spans += [(low, mid - 1), (mid + 1, high)]
        assert [got[n, i] for i in order] == list(range(n)), n


def test_sweep_is_of_both_numbers(spark, questions):
    """The registered sweep counts the runs at 5 and at 8 questions that came out short."""
    _, rows = questions
    short = Counter(doc for (doc, _, n), own in runs(rows).items() if len(own) < n)
    assert any(n == 8 and len(own) < n for (_, _, n), own in runs(rows).items())
    got = corpus_queries.sweep(spark, D).collect()
    assert {r.doc_id: r.thin for r in got} == {r.doc_id: short[r.doc_id] for r in got} and len(got) == 200


def by_hand(own, medical):
    """The best score of the sweep's strategies, from the options themselves."""
    total = sum(r["points"] for r in own)
    picks = {f"index{i}_last": lambda r, i=i: min(i, len(r["options"]) - 1) for i in range(4)} | {
        "last": lambda r: len(r["options"]) - 1, "longest": lambda r: max(range(len(r["options"])), key=lambda i: len(r["options"][i])), "shortest": lambda r: min(range(len(r["options"])), key=lambda i: len(r["options"][i])),
        "always_true": lambda r: 0 if r["type"] == "true_false" else None,
    }
    return [(100.0 * sum(r["points"] for r in own if p(r) == r["correct_answer"]) / total, name, medical) for name, p in picks.items()]


def test_sweep_scores(spark, questions):
    """The worst of every run and strategy, those by text included, with the pass mark of the run that gave it."""
    _, rows = questions
    want = {}
    for (doc, medical, _), own in sorted(runs(rows).items()):
        for score, name, kind in by_hand(own, medical):
            if score > want.get(doc, (0.0, None, None))[0]:
                want[doc] = (score, name, kind)
    got = {r.doc_id: r for r in corpus_queries.sweep(spark, D).collect()}
    assert len(got) == 200
    for doc, (score, name, kind) in want.items():
        r = got[doc]
        assert r.ok and (round(r.worst, 6), r.strategy, r.medical, r.passing_score) == (round(score, 6), name, kind, 80 if kind else 70)
        assert r.gameable == (score >= r.passing_score)
    assert {"longest", "shortest"} & {r.strategy for r in got.values()}


def one(doc, medical, score):
    """A question that the last option answers, and one that nothing does, worth so much together."""
    q = {"doc_id": doc, "doc_key": "k", "medical": medical, "requested": 5, "type": "multiple_choice", "n_options": 3}
    return [q | {"id": "a", "options": ["aa", "bb", "cc"], "correct_answer": 2, "points": score}, q | {"id": "b", "options": ["x", "yyy", "zz"], "correct_answer": 9, "points": 100 - score}]


def test_pass_marks_and_errors(spark):
    """A medical run of 70 to 79 is safe and an ordinary one is not; a document that fails is one row and counted."""
    schema = "doc_id long, doc_key string, medical boolean, requested int, type string, n_options int, id string, options array<string>, correct_answer int, points int"
    rows = one(1, True, 75) + one(2, False, 75) + one(3, True, 80)
    f = spark.createDataFrame([(i, ["x"], [], [], [], ["y"]) for i in range(1, 6)], "doc_id long, steps array<string>, warnings array<string>, definitions array<string>, purpose array<string>, scope array<string>")
    errors = spark.createDataFrame([(4, True, 8, "late"), (4, False, 8, "ValueError: bad"), (4, True, 5, "x")], "doc_id long, medical boolean, requested int, error string")
    risks = spark.createDataFrame([(i, "low") for i in range(1, 5)], "doc_id long, risk string")
    df = A.swept(f, spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), errors, risks)
    got = {r.doc_id: r for r in df.collect()}
    assert [(got[i].worst, got[i].passing_score, got[i].gameable, got[i].strategy) for i in (1, 2, 3)] == [(75.0, 80, False, "index2_last"), (75.0, 70, True, "index2_last"), (80.0, 80, True, "index2_last")]
    assert (got[4].ok, got[4].error, got[4].worst, got[4].gameable, got[4].thin) == (False, "ValueError: bad", None, None, None)
    assert (got[5].ok, got[5].worst, got[5].strategy, got[5].gameable, got[5].risk) == (True, 0.0, None, False, None)
    (t,) = Z.sweep(df).collect()
    assert (t.documents, t.errors, t.gameable, t.with_scope, t.risk_low) == (5, 1, 2, 4, 3)


def test_one_bad_document_harms_no_other(spark, questions):
    f, rows = questions
    bad = f.withColumn("warnings", A.F.when(A.F.col("doc_id") == 7, A.F.array(A.F.lit(None).cast(f.schema["warnings"].dataType.elementType))).otherwise(A.F.col("warnings")))
    out = A.attempted(bad, (5, 8), (False, True)).collect()
    assert [(r.doc_id, r.medical, r.requested) for r in out if r.error] == [(7, m, n) for n in (5, 8) for m in (False, True)] and all(r.id is None for r in out if r.error)
    assert sum(not r.error for r in out) == sum(r["doc_id"] != 7 for r in rows)


def test_sweep_totals(spark):
    rows = [(i, i != 39, None, i % 13, 1, 2, True, i % 2 == 0, "low", float(i % 7 * 10), f"s{i}", 70, i % 7 == 6, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, ok boolean, error string, steps long, warnings long, definitions long, has_purpose boolean, has_scope boolean, risk string, worst double, strategy string, passing_score int, gameable boolean, thin long")
    (got,) = Z.sweep(df).collect()
    rows = rows[:39]
    assert (got.documents, got.errors, got.with_scope, got.warnings, got.definitions, got.risk_low, got.risk_none) == (40, 1, 20, 39, 78, 39, 0)
    assert got.thin == sum(r[-1] for r in rows) and got.gameable == sum(r[-2] for r in rows)
    assert {x["steps"]: x["documents"] for x in json.loads(got.steps_per_document)} == Counter(min(r[3], 10) for r in rows)
    assert [(x["doc_id"], x["worst"], x["strategy"]) for x in json.loads(got.worst)] == [(r[0], r[9], r[10]) for r in sorted(rows, key=lambda r: (-r[9], r[0]))[:5]]
