"""Canonical JSON against Python's, and differences of records against a recursive walk."""

import json
import random

import pytest

from vellum.functions import jsons
from vellum.operators import metrics as M

TEXTS = [
    '{"b": 1, "a": [1, {"z": 1, "y": null}]}', '{"a": 1.0}', '{"a":1e5,"b":1E400,"c":-0,"d":-0.0,"e":0.1,"f":1.50}', '{"a":1,"b":2,"a":3}', '{"x":{"k":1,"k":{"k":2}}}', '"\\ud83d\\ude00 \\u00e9 \\/ \\u001f \\n"', '{"😀":1,"￮":2,"z":3}',
    "12345678901234567890123456789012345678901234567890", '{"a":1} x', "[1,]", "01", "{'a':1}", "NaN", "", "  5 ", '"a\tb"', '["a  b", "c"]', "true", '{"a":"\\ud800"}', '{"a b":"x y","a":"\\\\"}', "[[[[]]]]", '{"":0}', "{bad", '"1.0"', '{"a":123456789012345678}', "1" * 5000,
]


def python_form(text):
    try:
        out = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        out.encode()
        return out
    except ValueError:
        return None


def test_canonical_json_is_pythons(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    got = {r.t: r.c for r in df.select("t", jsons.canonical(df.t).alias("c")).collect()}
    assert got == {t: python_form(t) for t in TEXTS} | {None: None}


def test_depth(spark):
    cases = {'{"a":[1,{"b":"]]}{{["}]}': 3, "5": 0, '"[["': 0, "[]": 1, '{"a\\"[":"\\\\","b":[[]]}': 3, "[" * 30 + "]" * 30: 30}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.d for r in df.select("t", jsons.depth(df.t).alias("d")).collect()} == cases


ABSENT = object()


def walk(a, b):
    """Paths of the least differing parts."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [f"\x01{k}{p}" for k in {*a, *b} for p in walk(a.get(k), b.get(k))]
    if isinstance(a, list) and isinstance(b, list):
        at = lambda x, i: x[i] if i < len(x) else ABSENT
        return [f"\x01#{i}{p}" for i in range(max(len(a), len(b))) for p in walk(at(a, i), at(b, i))]
    return [] if a == b else [""]


def value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {rng.choice("abcdé."): value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth and kind < 0.7:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 0, 1, 1.0, 2, 2.5, 1e5, 100000, "", "x", "y", 2**70, "é\u001f"])


def nested(n, leaf):
    for i in range(n):
        leaf = {"k": leaf} if i % 2 else [leaf]
    return leaf


def test_differences_equal_a_recursive_walk(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = value(rng, 5)
        b = json.loads(json.dumps(a)) if rng.random() < 0.3 else value(rng, 5)
        pairs.append((a, b))
    pairs += [({"a": {"b": [1, 2]}}, {}), ({"a": None}, {}), ([None], []), ([], {}), ({"a": [1, [2, {"c": 1}]]}, {"a": [1, [2, {"c": 2, "d": 0}], 5]})]
    pairs += [(nested(d, 1), nested(d, 2)) for d in (7, 8, 20, 40)] + [(nested(20, 1), nested(10, 5))]
    old = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(pairs)], "job_id long, json string")
    new = spark.createDataFrame([(i, json.dumps(b)) for i, (_, b) in enumerate(pairs)], "job_id long, json string")
    got = sorted((r.job_id, r.path) for r in M.differences(old, new).collect())
    assert got == sorted((i, p) for i, (a, b) in enumerate(pairs) for p in walk(a, b))
    counts = {r.job_id: r.edits for r in M.edit_counts(old, new).collect()}
    assert counts == {i: len(walk(a, b)) for i, (a, b) in enumerate(pairs) if walk(a, b)}


def test_records_of_one_side(spark):
    old = spark.createDataFrame([("a", '{"x":1}'), ("b", "{bad"), ("c", None), ("d", '{"x":1,"x":2}')], "job_id string, json string")
    new = spark.createDataFrame([("d", '{"x":2.0}'), ("e", "[]")], "job_id string, json string")
    assert sorted(tuple(r) for r in M.differences(old, new).collect()) == [("a", "", '{"x":1}', "null"), ("e", "", "null", "[]")]
    assert M.differences(old.limit(0), new.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (lambda r: r["questions"].pop(), {"questions": 1}),
        (lambda r: r["questions"].append({"id": "n", "options": ["a", "b", "c"]}), {"questions": 1}),
        (lambda r: r["questions"][0].update(correct_answer=1), {"question_answers": 1}),
        (lambda r: r["questions"][0].update(options=["q", "p"], correct_answer=1), {"question_options": 2}),
        (lambda r: r["questions"][0].update(options=["z", "q"]), {"question_options": 1, "question_answers": 1}),
        (lambda r: r["questions"][0].update(options=None), {"question_options": 1, "question_answers": 1}),
        (lambda r: r["questions"][0].update(text="new", points=2), {"questions": 2}),
        (lambda r: r["sections"][0].update(citations=[[1, 2], [3, 9]]), {"sections": 1}),
        (lambda r: r.update(title="n", learning_objectives=[]), {"title": 1, "objectives": 2}),
    ],
)
def test_categories(spark, change, want):
    record = lambda: {"title": "t", "learning_objectives": ["x", "y"], "sections": [{"id": "s", "citations": [[1, 2], [3, 4]]}], "questions": [{"id": "1", "text": "w", "points": 1, "options": ["p", "q"], "correct_answer": 0}, {"id": "2", "options": ["a"], "correct_answer": True}]}
    edited = record()
    change(edited)
    make = lambda r: spark.createDataFrame([("j", json.dumps(r))], "job_id string, json string")
    assert {r.category: r.edits for r in M.edits_by_category(make(record()), make(edited)).collect()} == want
