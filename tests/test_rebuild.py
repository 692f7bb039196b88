"""Records come back as they were saved; missing, unknown and wrong parts have stated results."""

import hashlib
import json

import pytest

from vellum.sources import rebuild as R

canon = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(salt, option):
    return hashlib.sha256(f"{salt}|{option}".encode()).hexdigest() if salt and option else ""


DOCUMENT = {
    "title": "Prüfung 😀", "version": "1.0", "effective_date": "", "purpose": 'a "b"\n\u001f', "scope": "", "responsibilities": ["x", "ü"], "procedures": [{"step_number": "4.1", "source_lines": [3, 9], "substeps": [], "weight": 1.50}], "safety_warnings": [],
    "definitions": {"z": "last", "a": "first"}, "references": [], "raw_content": "l1\nl2", "provenance": {"title": [1, 1], "definitions": {"z": [2, 2]}}, "lines": ["l1", "l2"], "injection_scan": {"risk": "none", "findings": [], "share": 1.0},
}
MODULE = {"title": "t", "learning_objectives": ["a"], "objectives": [{"text": "a", "source_ref": {"span": [1, 2], "term": None}}], "sections": [{"id": "s", "citations": [[1, 2]]}, {}], "estimated_duration": 12, "prerequisites": [], "summary": "s"}
QUESTION = {"id": "q1", "type": "multiple_choice", "text": "?", "options": ["a b", "c"], "correct_answer": 1, "explanation": "e", "points": 2, "salt": "5a", "source_ref": {"kind": "step", "source_lines": [1, 2]}, "topic": "t"}
QUESTION |= {"answer_hash": digest("5a", "c")}
EMPTY = {"id": "", "type": "", "text": "", "options": [], "correct_answer": None, "explanation": "", "points": 1, "salt": "", "source_ref": {}, "topic": "", "answer_hash": ""}
ASSESSMENT = {"title": "t", "description": "d", "questions": [QUESTION, EMPTY], "passing_score": 80, "time_limit": None, "randomize_questions": False, "randomize_options": True, "requested_questions": 8, "notes": ["n"], "leakage_count": 3}
DEFAULTS = {
    "document": {k: type(v)() for k, v in DOCUMENT.items()}, "module": {k: type(v)() for k, v in MODULE.items()}, "question": EMPTY,
    "assessment": {"title": "", "description": "", "questions": [], "passing_score": 70, "time_limit": None, "randomize_questions": False, "randomize_options": True, "requested_questions": 0, "notes": [], "leakage_count": 0},
}


def made(spark, record, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "job_id long, json string")
    return [r.asDict(True) for r in R.rebuild(df, record, keep=["job_id"]).orderBy("job_id").collect()]


@pytest.mark.parametrize(("record", "value"), [("document", DOCUMENT), ("module", MODULE), ("question", QUESTION), ("assessment", ASSESSMENT)])
def test_round_trip(spark, record, value):
    whole, pretty, default = made(spark, record, canon(value), json.dumps(value, indent=2), canon(DEFAULTS[record]))
    assert whole["saved"] == pretty["saved"] == canon(value)
    assert default["saved"] == canon(DEFAULTS[record])
    assert not whole["faults"] and whole["rest"] is None


@pytest.mark.parametrize("record", ["document", "module", "question", "assessment"])
def test_nothing_to_read(spark, record):
    rows = made(spark, record, "{}", "{bad", "[1]", "null", None, "5", "")
    assert [r["saved"] for r in rows] == [canon(DEFAULTS[record])] * 7
    assert [r["faults"] for r in rows] == [[], ["not an object"], ["not an object"], [], [], ["not an object"], ["not an object"]]


def test_missing_unknown_and_wrong_parts(spark):
    odd = {"title": None, "learning_objectives": None, "objectives": None, "sections": ["not an object"], "estimated_duration": True, "summary": 5, "future": {"a": [1.5]}, "more": None}
    r = made(spark, "module", canon(odd), canon(MODULE | {"prerequisites": [1, "x"], "estimated_duration": 2**70, "title": "t"}))
    a, b = r
    assert (a["title"], a["learning_objectives"], a["objectives"], a["sections"], a["estimated_duration"], a["summary"], a["prerequisites"]) == (None, [], None, [], 0, "", [])
    assert sorted(a["faults"]) == ["estimated_duration", "sections", "summary"] and json.loads(a["rest"]) == {"future": {"a": [1.5]}, "more": None}
    assert (b["prerequisites"], b["estimated_duration"], sorted(b["faults"])) == ([], 0, ["estimated_duration", "prerequisites"])
    a = made(spark, "assessment", canon({"questions": [{"id": "x", "points": "2", "extra": 1}, {}], "leakage_count": None, "passing_score": None, "randomize_options": 0}))[0]
    assert (a["requested_questions"], a["leakage_count"], a["passing_score"], a["randomize_options"], sorted(a["faults"])) == (2, 0, None, True, ["leakage_count", "randomize_options"])
    q = a["questions"][0]
    assert (q["id"], q["points"], q["faults"], q["rest"]) == ("x", 1, ["points"], '{"extra":1}')
    d = made(spark, "document", canon({"lines": None, "provenance": None, "definitions": [1], "responsibilities": "text"}))[0]
    assert (d["lines"], d["provenance"], d["definitions"], d["responsibilities"], sorted(d["faults"])) == (None, None, {}, [], ["definitions", "responsibilities"])


def test_hash_follows_the_edit(spark):
    """The stored hash is never read: it is that of the correct option now, with the old salt."""
    stale = QUESTION | {"correct_answer": 0, "answer_hash": "0" * 64}
    cases = [stale, QUESTION | {"correct_answer": 7}, QUESTION | {"correct_answer": -1}, QUESTION | {"salt": ""}, QUESTION | {"correct_answer": None}]
    got = [r["answer_hash"] for r in made(spark, "question", *map(canon, cases))]
    assert got == [digest("5a", "a b"), "", "", "", ""]
    whole = made(spark, "assessment", canon(ASSESSMENT | {"questions": [stale]}))[0]
    assert whole["questions"][0]["answer_hash"] == digest("5a", "a b") and json.loads(whole["saved"])["questions"][0]["answer_hash"] == digest("5a", "a b")


def test_order_of_terms_and_repeated_keys(spark):
    r = made(spark, "document", '{"definitions":{"b":"1","a":"2","b":"3"},"title":"x","title":"y"}')[0]
    assert r["title"] == "y" and r["definitions"] == {"b": "3", "a": "2"}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, canon(MODULE))], "job_id long, json string").selectExpr("*", "1 as r", "2 as title", "3 as _json", "4 as saved")
    assert R.rebuild(df, "module", keep=["job_id"]).first().saved == canon(MODULE)
    assert R.rebuild(df.limit(0), "module").count() == 0
