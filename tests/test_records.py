"""Trails with one fault each, job figures worked out by hand, and files with damage."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import audit as A
from vellum.operators import metrics as M
from vellum.sources import documents, records, sinks

EVENTS = ["job.created", "content.generated", "review.opened", "content.edited", "content.approved", "package.exported"]
B = "b" * 64
KEY = b"k" * 80


def trail(spark, change=None):
    rows = [["j", i + 1, i + 1, f"2024-01-01T00:00:0{i}.000000+00:00", e, {"name": "x"}, {"content.generated": "a" * 64, "job.created": None, "review.opened": None}.get(e, B), "{}"] for i, e in enumerate(EVENTS)]
    if change:
        change(rows)
    made = A.chained(spark.createDataFrame(rows, "job_id string, file_line int, seq long, ts string, event string, actor struct<name:string>, content_hash string, details string"))
    return made.withColumn("mac", A.hmac_sha256(KEY, F.col("hash")))


def verdict(df, key=None):
    return A.verdicts(df, key).first()


def put(line, column, value):
    return lambda rows: rows[line - 1].__setitem__(column, value)


def test_intact(spark):
    v = verdict(trail(spark), KEY)
    assert (v.ok, v.entries, v.first_bad_seq, v.reason, v.package_matches) == (True, 6, None, None, True)


def test_hash_is_of_canonical_json(spark):
    import hashlib

    r = trail(spark).where("file_line = 1").first()
    text = json.dumps({"seq": 1, "ts": r.ts, "job_id": "j", "event": "job.created", "actor": {"name": "x"}, "content_hash": None, "details": {}, "prev_hash": A.GENESIS}, sort_keys=True, separators=(",", ":"))
    assert r.hash == hashlib.sha256(text.encode()).hexdigest()
    import hmac

    assert r.mac == hmac.new(KEY, r.hash.encode(), hashlib.sha256).hexdigest()


CASES = [
    (put(3, 2, 9), 3, "seq is not contiguous"), (put(4, 4, "odd"), 4, "unknown event"), (put(2, 3, "2024-01-01T00:00:01"), 2, "ts is not a UTC timestamp"), (put(4, 6, None), 4, "carries no content hash"),
    (put(3, 3, "2023-01-01T00:00:00+00:00"), 3, "timestamp goes backwards"), (put(1, 4, "review.opened"), 1, "trail does not start with job.created"), (put(6, 4, "content.edited"), 6, "edited after approval"), (put(6, 6, "c" * 64), 6, "export is not what was approved"),
]


@pytest.mark.parametrize(("change", "seq", "why"), CASES)
def test_workflow_faults(spark, change, seq, why):
    v = verdict(trail(spark, change))
    assert (v.ok, v.first_bad_seq, v.reason) == (False, seq, why)


def test_tampering(spark):
    df = trail(spark)
    changed = verdict(df.withColumn("content_hash", F.when(F.col("file_line") == 4, "d" * 64).otherwise(F.col("content_hash"))))
    assert (changed.ok, changed.first_bad_seq, changed.reason) == (False, 4, "contents do not match the hash")
    cut = verdict(df.where("file_line <> 3"))
    assert cut.reason == "does not chain to the entry before" and cut.first_bad_seq == 3
    assert verdict(df, b"other").reason == "MAC does not verify" and verdict(df.withColumn("mac", F.lit(None).cast("string")), KEY).reason == "no MAC"
    tail = verdict(df.where("file_line < 6"))
    assert tail.ok and tail.package_matches is None  # a cut tail can't be seen


def test_metrics_by_hand(spark):
    jobs = spark.createDataFrame([("a", "draft", None, 5, 11, None, None), ("b", "approved", "s", 3, 11, 3600.0, True), ("c", "approved", "", 0, 11, 1800.0, False)], "job_id string, status string, source_filename string, edits_count long, editable_items long, seconds_to_approve double, audit_verified boolean")
    r = M.overall(jobs).first()
    assert (r.total_jobs, r.approved, r.mean_edits, r.median_edits, r.median_seconds_to_approve, r.failed_audits) == (3, 2, 1.5, 1.5, 2700, 1)
    assert r.approval_rate == pytest.approx(2 / 3) and r.edit_rate == r.mean_edit_rate == pytest.approx(3 / 22)
    none = M.overall(jobs.limit(0)).first()
    assert none.total_jobs == 0 and none.approval_rate is None and none.edit_rate is None
    assert {x.source: x.jobs for x in M.by_source(jobs).collect()} == {"s": 1, M.UNKNOWN_SOURCE: 2}


def test_edit_counts(spark):
    j = lambda d: json.dumps(d)
    old = spark.createDataFrame([("a", j({"title": "t", "learning_objectives": ["x", "y"], "questions": [{"id": "1", "options": ["p", "q"], "correct_answer": 0}]})), ("b", "{bad")], "job_id string, json string")
    new = spark.createDataFrame([("a", j({"title": "t", "learning_objectives": ["x", "z", "w"], "extra": None, "questions": [{"id": "1", "options": ["p", "r"], "correct_answer": 1}]}))], "job_id string, json string")
    got = {r.category: r.edits for r in M.edits_by_category(old, new).collect()}
    assert got == {"objectives": 2, "question_options": 1, "question_answers": 1}
    q = spark.createDataFrame([("a", ["p", "q"], 0, ["q", "p"], 1), ("a", ["p", "q"], 0, ["p", "q"], 1)], "job_id string, options array<string>, correct int, new_options array<string>, new_correct int")
    assert M.answer_changes(q).first().edits == 1


def test_read_jobs(spark, tmp_path):
    job = {"status": "approved", "edits_count": 3, "edit_rounds": True, "created_at": "2024-01-01T00:00:00", "approval": {"approved_at": "2024-01-01T01:00:00"}, "training_module": {"learning_objectives": ["a", "b"], "sections": [{}]}, "assessment": {"questions": [{"options": ["1", "2", "3"]}] * 2}, "edits_by_category": {"title": 1}}
    for name, text in (("a", json.dumps(job)), ("b", "[1]"), ("c", "{bad"), ("d", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    (tmp_path / "empty").mkdir()
    got = {r.job_id: r for r in records.read_jobs(spark, str(tmp_path)).collect()}
    assert set(got) == set("abcd") and [got[k].readable for k in "abcd"] == [True, False, False, True]
    a = got["a"]
    assert (a.editable_items, a.edits_count, a.edit_rounds, a.edits_title, a.seconds_to_approve, a.seconds_to_first_edit, a.num_questions) == (11, 3, 0, 1, 3600.0, None, 2)
    assert (got["d"].status, got["d"].editable_items, got["d"].seconds_to_approve) == ("unknown", 0, None)


def test_read_trails(spark, tmp_path):
    good = {k: "x" for k in A.FIELDS} | {"seq": 1, "actor": {"name": "n"}, "details": {}, "mac": None, "content_hash": None}
    lines = [json.dumps(good), "", "{bad", "[1]", json.dumps(good | {"more": 1}), json.dumps({k: v for k, v in good.items() if k != "ts"}), json.dumps(good | {"seq": True}), json.dumps(good | {"ts": 5}), json.dumps(good | {"mac": 5})]
    (tmp_path / "job1").mkdir()
    (tmp_path / "job1" / "audit.jsonl").write_text("\n".join(lines) + '\n{"seq"')
    entries, problems = records.read_trails(spark, str(tmp_path))
    assert [(r.job_id, r.file_line, r.seq, r.claimed_job_id) for r in entries.collect()] == [("job1", 1, 1, "x")]
    assert {r.file_line: r.problem for r in problems.collect()} == {2: "blank line", 3: "not valid JSON", 4: "entry is not an object", 5: "unknown fields: more", 6: "missing fields: ts", 7: "seq is not an integer", 8: "ts is not a string", 9: "mac is not a string or null", 10: "incomplete final line"}


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("one\ntwo é")
    (tmp_path / "b.md").write_text("# Title #\n- **bold** [link](u)\n1. <b>x</b> `code`\n")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(b"junk")
    (tmp_path / "e.exe").write_bytes(b"\xff")
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.TXT"].text == "one\ntwo é" and got["b.md"].text == "Title\n\nbold link\nx code\n" and got["b.md"].raw.startswith("# Title") and got["c.docx"].text == "Hello you\n"
    assert got["d.docx"].text is None and got["d.docx"].error.startswith("BadZipFile") and got["e.exe"].error == "unsupported format: exe" and got["f.txt"].error == "not UTF-8"


def test_sinks(spark, tmp_path):
    q = spark.createDataFrame([(1, "q", 0, None, "s")], "doc_id long, id string, correct_answer int, explanation string, salt string")
    sinks.write_json(q, str(tmp_path / "all"))
    sinks.write_learner_json(q, str(tmp_path / "learner"))
    read = lambda d: json.loads("".join(p.read_text() for p in (tmp_path / d).glob("part-*")))
    assert read("all")["explanation"] is None and read("all")["correct_answer"] == 0
    assert set(read("learner")) == {"doc_id", "id", "salt"}


def test_stream(spark, tmp_path):
    from vellum.streaming import trails

    (tmp_path / "in").mkdir()
    rows = [{"job_id": "j", "seq": i, "ts": f"2024-01-01T0{i}:30:00+00:00", "event": "e", "prev_hash": "", "hash": f"h{i}"} for i in range(4)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = trails.heads(trails.read_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("heads").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("heads").collect()] == [("j", 4, "h3", 3)]


def test_retention_listing_and_samples(spark, tmp_path):
    df = trail(spark)
    jobs = spark.createDataFrame([("j", "2024-01-01T00:00:00"), ("k", "2024-01-01T00:00:00"), ("new", "2024-01-09T00:00:00"), ("odd", "?")], "job_id string, updated_at string")
    got = {r.job_id: r.head_hash for r in records.expired(jobs, df, "2024-01-10 00:00:00", 5 * 86400).collect()}
    assert got == {"j": df.where("file_line = 6").first().hash, "k": A.GENESIS}
    shown = [r.shown for r in A.log_lines(df).orderBy("file_line").collect()]
    assert len(shown) == 6 and shown[0].startswith("   1  2024-01-01T00:00:00.000000+00:00  job.created        ")
    (tmp_path / "i.json").write_text(json.dumps([{"id": "good_1", "title": "a"}, {"id": "../bad", "title": "b"}]))
    assert [r.id for r in records.read_catalogue(spark, str(tmp_path / "i.json")).collect()] == ["good_1"]


def test_manifest(spark):
    sections = spark.createDataFrame([(1, "intro", 1), (1, "summary", 5)], "doc_id long, id string, `order` int")
    assert [(r.item, r.file) for r in sinks.manifest(sections, "2004").orderBy("ord").collect()] == [("item_intro", "intro.html"), ("item_summary", "summary.html"), ("item_assessment", "assessment.html")]
