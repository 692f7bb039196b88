"""Chains that go on where they were, from many writers, over replays, damage and files in many splits."""

import hashlib
import hmac
import json
import threading

import pytest
from pyspark.sql import functions as F

from vellum.operators import audit as A
from vellum.sources import records
from vellum.streaming import append as P

KEY = b"k" * 80
NOW = "2024-05-01T00:00:00.000000+00:00"


def request(i, job="j", event="download.served", **k):
    return {"request_id": f"r{i:04}", "asked": f"2024-01-01T00:00:{i % 60:02}", "job_id": job, "event": event, "actor": {"name": f"w{i % 8}", "role": "load", "source": "system"}, "content_hash": None, "details": json.dumps({"index": i, "n": 1.0, "é": "\u001f"})} | k


def frame(spark, rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", P.REQUEST).alias("r")).select("r.*")


def written(store):
    return [json.loads(x) for p in sorted((store / "entries").glob("batch=*/part-*"), key=lambda p: (int(p.parent.name[6:]), p.name)) for x in p.read_bytes().decode().split("\n") if x]


def test_many_writers_one_chain(spark, tmp_path):
    """Eight writers with 25 requests each for one job and one each for another, in batches of a few files."""
    inbox, store = tmp_path / "inbox", tmp_path / "store"
    inbox.mkdir()

    def write(w):
        for k in range(25):
            rows = [request(8 * k + w)] + ([request(1000 + w, "other", "job.created")] if k == 24 else [])
            (inbox / f".{w}-{k}").write_text("\n".join(map(json.dumps, rows)) + "\n")
            (inbox / f".{w}-{k}").rename(inbox / f"{w}-{k}.json")

    threads = [threading.Thread(target=write, args=(w,)) for w in range(8)]
    for t in threads[:4]:
        t.start()
    for t in threads[:4]:
        t.join()
    assert P.appending(spark, str(inbox), str(store), KEY).awaitTermination(300)
    for t in threads[4:]:
        t.start()
    for t in threads[4:]:
        t.join()
    assert P.appending(spark, str(inbox), str(store), KEY).awaitTermination(300)
    entries, problems = P.read_store(spark, str(store))
    assert problems.count() == 0
    got = [r for r in entries.orderBy("file_line").collect() if r.job_id == "j"]
    assert [r.seq for r in got] == [r.file_line for r in got] == list(range(1, 201))
    assert len({r.hash for r in got}) == 200 and sorted(json.loads(r.details)["index"] for r in got) == list(range(200))
    # by an own reading of the format
    prev = A.GENESIS
    for e in (x for x in written(store) if x["job_id"] == "j"):
        body = {k: v for k, v in e.items() if k not in ("hash", "mac")}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert e["prev_hash"] == prev and e["hash"] == hashlib.sha256(text.encode()).hexdigest() and e["mac"] == hmac.new(KEY, e["hash"].encode(), hashlib.sha256).hexdigest()
        prev = e["hash"]
    verdict = {r.job_id: r for r in A.verdicts(entries, KEY).collect()}
    assert (verdict["other"].ok, verdict["other"].entries) == (True, 8) or verdict["other"].reason == "trail does not start with job.created"
    assert verdict["j"].reason == "trail does not start with job.created" and verdict["j"].problems == 1 and verdict["j"].head_hash == prev


def test_a_batch_counts_once(spark, tmp_path):
    store = str(tmp_path)
    P.append(frame(spark, [request(i) for i in range(3)]), store, 0, NOW)
    for _ in range(3):
        P.append(frame(spark, [request(i) for i in (5, 4, 5)] + [request(9, "k")]), store, 1, NOW)
    P.append(frame(spark, [request(7)]), store, 2, "2020-01-01T00:00:00.000000+00:00")
    entries = P.read_store(spark, store)[0]
    got = entries.where("job_id = 'j'").orderBy("file_line").collect()
    assert [(r.seq, json.loads(r.details)["index"]) for r in got] == [(1, 0), (2, 1), (3, 2), (4, 4), (5, 5), (6, 7)]
    assert {r.ts for r in got} == {NOW}  # a clock that went back doesn't take the chain with it
    assert {r.job_id: r.problems for r in A.verdicts(entries).collect()} == {"j": 1, "k": 1}  # none starts with job.created


def test_refused_requests(spark, tmp_path):
    bad = [request(1, job=" "), request(2, event="odd"), request(3, actor={"name": "", "source": "web"}), request(4, actor={"name": "n", "source": "moon"}), request(5, content_hash="abc"), request(6, details="[1]"), request(7, details="{bad"), request(8, actor=None)]
    P.append(frame(spark, [*bad, request(9, details=None, content_hash="a" * 64)]), str(tmp_path), 0, NOW)
    (e,) = written(tmp_path)
    assert e["details"] == {} and e["seq"] == 1
    why = {r.request_id: r.why for r in spark.read.json(str(tmp_path / "rejected")).collect()}
    assert why == {"r0001": "job_id is empty", "r0002": "unknown event", "r0003": "actor has no name", "r0004": "unknown source of actor", "r0005": "content_hash is no SHA-256", "r0006": "details are no JSON object", "r0007": "details are no JSON object", "r0008": "actor has no name"}
    P.append(frame(spark, bad).limit(0), str(tmp_path), 1, NOW)
    assert len(written(tmp_path)) == 1


def logged(n, job="j"):
    """An intact log, made by hand."""
    out, prev = [], A.GENESIS
    for i in range(1, n + 1):
        e = {"seq": i, "ts": f"2024-01-01T00:{i // 60:02}:{i % 60:02}.000000+00:00", "job_id": job, "event": "job.created" if i == 1 else "review.opened", "actor": {"name": "ü", "role": "r", "source": "web"}, "content_hash": None, "details": {"x": 1.50, "text": "é\n" * (i % 4)}, "prev_hash": prev}
        prev = hashlib.sha256(json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        out.append(json.dumps(e | {"hash": prev, "mac": None}, ensure_ascii=False))
    return out


@pytest.mark.parametrize("split", [64, 500, 1 << 20])
def test_trails_in_many_splits(spark, tmp_path, split):
    """Lines longer than a split, several lines in one, whole files; with and without an end, blank and broken lines."""
    lines = logged(60)
    for job, text in (("j", "\n".join(lines) + "\n"), ("cut", "\n".join(lines[:7])), ("blank", lines[0] + "\n\n{bad\n\xff\n"), ("none", "")):
        (tmp_path / job).mkdir()
        (tmp_path / job / "audit.jsonl").write_bytes(text.encode("latin1") if job == "blank" else text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        entries, problems = records.read_trails(spark, str(tmp_path))
        got = {}
        for r in entries.orderBy("file_line").collect():
            got.setdefault(r.job_id, []).append((r.file_line, r.seq, r.line))
        assert got["j"] == [(i + 1, i + 1, x) for i, x in enumerate(lines)]
        assert [x[0] for x in got["cut"]] == [1, 2, 3, 4, 5, 6] and [x[0] for x in got["blank"]] == [1] and set(got) == {"j", "cut", "blank"}
        assert sorted((r.job_id, r.file_line, r.problem) for r in problems.collect()) == [("blank", 2, "blank line"), ("blank", 3, "not valid JSON"), ("blank", 4, "not valid JSON"), ("cut", 7, "incomplete final line")]
        verdict = {r.job_id: r for r in A.verdicts(entries).collect()}
        assert verdict["j"].ok and verdict["j"].entries == 60  # hashes of what was read, numbers as they stand
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_damaged_log_goes_on(spark, tmp_path):
    """The last line was cut: the chain goes on from the one before, and the damage stays reported."""
    folder, store = tmp_path / "logs", tmp_path / "store"
    (folder / "j").mkdir(parents=True)
    lines = logged(5)
    (folder / "j" / "audit.jsonl").write_text("\n".join(lines)[:-20])
    before = (folder / "j" / "audit.jsonl").read_bytes()
    entries, problems = records.read_trails(spark, str(folder))
    P.adopt(entries, str(store))
    P.append(frame(spark, [request(1), request(2)]), str(store), 0, NOW)
    e = written(store)
    assert [x["seq"] for x in e] == [5, 6] and e[0]["prev_hash"] == json.loads(lines[3])["hash"]
    assert (folder / "j" / "audit.jsonl").read_bytes() == before and [r.problem for r in problems.collect()] == ["incomplete final line"]
    more = P.read_store(spark, str(store))[0].withColumn("file_line", F.col("file_line") + 4)
    v = A.verdicts(entries.unionByName(more)).first()
    assert v.ok and v.entries == 6
