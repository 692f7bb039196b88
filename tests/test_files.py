"""Digests of files of any size, and folders that are recorded before they go."""

import hashlib
import json
import os

from test_append import logged

from vellum.operators import audit as A
from vellum.operators import grounding as G
from vellum.sources import files
from vellum.streaming import append as P


def test_file_hashes(spark, tmp_path):
    contents = {"a.bin": b"a", "b c.txt": "é".encode() * 1000, "sub/d.zip": os.urandom(3_000_000)}
    (tmp_path / "sub").mkdir()
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "empty").touch()
    for whole in (0, 2000, 1 << 28):
        got = {os.path.relpath(r.path.removeprefix("file:"), tmp_path): (r.length, r.sha256) for r in files.file_hashes(spark, str(tmp_path), whole).collect()}
        assert got == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in contents.items()}


def aged(path, seconds):
    for p in path.rglob("*"):
        os.utime(p, (seconds, seconds))


def test_folders_go_after_they_are_recorded(spark, tmp_path):
    folder, store = tmp_path / "jobs", tmp_path / "store"
    for job in ("old", "bare", "stuck", "new"):
        (folder / job).mkdir(parents=True)
        (folder / job / "job.json").write_text("{}")
        if job != "bare":
            (folder / job / "audit.jsonl").write_text("\n".join(logged(3, job)) + "\n")
        aged(folder / job, 1_600_000_000 if job == "new" else 1_500_000_000)
    head = json.loads(logged(3, "old")[-1])["hash"]
    (folder / ".retired" / "stuck").mkdir(parents=True)  # nothing can be set aside under this name
    (folder / ".retired" / "stuck" / "x").write_text("left over")
    now = "2020-09-13 12:26:40"
    got = {(r.job_id, r.state): (r.head_hash, r.error) for r in files.retire(spark, str(folder), str(store), now, 86400).collect()}
    assert got["old", "gone"] == (head, None) and got["bare", "gone"] == (A.GENESIS, None) and got["stuck", "kept"][1].startswith("FileExistsError")
    assert sorted(p.name for p in folder.iterdir() if p.name[0] != ".") == ["new", "stuck"] and (folder / "stuck" / "audit.jsonl").exists()
    entries = P.read_store(spark, str(store))[0].orderBy("seq").collect()
    told = {json.loads(r.details)["job_id"]: json.loads(r.details)["head_hash"] for r in entries}
    assert told == {"old": head, "bare": A.GENESIS, "stuck": A.GENESIS} and {r.event for r in entries} == {"retention.deleted"}  # the left-over folder was recorded as what it was
    # now the name is free; the next run takes the folder and goes on with the chain
    got = {(r.job_id, r.state): r.head_hash for r in files.retire(spark, str(folder), str(store), now, 86400).collect()}
    assert got == {("stuck", "gone"): json.loads(logged(3, "stuck")[-1])["hash"]}
    trail = P.read_store(spark, str(store))[0]
    assert trail.count() == 4 and A.verdicts(trail).first().reason == "trail does not start with job.created" and A.problems(trail).count() == 1
    assert files.retire(spark, str(folder), str(store), now, 86400).count() == 0


def test_a_run_that_broke_off(spark, tmp_path):
    """Set aside and recorded, but not deleted: the next run deletes it and doesn't record it again."""
    folder, store = tmp_path / "jobs", tmp_path / "store"
    for _ in range(2):
        (folder / ".retired" / "j").mkdir(parents=True)
        (folder / ".retired" / "j" / "audit.jsonl").write_text("\n".join(logged(2)) + "\n")
        assert [r.state for r in files.retire(spark, str(folder), str(store), "2020-01-01 00:00:00", 1).collect()] == ["gone"]
    assert P.read_store(spark, str(store))[0].count() == 1


def test_merged_notes(spark):
    rows = [(i % 97, i, f"n{i * 7919 % 500}") for i in range(3000)]
    first = {}
    for r in sorted(rows):
        first.setdefault(r[2], len(first) + 1)
    got = {r.note: r.place for r in G.merged_notes(spark.createDataFrame(rows, "report long, ord long, note string")).collect()}
    assert got == first
