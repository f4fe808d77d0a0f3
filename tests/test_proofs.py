"""What a repository promises: identity of contents through snapshots, packs and collection; and what an attacker cannot do."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from treeline import __main__ as cli
from treeline.functions import binary, codec
from treeline.operators import history
from treeline.plans import api, selfcheck
from treeline.plans.repository import IntegrityError, Repository


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def files(repo, k):
    return {r.path: r.blob_hash for r in repo.files([k]).collect()}


def test_identity_of_contents(spark, tmp_path):
    src = tmp_path / "w" / "src"
    src.mkdir(parents=True)
    same, other, long = b"def f():\n    return 2\n" * 30, b"key = 1\n" * 30, b"".join(b"row %d\n" % k for k in range(400))
    for name, data in (("a.py", same), ("b.py", same), ("c.py", other), ("long.py", long)):
        (src / name).write_bytes(data)
    repo = Repository.init(spark, str(tmp_path / "r"))
    work = str(tmp_path / "w")
    repo.snapshot(work, "one", 1.0)
    one = files(repo, 1)
    assert one["src/a.py"] == one["src/b.py"] == sha(same) and one["src/c.py"] == sha(other)  # equal bytes, one object
    again = repo.snapshot(work, "unchanged", 2.0)
    assert files(repo, 2) == one and again["stats"]["new_objects"] == 0
    (src / "c.py").write_bytes(other + b"more = 1\n")
    (src / "long.py").write_bytes(long + b"end\n")
    repo.snapshot(work, "edited", 3.0)
    three = files(repo, 3)
    assert {p for p in three if three[p] != one[p]} == {"src/c.py", "src/long.py"}
    before = {r.obj_hash: bytes(r.content) for r in repo.contents(repo.stored()).collect()}
    assert all(sha(data) == name for name, data in before.items())
    assert repo.pack()["delta"] >= 1
    assert {r.obj_hash: bytes(r.content) for r in repo.contents(repo.stored()).collect()} == before  # deltas included
    manifest = {r.target: r.base for r in repo.delta_manifest().collect()}
    assert manifest and all(t in before and b in before for t, b in manifest.items())
    repo.remove(3)
    assert repo.gc()["deleted"] > 0
    assert one["src/a.py"] in {r.obj_hash for r in repo.stored().collect()} and files(repo, 1) == one
    assert api.verify_json(repo)["result"] == "ok"
    assert api.diff_json(repo, "1", "2") == {"added": [], "from": 1, "modified": [], "removed": [], "to": 2, "unchanged_count": 4}


@pytest.fixture()
def repo(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "file.txt").write_text("worth keeping " * 20)
    r = Repository.init(spark, str(tmp_path / "r"))
    r.snapshot(str(tmp_path / "w"), "one", 1.0)
    return r


def test_names_that_leave_the_folder(spark, repo, tmp_path):
    names = spark.createDataFrame([("../../evil.txt",), ("..",), ("/etc",)], "n string")
    assert not any(r.v for r in names.select(binary.is_entry_name(F.col("n")).alias("v")).collect())
    entries = repo.tree_entries().withColumn("name", F.lit("../../evil.txt"))
    repo._publish({**repo._current(), "trees": [repo._append("trees", entries)]})
    with pytest.raises(Exception, match="unsafe path"):
        repo.restore(1, str(tmp_path / "a" / "b" / "out"))
    assert not (tmp_path / "a" / "evil.txt").exists() and not (tmp_path / "evil.txt").exists()


def test_links_that_lead_in_a_circle(spark, tmp_path):
    (tmp_path / "w" / "circle").mkdir(parents=True)
    os.symlink(tmp_path / "w" / "circle", tmp_path / "w" / "circle" / "again")
    (tmp_path / "w" / "real.txt").write_text("real")
    r = Repository.init(spark, str(tmp_path / "r"))
    assert r.snapshot(str(tmp_path / "w"), "", 1.0)["stats"]["files"] == 1


@pytest.mark.parametrize("tier", ["objects", "packs"])
def test_a_flipped_byte_is_found_in_every_tier(repo, tmp_path, tier):
    bad = files(repo, 1)["file.txt"]
    if tier == "packs":
        repo.pack()
    selfcheck.flip(repo, tier, bad)
    assert [r.obj_hash for r in repo.verify().collect()] == [bad]
    with pytest.raises(IntegrityError):
        repo.restore(1, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_a_record_whose_root_is_a_file(repo, tmp_path):
    fake = {**repo.load(1), "id": 999, "root_tree_hash": files(repo, 1)["file.txt"]}
    (tmp_path / "r" / "snapshots" / "999.json").write_text(json.dumps(fake))
    with pytest.raises(IntegrityError):
        repo.restore(999, str(tmp_path / "out"))
    with pytest.raises(IntegrityError):
        repo.gc()
    assert not (tmp_path / "out").exists() and not repo.recover_check(999)[0]["recoverable"]


def test_drills_pass(spark):
    assert selfcheck.damage_drill(spark)["passed"]
    told = selfcheck.writers_drill(spark, 2)
    assert told["passed"], told


def test_benchmark_measures_both_tiers(spark):
    told = selfcheck.benchmark(spark, objects=20, reads=50, versions=1)
    assert told["reads"] == 20 and told["loose_disk_bytes"] > 0 and told["pack_disk_bytes"] > 0 and told["read_speedup"] > 0


def test_disk_usage_counts_blocks(tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 10)
    assert selfcheck.disk_usage(str(tmp_path)) % 512 == 0


def test_local_time():
    assert len(cli.local_time(0.0)) == len("1970-01-01 00:00")


def test_a_delta_of_many_steps(spark):
    base, target = bytes(range(256)) * 40, b"".join(bytes(range(k, 256)) + b"-" for k in range(40))
    df = spark.createDataFrame([(bytearray(base), bytearray(target))], "base binary, target binary")
    steps = df.select("base", "target", codec.delta("base", "target").alias("steps"))
    assert steps.select((binary.apply_delta(F.col("base"), F.col("steps")) == F.col("target")).alias("ok")).first().ok


def test_two_chains_in_one_session(spark):
    links = [spark.createDataFrame([(a, b, 2)], "old_path string, new_path string, snapshot_id long") for a, b in (("a", "b"), ("x", "y"))]
    first, second = history.name_chain(spark, links[0], "a"), history.name_chain(spark, links[1], "x")
    assert {r.name for r in first.collect()} == {"a", "b"} and {r.name for r in second.collect()} == {"x", "y"}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_delta_candidates_equal_the_fold(spark, seed):
    """Few contents over many paths, so that most edges decide others; and a history without any edge."""
    import random

    draw = random.Random(seed)
    rows = [(s, f"p{k:02d}", "abcdefgh"[draw.randrange(8)]) for s in range(1, 6) for k in range(12) if draw.random() < 0.9]
    by = {(s, p): h for s, p, h in rows}
    want = {}
    for s in range(2, 6):
        for p in sorted({p for _, p, _ in rows}):
            new, old = by.get((s, p)), by.get((s - 1, p))
            if new and old and new != old and old not in want:
                want[new] = old
    table = lambda r: spark.createDataFrame(r, "snapshot_id long, path string, blob_hash string")
    assert {r.target_hash: r.base_hash for r in history.delta_candidates(table(rows)).collect()} == want
    assert history.delta_candidates(table([])).count() == 0
