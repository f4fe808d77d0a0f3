"""Damage must never lose live data: collection, packing and restoring stop before they write or delete."""

import hashlib
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from treeline.functions import binary
from treeline.operators import audit, trees
from treeline.plans.repository import IntegrityError, Repository


@pytest.fixture()
def repo(spark, tmp_path):
    work = tmp_path / "w"
    (work / "a" / "b").mkdir(parents=True)
    (work / "a" / "b" / "x.txt").write_text("deep")
    (work / "top.txt").write_text("top")
    r = Repository.init(spark, str(tmp_path / "r"))
    r.snapshot(str(work), "one", 1.0)
    return r


def replace(repo, kind, rows):
    live = repo._current()
    name = repo._append(kind, rows)
    with open(os.path.join(repo.path, "CURRENT"), "w") as f:
        json.dump({**live, kind: [name]}, f)


def stored(repo):
    return sorted(r.obj_hash for r in repo.stored().collect())


@pytest.mark.parametrize("lost", ["all", "root", "inner"])
def test_lost_trees_stop_everything(repo, tmp_path, lost):
    root = repo.load(1)["root_tree_hash"]
    entries = repo.tree_entries()
    inner = entries.where(F.col("name") == "x.txt").first().tree_hash
    replace(repo, "trees", entries.where({"all": F.lit(False), "root": F.col("tree_hash") != root, "inner": F.col("tree_hash") != inner}[lost]))
    before = stored(repo)
    with pytest.raises(IntegrityError):
        repo.gc()
    assert stored(repo) == before
    with pytest.raises(IntegrityError):
        repo.restore(1, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    report, issues = repo.recover_check(1)
    assert not report["recoverable"] and "unreadable tree" in {i["detail"] for i in issues}


def test_damaged_loose_object_stops_the_pack(repo):
    h = hashlib.sha256(b"top").hexdigest()
    damaged = repo.objects().withColumn("content", F.when(F.col("obj_hash") == h, F.lit(b"??")).otherwise(F.col("content")))
    replace(repo, "objects", damaged)
    before = stored(repo)
    with pytest.raises(IntegrityError):
        repo.pack()
    assert stored(repo) == before and [r.obj_hash for r in repo.verify().collect()] == [h]


def test_restore_makes_its_folder_and_a_damaged_pack_is_quarantined(repo, tmp_path):
    out = tmp_path / "new" / "folder"
    assert repo.restore(1, str(out)) == 2 and (out / "a" / "b" / "x.txt").read_text() == "deep"
    shutil.rmtree(out)
    done = repo.pack("p")
    h = hashlib.sha256(b"top").hexdigest()
    replace(repo, "packs", repo.every_packed().withColumn("length", F.when(F.col("obj_hash") == h, F.lit(3).cast("long")).otherwise(F.col("length"))))
    assert done["pack"] == "p" and repo.quarantine() == {"p": "entry of another length"}
    assert repo.packed().count() == 0
    _, issues = repo.recover_check(1)
    assert {i["detail"] for i in issues} == {"stranded in p"}
    with pytest.raises(IntegrityError):
        repo.gc()


def test_log_tells_when_and_why(repo, tmp_path):
    entry = repo.log("top.txt")["entries"][0]
    assert (entry["timestamp"], entry["message"]) == (1.0, "one")


def test_halves_to_even(spark):
    sizes = [0, 1023, 1024, 32000, 1024 * 1024 + 512 * 1024 // 10, 31 * 1024 + 256, 31 * 1024 + 768, 5 * 1024**3 // 4, 1152921504606846976]
    python = [f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB" if n < 1024**3 else f"{n / 1024**3:.1f} GB" for n in sizes]
    assert [r.h for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(binary.human_bytes(F.col("n")).alias("h")).collect()] == python


def test_first_place_in_depth_first_order(spark):
    refs = spark.createDataFrame([("a.txt", "zz"), ("a/x", "zz")], "path string, object string")
    objs = spark.createDataFrame([], "obj_hash string, ok boolean")
    links = spark.createDataFrame([], "target string, base string")
    bad = spark.createDataFrame([], "pack_name string, obj_hash string")
    assert [tuple(r) for r in audit.recover_issues(refs, objs, links, bad).collect()] == [("a/x", "zz", "malformed hash")]


def test_walk_has_no_row_limit(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    files = spark.range(300).selectExpr("1L AS snapshot_id", "concat('d', id % 7, '/e/', id) AS path", "sha2(cast(id AS string), 256) AS blob_hash")
    entries, roots = trees.build_trees(files)
    assert trees.flatten(trees.walk(entries, roots)).count() == 300
    assert trees.lost_trees(entries, trees.walk(entries, roots), roots).isEmpty()
    spark.conf.unset("spark.sql.cteRecursionRowLimit")
