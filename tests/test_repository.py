import hashlib
import json
import os
import subprocess
import sys

import pytest

from treeline.functions import codec
from treeline.plans import api
from treeline.plans.fixture_dir import demo
from treeline.plans.lock import LockTimeout, RepositoryLock
from treeline.plans.repository import IntegrityError, Repository, RepositoryError, parse_record


def put(folder, **files):
    for name, text in files.items():
        path = os.path.join(folder, name.replace("__", "/").replace("_dot_", "."))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Two snapshots of the sample, one with edits, a rename, a deletion and a new empty folder."""
    work, store = str(tmp_path_factory.mktemp("work")), str(tmp_path_factory.mktemp("store") / "r")
    repo = Repository.init(spark, store)
    demo(work)
    os.makedirs(f"{work}/.git/x")
    put(work, **{".git__x__skip_dot_txt": "no"})
    os.symlink(f"{work}/README.md", f"{work}/link.md")
    first = repo.snapshot(work, "first", 1.0)
    os.rename(f"{work}/src/auth.py", f"{work}/src/login.py")
    with open(f"{work}/data/numbers.csv", "a") as f:
        f.write("50,2500\n")
    os.unlink(f"{work}/README.md")
    os.makedirs(f"{work}/hollow")
    second = repo.snapshot(work, "second", 2.0)
    return repo, work, first, second


def tree(entries):
    body = b"".join((b"b" if k == "blob" else b"t") + len(n.encode()).to_bytes(2, "big") + n.encode() + h.encode() for n, k, h in sorted(entries))
    return hashlib.sha256(body).hexdigest()


def test_stats_and_root(world):
    repo, work, first, second = world
    assert first["stats"]["files"] == 11 and first["stats"]["new_objects"] + first["stats"]["reused_objects"] == 11
    assert first["parent"] is None and second["parent"] == first["id"]
    assert second["stats"]["new_objects"] == 1

    def merkle(folder):
        out = []
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if name == ".git" or os.path.islink(path):
                continue
            if os.path.isdir(path):
                out.append((name, "tree", merkle(path)))
            else:
                with open(path, "rb") as f:
                    out.append((name, "blob", hashlib.sha256(f.read()).hexdigest()))
        return tree(out)

    assert second["root_tree_hash"] == merkle(work)


def test_diff_log_show(world):
    repo, _, first, second = world
    d = api.diff_json(repo, "1", "2")
    assert (d["added"], d["removed"], d["modified"], d["unchanged_count"]) == (["src/login.py"], ["README.md", "src/auth.py"], ["data/numbers.csv"], 8)
    log = repo.log("src/login.py")
    assert [e["path_at"] for e in log["entries"]] == ["src/auth.py", "src/login.py"] and log["also_known_as"] == ["src/auth.py"]
    shown = [r.path for r in repo.show(2).collect()]
    assert "hollow" in shown and "hollow" not in [r.path for r in repo.files([2]).collect()]
    assert shown == sorted(shown, key=lambda p: p.split("/"))


def test_reports_and_routes(world):
    repo, _, _, _ = world
    assert api.route(repo, "/api/status")[1]["integrity_ok"] and api.route(repo, "/api/verify")[1]["result"] == "ok"
    assert [api.route(repo, u)[0] for u in ("/", "/api/snapshots", "/api/explain?id=1", "/api/explain?id=99", "/api/explain", "/nope")] == [200, 200, 200, 400, 400, 404]
    report, issues = repo.recover_check(2)
    assert report["recoverable"] and not issues
    repo.tag("good", 1)
    assert repo.resolve("good") == 1
    with pytest.raises(RepositoryError):
        repo.tag("7", 1)
    with pytest.raises(RepositoryError):
        repo.resolve("nope")


def test_restore(world, tmp_path):
    repo, work, _, _ = world
    put(str(tmp_path), stays_dot_txt="mine")
    assert repo.restore(1, str(tmp_path)) == 11
    assert (tmp_path / "README.md").read_text() == "# Sample\n" and (tmp_path / "stays.txt").read_text() == "mine"
    assert repo.preview(1, str(tmp_path)).where("change <> 'removed'").count() == 0


def test_pack_gc_and_damage(spark, tmp_path):
    work, store = str(tmp_path / "w"), str(tmp_path / "r")
    repo = Repository.init(spark, store)
    lines = [f"line {k} {hashlib.sha256(str(k).encode()).hexdigest()}\n" for k in range(200)]
    for version in range(3):
        lines[100] = f"changed in version {version}\n"
        put(work, a_dot_txt="".join(lines), **{f"v{version}_dot_txt": f"only {version}"})
        if version:
            os.unlink(f"{work}/v{version - 1}.txt")
        repo.snapshot(work, str(version), float(version))
    before = {r.obj_hash: bytes(r.content) for r in repo.contents(repo.stored()).collect()}
    done = repo.pack()
    assert done["delta"] == 1 and done["bytes_saved"] > 0 and repo.objects().count() == 0
    assert {r.obj_hash: bytes(r.content) for r in repo.contents(repo.stored()).collect()} == before
    again = repo.snapshot(work, "after the pack", 9.0)
    assert again["stats"]["new_objects"] == 0
    repo.remove(1)
    reclaimed = repo.gc()
    assert reclaimed["deleted"] >= 2 and repo.gc()["deleted"] == 0
    assert repo.verify().count() == 0 and repo.recover_check(3)[0]["recoverable"]
    only = hashlib.sha256(b"only 2").hexdigest()
    found = repo.trace(only)
    assert found["locations"] == {3: ["v2.txt"], 4: ["v2.txt"]} and not found["would_gc_delete"]
    assert repo.trace("0" * 64) == {"exists": False, "locations": {}, "would_gc_delete": False}
    put(work, late_dot_txt="late")
    repo.snapshot(work, "damaged later", 10.0)
    name = repo._current()["objects"][-1]
    bad = repo._append("objects", repo.objects().selectExpr("obj_hash", "shard", "original_size", "stored_size", "encoding", "cast('??' AS binary) AS content"))
    live = repo._current()
    with open(os.path.join(store, "CURRENT"), "w") as f:
        json.dump({**live, "objects": [bad]}, f)
    assert name and repo.verify().count() >= 1
    assert not repo.recover_check(5)[0]["recoverable"] and repo.recover_check(5)[1]
    with pytest.raises(IntegrityError):
        repo.restore(5, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "late.txt").exists()


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with RepositoryLock(path):
        with pytest.raises(LockTimeout):
            RepositoryLock(path, timeout=0.2).acquire()
    dead = subprocess.run([sys.executable, "-c", "import os; print(os.getpid())"], capture_output=True, text=True).stdout.strip()
    with open(path, "w") as f:
        f.write(dead)
    with RepositoryLock(path, timeout=2):
        assert open(path).read() == str(os.getpid())
    assert not os.path.exists(path)


@pytest.mark.parametrize("text", ["null", "42", "{}", '{"id": 1', '{"id": 1, "timestamp": 1.0, "parent": null, "root_tree_hash": "x", "message": "", "stats": {"files": 1}}'])
def test_bad_records(text):
    with pytest.raises(RepositoryError):
        parse_record(text)


def test_codec_edges():
    for data in (b"", b"a", b"ab" * 4000, os.urandom(3000)):
        stored = codec.encode_object(data)
        assert codec.decode_object(stored, hashlib.sha256(data).hexdigest()) == (data, None)
        assert codec.decode_object(stored, "0" * 64)[1] == "hash mismatch"
    assert codec.decode_object(b"\x02Zxx")[1] == "unsupported version" and codec.decode_object(b"\x01Qxx")[1] == "unknown encoding" and codec.decode_object(b"\x01Zxx")[1] == "bad deflate payload"
    with pytest.raises(ValueError):
        codec.deserialize_ops(b"Xabc")
    with pytest.raises(ValueError):
        list(codec.parse_tree(b"b\x00\x02..." + b"0" * 64))
    with pytest.raises(ValueError):
        codec.parse_pack_index(b"\0" * 1023)
