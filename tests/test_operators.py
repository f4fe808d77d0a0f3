import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.functions import binary, codec
from treeline.operators import audit, compare, history, packs, trees
from treeline.streaming.ingest import intake


def files(spark, rows):
    return spark.createDataFrame(rows, "snapshot_id long, path string, blob_hash string")


@given(st.binary(max_size=900), st.lists(st.tuples(st.integers(0, 900), st.binary(max_size=30)), max_size=4))
@settings(max_examples=80, deadline=None)
def test_delta_round_trip(base, edits):
    target = base
    for at, new in edits:
        target = target[:at] + new + target[at + 5 :]
    ops = codec.compute_delta(base, target, 16)
    assert b"".join(base[a : a + n] if o == "COPY" else d for o, a, n, d in ops) == target
    assert codec.deserialize_ops(codec.serialize_ops(ops)) == ops


def test_delta_copies_most_of_a_local_edit():
    base = random.Random(1).randbytes(6400)
    target = base[:3000] + b"!!" + base[3000:]
    copied = sum(n for o, _, n, _ in codec.compute_delta(base, target) if o == "COPY")
    assert copied >= 6400 - 128


def test_history_skips_absence(spark):
    f = files(spark, [(1, "a", "x"), (3, "a", "x"), (4, "a", "y"), (6, "a", "x")])
    assert sorted((r.snapshot_id, r.blob_hash) for r in history.path_history(f).collect()) == [(1, "x"), (4, "y"), (6, "x")]


def test_renames_one_to_one_between_live_snapshots(spark):
    f = files(spark, [(1, "a", "x"), (1, "p", "k"), (1, "q", "k"), (5, "b", "x"), (5, "r", "k"), (5, "copy", "z"), (1, "orig", "z"), (5, "orig", "z")])
    assert [(r.old_path, r.new_path, r.snapshot_id) for r in history.renames(f).collect()] == [("a", "b", 5)]


def test_chain_with_loop_and_reuse(spark):
    links = spark.createDataFrame([("a", "b", 2), ("b", "c", 3), ("c", "a", 4)], "old_path string, new_path string, snapshot_id long")
    assert {r.name for r in history.name_chain(spark, links, "b").collect()} == {"a", "b", "c"}


def fold(edges):
    taken = {}
    for _, _, nw, od in sorted(edges):
        if od not in taken:
            taken[nw] = od
    return taken


def test_delta_candidates_equal_the_fold(spark):
    r = random.Random(3)
    rows = [(s, p, f"{p if r.random() < 0.7 else 'z'}{r.randrange(4)}") for s in (1, 2, 4, 7) for p in "abcdefgh" if r.random() < 0.9]
    edges, live = [], [1, 2, 4, 7]
    by = {(s, p): h for s, p, h in rows}
    for a, b in zip(live, live[1:]):
        edges += [(b, p, by[b, p], by[a, p]) for p in "abcdefgh" if (a, p) in by and (b, p) in by and by[a, p] != by[b, p]]
    got = {x.target_hash: x.base_hash for x in history.delta_candidates(files(spark, rows)).collect()}
    assert got == fold(edges)


def test_closure_and_garbage(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "target string, base string")
    start = spark.createDataFrame([(1, "a")], "owner long, object string")
    need = trees.closure(links, start)
    assert {r.object for r in need.collect()} == {"a", "b", "c"}
    objs = spark.createDataFrame([(h,) for h in "abcxy"], "obj_hash string")
    assert {r.obj_hash for r in audit.garbage(objs, need).collect()} == {"x", "y"}


def test_depth_first_order_and_empty_folders(spark):
    f = files(spark, [(1, "a/x", "1" * 64), (1, "a.txt", "2" * 64), (1, "b", "3" * 64)])
    empty = spark.createDataFrame([(1, "a/hollow")], "snapshot_id long, path string")
    entries, roots = trees.build_trees(f, empty)
    walked = trees.walk(entries, roots)
    from pyspark.sql import functions as F

    assert [r.path for r in walked.orderBy(F.split("path", "/")).collect()] == ["a", "a/hollow", "a/x", "a.txt", "b"]
    assert {r.path for r in trees.flatten(walked).collect()} == {"a/x", "a.txt", "b"}


def test_weak_checksum_equals_the_rolling_one(spark):
    from pyspark.sql import functions as F

    blocks = [b"", b"a", bytes(range(256)), b"\xff" * 64]
    df = spark.createDataFrame([(bytearray(b),) for b in blocks], "b binary")
    assert [r.w for r in df.select(binary.weak_checksum(F.col("b")).alias("w")).collect()] == [codec._weak(b) for b in blocks]


def test_pack_layout_bounds_and_tiers(spark):
    e = spark.createDataFrame([("p", f"{k:02x}" + "0" * 62, 10 + k) for k in (3, 1, 200)], "pack_name string, obj_hash string, length long")
    index = packs.pack_offsets(e)
    assert sorted((r.obj_hash[:2], r.offset, r.length) for r in index.collect()) == [("01", 8, 11), ("03", 19, 13), ("c8", 32, 210)]
    raw = bytes(packs.index_bytes(index).first().idx)
    assert [(h[:2], o, n) for h, o, n in codec.parse_pack_index(raw)] == [("01", 8, 11), ("03", 19, 13), ("c8", 32, 210)]
    ok = spark.createDataFrame([("p", 242, "PACK")], "pack_name string, size long, magic string")
    cut = spark.createDataFrame([("p", 241, "PACK")], "pack_name string, size long, magic string")
    assert packs.bounds_problems(index, ok).count() == 0 and packs.bounds_problems(index, cut).first().reason == "entry passes end"
    a, b = (spark.createDataFrame([(x,) for x in s], "obj_hash string") for s in ("xy", "yz"))
    assert {(r.obj_hash, r.tier) for r in packs.tiered([a, b]).collect()} == {("x", 0), ("y", 0), ("z", 1)}


@pytest.mark.parametrize("name,ok", [("a", True), ("", False), (".", False), ("..", False), ("a/b", False), ("a\\b", False), ("a\0", False), ("é" * 32767 + "x", True), ("é" * 32768, False), (None, False)])
def test_entry_names(spark, name, ok):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(binary.is_entry_name(F.col("n")).alias("v")).first().v is ok


def test_summary_of_equal_maps(spark):
    a = files(spark, [(1, "a", "x")])
    assert compare.diff_summary(compare.diff(a, a)).first().is_empty


def test_stream_intake(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",), ("a",)], "content string").coalesce(1).write.parquet(source)
    for _ in range(2):
        q = intake(spark.readStream.schema("content string").parquet(source), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.createDataFrame([("b",), ("c",)], "content string").coalesce(1).write.mode("append").parquet(source)
    assert sorted(bytes(r.content) for r in spark.read.parquet(out).collect()) == [b"a", b"b", b"c"]
