"""Diffs, deduplication and reports over files (snapshot_id, path, blob_hash[, size])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_hash, new_hash) of two flat maps (path, blob_hash): added, removed, modified or unchanged.

    Compares hashes only; a full outer join on the path.
    """
    a, b = old.select("path", F.col("blob_hash").alias("old_hash")), new.select("path", F.col("blob_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"), "old_hash", "new_hash")


def diff_summary(changes: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("change") == kind)
    return changes.agg(n("added").alias("added"), n("modified").alias("modified"), n("removed").alias("removed"), n("unchanged").alias("unchanged"), (F.count_if(F.col("change") != "unchanged") == 0).alias("is_empty"))


def restore_preview(disk: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Added: in the snapshot, not on disk. Removed: on disk only (a restore leaves those)."""
    return diff(disk, snapshot).where("change <> 'unchanged'")


def snapshot_stats(files: DataFrame) -> DataFrame:
    """Per snapshot: files, new_objects, reused_objects, original_bytes, new_bytes. New and reused add up to the files.

    The first occurrence comes from a minimum per content, which combines before the shuffle, so that content that a third of
    all files have is no hot key.
    """
    order = F.struct("snapshot_id", F.split("path", "/").alias("p"))
    first = files.groupBy("blob_hash").agg(F.min(order).alias("f"), F.first("size").alias("size")).groupBy(F.col("f.snapshot_id").alias("snapshot_id")).agg(F.count("*").alias("new_objects"), F.sum("size").alias("new_bytes"))
    totals = files.groupBy("snapshot_id").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("original_bytes"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return totals.join(first, "snapshot_id", "left").select("snapshot_id", "files", none("new_objects").alias("new_objects"), (F.col("files") - none("new_objects")).alias("reused_objects"), "original_bytes", none("new_bytes").alias("new_bytes"))


def explain(stats: DataFrame) -> DataFrame:
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 4)
    saved = F.greatest(F.lit(0), F.col("original_bytes") - F.col("new_bytes"))
    return stats.select("snapshot_id", "files", "new_objects", "reused_objects", pct(F.col("reused_objects"), F.col("files")).alias("dedup_ratio_pct"), "original_bytes", F.col("new_bytes").alias("stored_bytes"), saved.alias("storage_saved_bytes"), pct(saved, F.col("original_bytes")).alias("storage_saved_pct"))


def objects(files: DataFrame) -> DataFrame:
    """(obj_hash, size, n_files): each content once."""
    return files.groupBy(F.col("blob_hash").alias("obj_hash")).agg(F.max("size").alias("size"), F.count("*").alias("n_files"))


def new_objects(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """What a store lacks: each content once, anti-joined before any encoding."""
    return candidates.dropDuplicates(["obj_hash"]).join(stored.select("obj_hash"), "obj_hash", "left_anti")


def dedup_groups(files: DataFrame) -> DataFrame:
    """Contents with more than one name: (obj_hash, n_files, names)."""
    names = F.sort_array(F.collect_set("path"))
    return files.groupBy(F.col("blob_hash").alias("obj_hash")).agg(F.count("*").alias("n_files"), names.alias("names")).where(F.size("names") > 1)


def status(files: DataFrame, snapshots: DataFrame, corrupted: DataFrame) -> DataFrame:
    """One row: counts, bytes before and after deduplication, the last snapshot, and whether every object verifies."""
    a = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_snapshot_data_bytes"))
    b = objects(files).agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("stored_on_disk_bytes"))
    c = snapshots.agg(F.count("*").alias("snapshots"), F.max_by("id", F.struct("timestamp", -F.col("id"))).cast("long").alias("last_snapshot"))
    d = corrupted.agg(F.count("*").alias("corrupted_count")).select("corrupted_count", (F.col("corrupted_count") == 0).alias("integrity_ok"))
    return a.join(b).join(c).join(d)  # four single rows


def nearest_size_base(versions: DataFrame, window: int = 10) -> DataFrame:
    """(obj_hash, base_hash, distance): among the ``window`` objects just before, the nearest in size; the earliest on ties.

    ``seq`` is dense, so the window is an equi-join on seq plus 1 to ``window``: no theta join and no global sort.
    """
    x = versions.select("obj_hash", "size", F.explode(F.sequence(F.col("seq") - window, F.col("seq") - 1)).alias("seq"))
    y = versions.select("seq", F.col("obj_hash").alias("base_hash"), F.col("size").alias("base_size"))
    best = F.min(F.struct(F.abs(F.col("base_size") - F.col("size")).alias("distance"), F.col("seq"), F.col("base_hash"))).alias("b")
    return x.join(y, "seq").groupBy("obj_hash").agg(best).select("obj_hash", "b.base_hash", "b.distance")


def false_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (obj_hash, base_hash) whose contents never had a common name, from (obj_hash, names)."""
    a = names.select("obj_hash", F.col("names").alias("mine"))
    b = names.select(F.col("obj_hash").alias("base_hash"), F.col("names").alias("theirs"))
    return pairs.join(a, "obj_hash").join(b, "base_hash").select("obj_hash", "base_hash", F.arrays_overlap("mine", "theirs").alias("same_file"))
