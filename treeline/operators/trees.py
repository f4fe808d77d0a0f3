"""Trees: Merkle hashes bottom-up, and top-down walks and closures by frontier loops over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import EMPTY_HASH, big_endian
from .storage import written


def hashed_tree(entries) -> F.Column:
    """The hash of a tree from its sorted array of entries (name, kind, child_hash)."""
    entry = lambda e: F.concat(F.when(e["kind"] == "blob", F.lit("62")).otherwise(F.lit("74")), big_endian(F.octet_length(e["name"]), 2), F.hex(e["name"]), F.hex(e["child_hash"]))
    return F.sha2(F.unhex(F.array_join(F.transform(entries, entry), "")), 256)


def tree_levels(files: DataFrame, empty_dirs: DataFrame | None = None, most: int = 1000) -> list[DataFrame]:
    """One written table per depth, deepest first: (snapshot_id, dir, entries, tree_hash), a row per directory.

    The entries of a depth are grouped by directory and hashed into a tree entry one level up, so each level is computed
    once. ``empty_dirs`` (snapshot_id, path) enter as trees without entries.
    """
    parts = F.split("path", "/")
    rows = files.select("snapshot_id", parts.alias("parts"), F.lit("blob").alias("kind"), F.col("blob_hash").alias("child_hash"))
    if empty_dirs is not None:
        rows = rows.unionByName(empty_dirs.select("snapshot_id", parts.alias("parts"), F.lit("tree").alias("kind"), F.lit(EMPTY_HASH).alias("child_hash")))
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 1
    if deepest > most:
        raise RecursionError(f"{deepest} levels of directories; at most {most}")
    levels, above = [], None
    for depth in range(deepest, 0, -1):
        here = rows.where(F.size("parts") == depth).select("snapshot_id", F.array_join(F.slice("parts", 1, depth - 1), "/").alias("dir"), F.element_at("parts", depth).alias("name"), "kind", "child_hash")
        if above is not None:
            here = here.unionByName(above)
        grouped = here.groupBy("snapshot_id", "dir").agg(F.array_sort(F.collect_set(F.struct("name", "kind", "child_hash"))).alias("entries"))
        level = written(grouped.withColumn("tree_hash", hashed_tree(F.col("entries"))), "level")
        levels.append(level)
        up = F.split("dir", "/")
        where = F.array_join(F.slice(up, 1, depth - 2), "/") if depth > 2 else F.lit("")
        above = level.select("snapshot_id", where.alias("dir"), F.element_at(up, -1).alias("name"), F.lit("tree").alias("kind"), F.col("tree_hash").alias("child_hash"))
    return levels


def tree_roots(levels: list[DataFrame]) -> DataFrame:
    return levels[-1].select("snapshot_id", F.col("tree_hash").alias("root_tree_hash"))


def build_trees(files: DataFrame, empty_dirs: DataFrame | None = None, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(tree_entries with snapshot_id and dir, roots) from files (snapshot_id, path, blob_hash)."""
    levels = tree_levels(files, empty_dirs, most)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    entries = every.select("snapshot_id", "dir", "tree_hash", F.explode("entries").alias("e")).select("snapshot_id", "dir", "e.name", "e.kind", "e.child_hash", "tree_hash")
    return entries, tree_roots(levels)


def walk(entries: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """(snapshot_id, path, kind, object, depth) of everything below the roots, a written table per level for all snapshots.

    A tree that has no rows ends its branch; `lost_trees` tells which. A malformed table with a cycle ends at ``most`` levels.
    """
    spark = roots.sparkSession
    known = entries.select("tree_hash", "name", "kind", "child_hash").distinct()
    level = roots.select("snapshot_id", F.lit(None).cast("string").alias("path"), F.col("root_tree_hash").alias("object"))
    out = None
    for depth in range(1, most + 1):
        here = level.join(known, F.col("object") == F.col("tree_hash")).select("snapshot_id", F.concat_ws("/", "path", "name").alias("path"), "kind", F.col("child_hash").alias("object"), F.lit(depth).alias("depth"))
        here = written(here, "walk")
        out = here if out is None else out.unionByName(here)
        level = here.where("kind = 'tree'").select("snapshot_id", "path", "object")
        if level.isEmpty():
            return out
    raise RecursionError(f"over {most} levels of directories in {spark.sparkContext.appName}")


def lost_trees(entries: DataFrame, walked: DataFrame, roots: DataFrame) -> DataFrame:
    """(snapshot_id, path, object): trees that are referred to and have no rows ('.' for a root); the empty tree needs none."""
    asked = walked.where("kind = 'tree'").select("snapshot_id", "path", "object").unionByName(roots.select("snapshot_id", F.lit(".").alias("path"), F.col("root_tree_hash").alias("object")))
    return asked.where(F.col("object") != EMPTY_HASH).join(entries.select(F.col("tree_hash").alias("object")).distinct(), "object", "left_anti").select("snapshot_id", "path", "object")


def flatten(walked: DataFrame) -> DataFrame:
    """Files only: empty directories vanish."""
    return walked.where("kind = 'blob'").select("snapshot_id", "path", F.col("object").alias("blob_hash"))


def reachable(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(snapshot_id, object): blobs, trees and the root of every snapshot. Each tree is expanded once per snapshot, however
    many places it has."""
    links = entries.select(F.col("tree_hash").alias("target"), F.col("child_hash").alias("base")).distinct()
    start = roots.select(F.col("snapshot_id").alias("owner"), F.col("root_tree_hash").alias("object"))
    return closure(links, start).withColumnRenamed("owner", "snapshot_id")


def closure(links: DataFrame, start: DataFrame, most: int = 1000) -> DataFrame:
    """(owner, object): what each start row reaches over (target, base) links, itself included.

    A frontier loop: each round joins only what the last one found new, so a long chain costs its length and a wide one
    its width; cycles end it.
    """
    seen = written(start.select("owner", "object").distinct(), "closure")
    frontier = seen
    for _ in range(most):
        step = frontier.join(links, frontier["object"] == links["target"]).select("owner", F.col("base").alias("object")).distinct()
        frontier = written(step.join(seen, ["owner", "object"], "left_anti"), "closure")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RecursionError(f"no fixed point in {most} rounds")
