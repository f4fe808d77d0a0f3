"""Path history, renames, lineage, and the choice of delta bases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import written


def path_history(files: DataFrame) -> DataFrame:
    """(path, snapshot_id, blob_hash) where a path's content differs from the last recorded one; absence is no event."""
    before = F.lag("blob_hash").over(Window.partitionBy("path").orderBy("snapshot_id"))
    return files.withColumn("before", before).where("before IS NULL OR before <> blob_hash").select("path", "snapshot_id", "blob_hash")


def adjacent(files: DataFrame) -> DataFrame:
    """(snapshot_id, previous): live snapshots and the live one before, by id (never id - 1)."""
    return files.select("snapshot_id").distinct().withColumn("previous", F.lag("snapshot_id").over(Window.orderBy("snapshot_id")))


def renames(files: DataFrame) -> DataFrame:
    """(old_path, new_path, snapshot_id): a content with one gone and one appeared path between adjacent live snapshots."""
    live = F.broadcast(adjacent(files).where("previous IS NOT NULL"))  # a row per snapshot
    now = files.join(live, "snapshot_id").select("snapshot_id", "path", "blob_hash")
    was = files.withColumnRenamed("snapshot_id", "previous").join(live, "previous").select("snapshot_id", "path", "blob_hash")
    one = lambda df, name: df.groupBy("snapshot_id", "blob_hash").agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")
    gone = one(was.join(now.select("snapshot_id", "path"), ["snapshot_id", "path"], "left_anti"), "old_path")
    come = one(now.join(was.select("snapshot_id", "path"), ["snapshot_id", "path"], "left_anti"), "new_path")
    return gone.join(come, ["snapshot_id", "blob_hash"]).select("old_path", "new_path", "snapshot_id")


def name_chain(spark: SparkSession, links: DataFrame, path: str) -> DataFrame:
    """(name, place): every name in a path's chain of renames, oldest first; the last record of a name wins; loops end it."""
    most = links.count() + 1  # no chain is longer
    later = links.groupBy("old_path").agg(F.max_by("new_path", "snapshot_id").alias("next"))
    earlier = links.groupBy("new_path").agg(F.max_by("old_path", "snapshot_id").alias("prior"))
    own = uuid.uuid4().hex  # two callers in a session keep apart
    later.createOrReplaceTempView(f"later_{own}")
    earlier.createOrReplaceTempView(f"earlier_{own}")
    found = spark.sql(
        f"""
        WITH RECURSIVE back(name, place, seen) MAX RECURSION LEVEL {most} AS (
          SELECT cast(:path AS string), 0, array(cast(:path AS string))
          UNION ALL SELECT e.prior, b.place - 1, array_append(b.seen, e.prior) FROM back b JOIN earlier_{own} e ON e.new_path = b.name WHERE NOT array_contains(b.seen, e.prior)),
        forth(name, place, seen) MAX RECURSION LEVEL {most} AS (
          SELECT cast(:path AS string), 0, array(cast(:path AS string))
          UNION ALL SELECT l.next, f.place + 1, array_append(f.seen, l.next) FROM forth f JOIN later_{own} l ON l.old_path = f.name WHERE NOT array_contains(f.seen, l.next))
        SELECT name, min(place) AS place FROM (SELECT name, place FROM back UNION ALL SELECT name, place FROM forth) GROUP BY name""",
        args={"path": path},
    )
    spark.catalog.dropTempView(f"later_{own}")  # the plan is resolved already
    spark.catalog.dropTempView(f"earlier_{own}")
    return found


def lineage(history: DataFrame, chain: DataFrame) -> DataFrame:
    """(snapshot_id, place, path_at, blob_hash): the history of every name in the chain."""
    return history.join(F.broadcast(chain), history["path"] == chain["name"]).select("snapshot_id", F.col("place").cast("long").alias("place"), F.col("path").alias("path_at"), "blob_hash")


def modified_edges(files: DataFrame) -> DataFrame:
    """(sid, path, nw, od): contents that replaced another at the same path between adjacent live snapshots."""
    live = F.broadcast(adjacent(files).where("previous IS NOT NULL"))
    now = files.join(live, "snapshot_id").select("snapshot_id", "previous", "path", F.col("blob_hash").alias("nw"))
    was = files.select(F.col("snapshot_id").alias("previous"), "path", F.col("blob_hash").alias("od"))
    return now.join(was, ["previous", "path"]).where("nw <> od").select(F.col("snapshot_id").alias("sid"), "path", "nw", "od")


def delta_candidates(files: DataFrame) -> DataFrame:
    """(target_hash, base_hash) by the ordered rule: in (snapshot, path) order an edge is taken if its old content is no target
    at that moment, and the last edge taken of a target gives its base.

    A content stays a target once it is one, so all that a decision needs is when its old content turned into one: the
    first edge taken of it. These times are a fixed point, reached from "every edge is taken" in as many rounds as the
    longest chain of edges that decide each other; the order leaves no second one. Every step is a minimum or a join on
    one row per content, so no group of contents meets in one task. An empty history gives no rows.
    """
    edges = written(modified_edges(files).select("nw", "od", F.struct("sid", "path").alias("at")), "edges")
    pairs = written(edges.groupBy("nw", "od").agg(F.min("at").alias("at")), "pairs")  # if any edge of a pair is taken, the first is
    turned = written(pairs.groupBy("nw").agg(F.min("at").alias("at")), "turned")
    while True:
        after = written(_taken(pairs, turned).groupBy("nw").agg(F.min("at").alias("at")), "turned")
        before = turned.withColumnRenamed("at", "was")
        moved = after.join(before, "nw", "full_outer").where(~F.col("at").eqNullSafe(F.col("was")))
        turned = after
        if moved.isEmpty():
            break
    return _taken(edges, turned).groupBy(F.col("nw").alias("target_hash")).agg(F.max_by("od", "at").alias("base_hash"))


def _taken(edges: DataFrame, turned: DataFrame) -> DataFrame:
    """The edges that come before their old content turns into a target."""
    since = turned.select(F.col("nw").alias("od"), F.col("at").alias("since"))
    return edges.join(since, "od", "left").where("since IS NULL OR at < since").select("nw", "od", "at")
