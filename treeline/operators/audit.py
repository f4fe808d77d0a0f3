"""Verification, recoverability, garbage collection and tracing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import is_hash


def verify(objects: DataFrame) -> DataFrame:
    """Objects (obj_hash, content) whose content does not hash to their name: every one, not the first."""
    return objects.select("obj_hash", F.sha2("content", 256).alias("actual")).where(F.col("actual").isNull() | (F.col("actual") != F.col("obj_hash")))


def garbage(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    """Objects that nothing live reaches."""
    return objects.join(reachable.select(F.col("object").alias("obj_hash")).distinct(), "obj_hash", "left_anti")


def trace(walked: DataFrame, roots: DataFrame, obj_hash: str) -> DataFrame:
    """(snapshot_id, paths): where an object is; '.' for a snapshot's own root. A place counts once."""
    here = walked.where(F.col("object") == obj_hash).select("snapshot_id", "path")
    top = roots.where(F.col("root_tree_hash") == obj_hash).select("snapshot_id", F.lit(".").alias("path"))
    return here.unionByName(top).groupBy("snapshot_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def recover_issues(references: DataFrame, objects: DataFrame, manifest: DataFrame, quarantined: DataFrame) -> DataFrame:
    """(where, object, detail): every issue of the references (path, object) of a snapshot.

    A malformed hash, a missing object (with the pack it is stranded in, the first by name), wrong content, and a delta base
    that is missing. A place is the first in depth-first order. ``objects`` has obj_hash and ok; ``manifest`` target and base; ``quarantined`` pack_name and obj_hash.
    """
    first = references.groupBy("object").agg(F.min_by("path", F.split("path", "/")).alias("where"))  # the first in depth-first order
    stranded = quarantined.groupBy(F.col("obj_hash").alias("object")).agg(F.min("pack_name").alias("pack"))
    checked = first.join(objects.select(F.col("obj_hash").alias("object"), "ok"), "object", "left").join(stranded, "object", "left")
    detail = (
        F.when(~is_hash(F.col("object")), F.lit("malformed hash"))
        .when(F.col("ok").isNull() & F.col("pack").isNotNull(), F.concat(F.lit("stranded in "), F.col("pack")))
        .when(F.col("ok").isNull(), F.lit("missing"))
        .when(~F.col("ok"), F.lit("corrupted"))
    )
    direct = checked.select("where", "object", detail.alias("detail")).where("detail IS NOT NULL")
    bases = first.join(manifest, F.col("object") == F.col("target")).select("where", F.col("base").alias("object"))
    lost = bases.join(objects.select(F.col("obj_hash").alias("object")), "object", "left_anti").select("where", "object", F.lit("missing delta base").alias("detail"))
    return direct.unionByName(lost)


def recover_report(references: DataFrame, issues: DataFrame, packed: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: objects_checked, packed_objects, delta_dependencies, issues, recoverable."""
    nodes = references.select(F.col("object").alias("obj_hash")).distinct()
    a = nodes.agg(F.count("*").alias("objects_checked"))
    b = nodes.join(packed.select("obj_hash").distinct(), "obj_hash", "left_semi").agg(F.count("*").alias("packed_objects"))
    c = nodes.join(manifest, nodes["obj_hash"] == manifest["target"]).agg(F.countDistinct("target").alias("delta_dependencies"))
    d = issues.agg(F.count("*").alias("issues")).select("issues", (F.col("issues") == 0).alias("recoverable"))
    return a.join(b).join(c).join(d)  # four single rows
