"""Packs: layout, index, bounds, point lookups, and full-or-delta entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import big_endian, is_hash
from ..functions.codec import delta_entry, encoded

HEADER = 8  # magic and version: a fixed value of the format


def shard(obj_hash="obj_hash") -> F.Column:
    return F.conv(F.substring(F.col(obj_hash) if isinstance(obj_hash, str) else obj_hash, 1, 2), 16, 10).cast("int")


def pack_offsets(entries: DataFrame) -> DataFrame:
    """(pack_name, obj_hash, offset, length) of entries (pack_name, obj_hash, length) laid out by hash after the header.

    The running sum is split at the first byte of the hash: sums within a shard run in parallel, and 256 shard totals are
    summed once per pack, so no task orders a whole pack.
    """
    e = entries.withColumn("shard", shard())
    within = F.sum("length").over(Window.partitionBy("pack_name", "shard").orderBy("obj_hash").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("total").over(Window.partitionBy("pack_name").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals = e.groupBy("pack_name", "shard").agg(F.sum("length").alias("total")).select("pack_name", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    return e.withColumn("within", F.coalesce(within, F.lit(0))).join(totals, ["pack_name", "shard"]).select("pack_name", "obj_hash", (F.col("before") + F.col("within") + HEADER).cast("long").alias("offset"), F.col("length").cast("long").alias("length"))


def fanout(index: DataFrame) -> DataFrame:
    """(bucket, cumulative): for each first byte, how many hashes of the index are up to it; 256 rows."""
    counts = index.groupBy(shard().alias("bucket")).agg(F.count("*").alias("n"))
    every = index.sparkSession.range(256).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bucket"))
    return every.select(F.col("bucket").cast("long").alias("bucket"), running.cast("long").alias("cumulative"))


def index_bytes(index: DataFrame) -> DataFrame:
    """(pack_name, idx): the binary index: fan-out of 256 u32, then hash, offset u64 and length u32 by hash."""
    entry = F.concat(F.col("obj_hash"), big_endian(F.col("offset"), 8), big_endian(F.col("length"), 4))
    rows = index.groupBy("pack_name").agg(F.array_sort(F.collect_list(F.struct("obj_hash", entry.alias("hex")))).alias("e"))
    counts = index.groupBy("pack_name", shard().alias("b")).agg(F.count("*").cast("int").alias("n")).groupBy("pack_name").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("per"))
    running = F.aggregate(F.sequence(F.lit(0), F.lit(255)), F.array().cast("array<int>"), lambda acc, b: F.array_append(acc, F.coalesce(F.get(acc, b - 1), F.lit(0)) + F.coalesce(F.try_element_at("per", b), F.lit(0))))
    fan = F.transform(running, lambda n: big_endian(n, 4))
    return rows.join(counts, "pack_name").select("pack_name", F.unhex(F.concat(F.array_join(fan, ""), F.array_join(F.transform("e", lambda x: x["hex"]), ""))).alias("idx"))


def bounds_problems(index: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, reason): the first failing entry by hash, or a wrong magic; packs have pack_name, size, magic."""
    checked = packs.join(index, "pack_name", "left")
    reason = F.when(F.col("magic") != "PACK", "bad magic").when(F.col("offset") < HEADER, "offset inside header").when(F.col("length") < 0, "negative length").when(F.col("offset") + F.col("length") > F.col("size"), "entry passes end")
    return checked.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("pack_name").agg(F.min_by("reason", "obj_hash").alias("reason"))


def damaged_packs(entries: DataFrame) -> DataFrame:
    """(pack_name, reason): packs with an entry that cannot be right, the first by hash: its name, place or length."""
    reason = F.when(~is_hash(F.col("obj_hash")), "malformed hash").when(F.col("offset") < HEADER, "offset inside header").when(F.col("length") < 0, "negative length").when(F.coalesce(F.octet_length("entry"), F.lit(-1)) != F.col("length"), "entry of another length")
    return entries.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("pack_name").agg(F.min_by("reason", "obj_hash").alias("reason"))


def locate(index: DataFrame) -> DataFrame:
    """One place per object: the pack with the latest name wins."""
    return index.groupBy("obj_hash").agg(F.max(F.struct("pack_name", "offset", "length")).alias("p")).select("obj_hash", "p.*")


def tiered(tiers: list[DataFrame]) -> DataFrame:
    """(obj_hash, tier): the first tier that has an object."""
    rows = None
    for k, t in enumerate(tiers):
        part = t.select("obj_hash", F.lit(k).alias("tier"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("obj_hash").agg(F.min("tier").alias("tier"))


def choose_entries(objects: DataFrame, candidates: DataFrame) -> DataFrame:
    """(obj_hash, kind, base_hash, entry, full_length, delta_length): 'D' only where its entry is shorter than the full one."""
    base = objects.select(F.col("obj_hash").alias("base_hash"), F.col("content").alias("base"))
    rows = objects.select("obj_hash", "content").join(candidates.withColumnRenamed("target_hash", "obj_hash"), "obj_hash", "left").join(base, "base_hash", "left")
    full = F.concat(F.lit(b"F"), encoded(F.col("content")))
    rows = rows.select("obj_hash", "base_hash", full.alias("full"), delta_entry(F.col("base_hash"), F.col("base"), F.col("content")).alias("delta"))
    smaller = F.coalesce(F.octet_length("delta") < F.octet_length("full"), F.lit(False))
    return rows.select("obj_hash", F.when(smaller, "D").otherwise("F").alias("kind"), F.when(smaller, F.col("base_hash")).alias("base_hash"), F.when(smaller, F.col("delta")).otherwise(F.col("full")).alias("entry"), F.octet_length("full").cast("long").alias("full_length"), F.octet_length("delta").cast("long").alias("delta_length"))


def savings(chosen: DataFrame) -> DataFrame:
    """One row: pairs that a delta improves, their bytes in full and as deltas, and the share saved."""
    better = chosen.where("kind = 'D'")
    return better.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("full_length"), F.lit(0)).alias("full_bytes"), F.coalesce(F.sum("delta_length"), F.lit(0)).alias("delta_bytes")).withColumn("saved_pct", F.round(F.coalesce(F.try_divide(100.0 * (F.col("full_bytes") - F.col("delta_bytes")), F.col("full_bytes")), F.lit(0.0)), 4))
