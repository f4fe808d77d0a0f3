"""Sharding over fixed virtual slots.

Rows are hashed into thousands of slots whose number never changes. A versioned table (version, slot, shard) says
which shard has each slot; rebalancing edits that table, a slot at a time, and never rehashes a row. Only the bytes
and rows of each slot come to the driver: a fixed number of small rows, whatever the corpus holds.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of a slot table: ``shard_of[slot]`` for shards 0 to ``shards`` - 1."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at ``path``; earlier versions stay readable."""
        self.table(spark).coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or else the latest."""
        rows = spark.read.schema("version int, shards int, vslot int, shard int").parquet(path)
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        found = sorted((r.vslot, r.shard, r.shards) for r in rows.where(F.col("version") == version).collect())
        if not found:
            raise LookupError(f"no version {version} in {path}")
        return SlotMap(version, found[0][2], tuple(r[1] for r in found))


def stored_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The latest version at ``path``, if there is one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return SlotMap.load(spark, path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(1, shards, tuple(slot % shards for slot in range(slots)))


def rebalance(now: SlotMap, weight: list[int]) -> SlotMap:
    """The next version (or this one, if no slot moves): slots move until shards' weights are as near equal as whole slots allow.

    Shards above the mean give up slots, smallest loss first; those slots go, heaviest first, to the lightest shard.
    Then single moves and swaps between the heaviest and the lightest shard go on while they lower the spread,
    down to a two-thousandth of the mean.
    """
    total = [0] * now.shards
    own: list[list[int]] = [[] for _ in range(now.shards)]
    for slot, shard in enumerate(now.shard_of):
        total[shard] += weight[slot]
        own[shard].append(slot)
    mean = sum(total) / now.shards
    loose = []
    for shard in range(now.shards):
        for slot in sorted(own[shard], key=lambda s: (-weight[s], s)):
            if total[shard] - weight[slot] >= mean - max(weight) and total[shard] > mean and weight[slot]:
                total[shard] -= weight[slot]
                own[shard].remove(slot)
                loose.append(slot)
    heap = [(t, k) for k, t in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weight[s], s)):
        t, k = heapq.heappop(heap)
        own[k].append(slot)
        total[k] = t + weight[slot]
        heapq.heappush(heap, (total[k], k))
    for _ in range(20 * now.shards):
        high, low = max(range(now.shards), key=lambda k: total[k]), min(range(now.shards), key=lambda k: total[k])
        gap = total[high] - total[low]
        if gap * 2000 <= mean:
            break
        best = min(((abs(gap - 2 * d), a, b) for a in own[high] for b in [None, *own[low]][:400] if 0 < (d := weight[a] - (0 if b is None else weight[b])) < gap), key=lambda x: x[0], default=None)
        if best is None or best[0] >= gap:
            break
        _, a, b = best
        own[high].remove(a)
        own[low].append(a)
        if b is not None:
            own[low].remove(b)
            own[high].append(b)
        d = weight[a] - (0 if b is None else weight[b])
        total[high] -= d
        total[low] += d
    shard_of = list(now.shard_of)
    for shard, slots in enumerate(own):
        for slot in slots:
            shard_of[slot] = shard
    return now if tuple(shard_of) == now.shard_of else replace(now, version=now.version + 1, shard_of=tuple(shard_of))


def grow(now: SlotMap, weight: list[int]) -> SlotMap:
    """The next version, with one more shard, which alone receives slots: an even share taken from the heaviest."""
    shard_of, new = list(now.shard_of), now.shards
    total = [0] * (new + 1)
    own: list[list[int]] = [[] for _ in range(new)]
    for slot, shard in enumerate(shard_of):
        total[shard] += weight[slot]
        own[shard].append(slot)
    for slots in own:
        slots.sort(key=lambda s: (weight[s], s))
    share = sum(total) / (new + 1)
    while total[new] < share:
        high = max(range(new), key=lambda k: total[k])
        fit = [s for s in own[high] if 0 < weight[s] <= share - total[new]]
        if not fit:
            break
        own[high].remove(fit[-1])
        shard_of[fit[-1]] = new
        total[high] -= weight[fit[-1]]
        total[new] += weight[fit[-1]]
    return SlotMap(now.version + 1, new + 1, tuple(shard_of))


def measured(docs: DataFrame, text: str = "text", ident: str = "doc_id", slots: int = SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null: 1), text_crc32, vslot, and the columns of ``keep``."""
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    by = F.when(F.col(ident).isNotNull(), F.xxhash64(F.col(ident).cast("string"), F.lit("id"))).otherwise(F.xxhash64(F.crc32(raw)))
    return docs.select(F.col(ident).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.pmod(by, F.lit(slots)).cast("int").alias("vslot"), *keep)


def slot_weights(rows: DataFrame) -> DataFrame:
    """vslot, bytes, n: one row per slot that has rows."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def assign(docs: DataFrame, shards: int = 16, slots: int = SLOTS, text: str = "text", ident: str = "doc_id", map_path: str | None = None) -> DataFrame:
    """Every row with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    The law is ``bytes``: shards' sizes are near equal. ``slot`` counts the rows of a shard from 0 without a gap: slots of
    the map follow each other, and rows of a slot by id (nulls first; equal rows in any order). The map's versions are stored
    at ``map_path`` (where none is named, in a new place of the shared folder). A map that is there already is taken up: its latest
    version gets new shards if it has too few, is rebalanced, and is stored as a further version if a slot moved; else version 1
    deals slots in turn. Null texts have size 1; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = written(measured(docs, text, ident, slots), "measured")
    stats = slot_weights(rows).collect()  # at most `slots` rows
    weight, count = [0] * slots, [0] * slots
    for r in stats:
        weight[r.vslot], count[r.vslot] = r.bytes, r.n
    map_path = map_path or f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}"
    now = stored_map(spark, map_path)
    if now is None:
        now = first_map(shards, slots)
        now.store(spark, map_path)
    if now.shards > shards or len(now.shard_of) != slots:
        raise ValueError(f"the map at {map_path} has {now.shards} shards and {len(now.shard_of)} slots")
    before = now.version
    while now.shards < shards:
        now = grow(now, weight)
    now = rebalance(now, weight)
    if now.version != before:
        now.store(spark, map_path)
    now = SlotMap.load(spark, map_path)
    before, at = [0] * slots, [0] * shards
    for slot, shard in enumerate(now.shard_of):
        before[slot] = at[shard]
        at[shard] += count[slot]
    places = spark.createDataFrame([(s, now.shard_of[s], before[s]) for s in range(slots)], "vslot int, shard int, before long")
    in_order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("r", F.row_number().over(in_order))
        .join(F.broadcast(places), "vslot")  # `slots` rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(now.version).alias("map_version"))
    )
