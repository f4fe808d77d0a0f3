"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then a check of the Hamming distance.

A fingerprint of 64 bits is cut into ``distance + 3`` blocks. Two fingerprints that differ in at most ``distance`` bits
agree in at least three blocks, so for every choice of three blocks the rows are joined on those bits (about
``64 * 3 / (distance + 3)`` of them, which keeps chance partners rare as the corpus grows) and candidates are kept if
the distance holds. Only distinct fingerprints take part, so any number of equal texts is one row.

A group of near copies can fill one block key with many distinct fingerprints. Keys of more than ``pairs_to`` members
are not paired: each member emits the *midpoints* it reaches by flipping up to one bit outside the key. Two members at
distance 2 or less share a midpoint and members that share one are at distance 2 or less, so links to the smallest
member of each midpoint join exactly the same components, from rows that grow linearly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written
from .components import connected_components

_LANES = np.uint64(0x0101010101010101)
_CHUNK = 1 << 16


def _shingle_hashes(text: bytes, n: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``n`` space-joined words, in pieces; fewer words make one run, no word none."""
    found = text.lower().split()  # bytes: only A-Z change, only 0x20 and 0x09-0x0D split
    if not found:
        return
    if len(found) < n:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(found) - n + 1, _CHUNK):
        part = found[k : k + _CHUNK + n - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        begins = np.concatenate(([0], ends[: len(part) - n] + 1)).tolist()
        yield np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[n - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without a word."""
    counts, total = np.zeros(64, np.int64), 0
    for h in _shingle_hashes(text, n, seed):
        total += len(h)
        for k in range(0, len(h), 255):  # byte lanes hold up to 255
            part = h[k : k + 255]
            lanes = [int(((part >> np.uint64(s)) & _LANES).sum()) for s in range(8)]
            counts += np.array(lanes, np.uint64).view(np.uint8).reshape(8, 8).T.ravel()
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (a long: the fingerprint's 64 bits) for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", n, seed) for t in texts]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fp], names=[*keep, "fp"])

    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, fp bigint")


def _blocks(distance: int) -> list[int]:
    """Masks of every choice of three of ``distance + 3`` blocks, as signed longs."""
    count = distance + 3
    cuts = [64 * k // count for k in range(count + 1)]
    single = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(count)]
    masks = [a | b | c for a, b, c in combinations(single, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, distance: int = 2, pairs_to: int = 64) -> DataFrame:
    """(a, b) of long fingerprints, a < b, at ``distance`` or fewer bits, from a table of distinct ``fp``.

    Every such pair is there, except that a crowded block key gives links that connect the same members instead.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    masks = _blocks(distance)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).cast("tinyint").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("e")).select("fp", "e.k", "e.key")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["k", "key"])
    cold = keyed.where(F.col("n") <= pairs_to).drop("n")
    close = lambda: F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = (
        cold.withColumnRenamed("fp", "a")
        .join(cold.withColumnRenamed("fp", "b"), ["k", "key"])
        .where(F.col("a") < F.col("b"))
        .where(close() <= distance)
        .select("a", "b")
    )
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    masked = F.array(*[F.lit(m) for m in masks])
    hot = keyed.where(F.col("n") > pairs_to).select("k", "fp", F.element_at(masked, F.col("k").cast("int") + 1).alias("mask"))
    if distance == 2:  # members that reach one midpoint by at most a flip each
        reach = [F.struct(F.lit(-1).alias("i"), F.col("fp").alias("mid"))]
        reach += [F.when(F.col("mask").bitwiseAND(F.lit(b)) == 0, F.struct(F.lit(-1).alias("i"), F.col("fp").bitwiseXOR(F.lit(b)).alias("mid"))) for b in bits]
    else:  # members that are equal once bit i is cleared
        reach = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(~b)).alias("mid")) for i, b in enumerate(bits)][: 64 * distance]
    if not reach:
        return pairs.distinct()
    midpoints = hot.select("k", "fp", F.explode(F.array_compact(F.array(*reach))).alias("e")).select("k", "fp", "e.i", "e.mid")
    first = midpoints.groupBy("k", "i", "mid").agg(F.min("fp").alias("a"))
    stars = midpoints.join(first, ["k", "i", "mid"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, n: int = 3, seed: int = 42, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per input row: ``ident``, ``fingerprint`` (16 hex digits), ``component_id`` and ``n_rows``.

    ``component_id`` is the smallest id that a chain of links reaches; fingerprints at ``distance`` or fewer bits are
    linked, equal ones always. Null or empty texts have fingerprint zero and link like any other. A null id stays null
    and is passed over as the smallest unless nothing else is there. Repeated rows are kept as they are. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = written(fingerprints(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")), n, seed), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = written(links(distinct.select("fp"), distance), "links")
    parts = connected_components(found)
    drop(found)
    of = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    whole = of.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_rows"))
    named = of.select("fp", "root").join(whole, "root").select("fp", "component_id", "n_rows")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(named, "fp").select(F.col("doc_id").alias(ident), digits, "component_id", "n_rows")

