"""Scalar functions on hashes, sizes and bytes, as column expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a scan skips at any depth (fixed values).
IGNORED = (".vault", ".git", "__pycache__", ".venv", "node_modules")
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def content_hash(data: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes or of binary."""
    return F.sha2(data, 256)


def is_hash(value: Column) -> Column:
    """Whether a string is 64 lower-case hex digits (null: no)."""
    return F.coalesce(value.rlike("\\A[0-9a-f]{64}\\z"), F.lit(False))


def is_entry_name(name: Column) -> Column:
    """Whether a string may name a tree entry: not empty, no '/', backslash or NUL, not '.' or '..', at most 65535 bytes."""
    return F.coalesce((name != "") & ~name.rlike(r"[/\\\x00]") & ~name.isin(".", "..") & (F.octet_length(name) <= 65535), F.lit(False))


def is_ignored(path: Column) -> Column:
    """Whether any part of a path is on the ignore list."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))


def human_bytes(n: Column) -> Column:
    """12 B, 1.5 KB, 3.2 MB, 1024.0 GB: one decimal (halves to even) from KB on, GB the largest unit."""
    scaled = lambda k: F.format_string("%.1f", F.bround(n / float(1024**k), 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(scaled(1), F.lit(" KB"))).when(n < 1024**3, F.concat(scaled(2), F.lit(" MB"))).otherwise(F.concat(scaled(3), F.lit(" GB")))


def big_endian(n: Column, width: int) -> Column:
    """Hex digits of an unsigned integer of ``width`` bytes."""
    return F.lpad(F.hex(n.cast("long")), 2 * width, "0")


def weak_checksum(block: Column) -> Column:
    """The rolling checksum of a block: low half the byte sum, high half the sum of running weights, both modulo 65536."""
    n = F.octet_length(block)
    byte = lambda i: F.conv(F.hex(F.substring(block, i, F.lit(1))), 16, 10).cast("long")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    low = F.aggregate(at, F.lit(0).cast("long"), lambda s, i: s + byte(i))
    high = F.aggregate(at, F.lit(0).cast("long"), lambda s, i: s + (n - i + 1).cast("long") * byte(i))
    return (high % 65536) * 65536 + low % 65536


def strong_checksum(block: Column) -> Column:
    """The first eight bytes of SHA-256, in hex."""
    return F.substring(F.sha2(block, 256), 1, 16)


def apply_delta(base: Column, ops: Column) -> Column:
    """Rebuilds a target from its base and (op, base_offset, length, data) steps."""
    piece = lambda o: F.hex(F.when(o["op"] == "COPY", F.substring(base, (o["base_offset"] + 1).cast("int"), o["length"].cast("int"))).otherwise(o["data"]))
    return F.unhex(F.array_join(F.transform(ops, piece), ""))  # joined once: linear in the output
