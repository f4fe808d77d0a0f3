"""SimHash at a stated similarity: wide fingerprints, complete candidate keys, Hamming check, exact shingle Jaccard.

Two texts are linked if and only if the Jaccard similarity of their shingle sets (64-bit hashes) is at least the stated one. No
blocks of a fingerprint find all such pairs: at 0.8 some 155 of 1024 bits differ. So the keys are prefixes of the sets: with
every set in one order (shingles of rare cells first, then by hash), two sets of similarity s share one of the first
``m - ceil(s m) + 1`` of their m shingles, whatever the order is. The cells' counts only keep common shingles out of the prefixes.

Candidates whose sizes allow the similarity pass a check of the Hamming distance of their 1024-bit fingerprints that is
deliberately loose (``LOOSE`` bits: a pair at 0.8 has 192 at most in expectation, and more than 320 with a probability below
1e-19, which is no more than that of equal shingle hashes), and what is left is decided by the sets themselves.

Groups that are known already (the pipeline's come from the 64-bit fingerprints of `simhash`) are taken in: keys of one group and
pairs within one are not looked at. Equal sets are one row. A key that more than ``pairs_to`` rows share first links its rows with its smallest id; rows that are then
in one component need no more comparing. Keys whose rows are in several components are compared in tiles: rows are dealt into
tiles of a bounded size, each pair of tiles is one group, and only pairs from different components are looked at. Rows that have
a partner by the Hamming check get their sets and are decided in memory; a group emits fewer links than it has rows. So a large
group of near copies never becomes a table of pairs, and no task holds more than two tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, drop, mix, words, written
from .components import connected_components

LONGS = 16
BITS = 64 * LONGS
LOOSE = 320 / 155  #: the Hamming check's distance, in units of that of the stated similarity
CELLS, _RANGES = 1 << 16, 16
_LANES = np.uint64(0x0101010101010101)
_SALTS = mix(np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's distinct runs of ``n`` words, by text; fewer words are one run, no word none."""
    every, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    tail, tail_doc = np.zeros(0, np.uint64), -1
    for w in words(column):
        h, doc = w.hashes, w.doc
        if tail_doc == w.docs[0]:
            h, doc = np.concatenate((tail, h)), np.concatenate((np.full(len(tail), tail_doc), doc))
        g = combine(h, n)
        inside = doc[: len(g)] == doc[len(doc) - len(g) :]
        every.append(g[inside])
        of.append(doc[: len(g)][inside])
        if w.last:
            tail, tail_doc = np.zeros(0, np.uint64), -1
            size = np.bincount(doc, minlength=len(column))
            for d in np.flatnonzero((size > 0) & (size < n)).tolist():
                a, b = np.searchsorted(doc, [d, d + 1])
                if not any((x == d).any() for x in of):
                    every.append(combine(h[a:b], b - a) + np.uint64(b - a))
                    of.append(np.array([d]))
        else:
            tail, tail_doc = h[max(0, len(h) - n + 1) :], w.docs[0]
    h, doc = np.concatenate(every), np.concatenate(of)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def fingerprints_of(column: pa.Array, n: int = 5) -> np.ndarray:
    """(texts, LONGS) unsigned longs: a bit is 1 if set in over half of the hashes; zero without a word."""
    return majorities(*shingle_hashes(column, n), len(column))


def majorities(h: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """The fingerprints of texts' distinct hashes, sorted by text."""
    out = np.zeros((texts, LONGS), np.uint64)
    if not len(h):
        return out
    total = np.bincount(doc, minlength=texts)
    start = np.cumsum(total) - total
    cuts = np.concatenate([np.arange(a, a + t, 255) for a, t in zip(start.tolist(), total.tolist()) if t])  # byte lanes hold up to 255
    owner = doc[cuts]
    head = np.flatnonzero(np.diff(owner, prepend=-1))
    some = owner[head]
    for k in range(LONGS):
        x = mix(h ^ _SALTS[k])
        counts = np.empty((len(some), 64), np.int64)
        for s in range(8):
            lanes = np.add.reduceat((x >> np.uint64(s)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
            counts[:, s::8] = np.add.reduceat(lanes.astype(np.int64), head, axis=0)
        bits = counts * 2 > total[some][:, None]
        out[some, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def most_bits(similarity: float) -> int:
    """Hamming distance of two fingerprints at a Jaccard similarity of their shingle sets."""
    return round(BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def prefixes(column: pa.Array, n: int, similarity: float, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of the shingles by which each text can be found, and the texts' numbers of distinct shingles."""
    h, doc = shingle_hashes(column, n)
    order = np.lexsort((h, rank[(h >> np.uint64(48)).astype(np.int64)], doc))
    h, doc = h[order], doc[order]
    size = np.bincount(doc, minlength=len(column))
    first = size - np.ceil(size * similarity - 1e-9).astype(np.int64) + 1
    inside = np.arange(len(h)) - (np.cumsum(size) - size)[doc] < first[doc]
    return h[inside], doc[inside], size


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LONGS)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def partners(group: pa.Table, similarity: float, loose: int, label: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the rows before it of another component whose sizes and fingerprints allow the similarity."""
    m = group["m"].to_numpy()
    label = group["part"].to_numpy() if label is None else label
    p = _prints(group["print"].combine_chunks())
    for i in range(1, len(p)):
        some = np.flatnonzero((label[:i] != label[i]) & (np.minimum(m[:i], m[i]) >= similarity * np.maximum(m[:i], m[i]) - 1e-9))
        yield i, some[_distance(p[some], p[i]) <= loose]


def spanning_links(group: pa.Table, similarity: float, loose: int) -> list[tuple[int, int]]:
    """Pairs of rows, by their sets at ``similarity`` or more, that connect all components which such pairs connect."""
    found = [np.frombuffer(v, np.uint64) for v in group["s"].to_pylist()]
    size = np.array([len(v) for v in found])
    codes = np.unique(np.concatenate(found), return_inverse=True)[1]
    at = np.cumsum(size) - size
    by = np.argsort(codes, kind="stable")
    row = np.repeat(np.arange(len(found)), size)[by]  # rows of each hash
    times = np.bincount(codes)
    first = np.cumsum(times) - times
    label = np.unique(group["part"].to_numpy(), return_inverse=True)[1]
    out = []
    for i, some in partners(group, similarity, loose, label):
        if not len(some):
            continue
        mine = codes[at[i] : at[i] + size[i]]
        n = times[mine]
        shared = np.bincount(row[np.arange(n.sum()) + np.repeat(first[mine] - (np.cumsum(n) - n), n)], minlength=len(found))[some]
        near = some[shared >= similarity * (size[i] + size[some] - shared) - 1e-9]
        for k, j in zip(*np.unique(label[near], return_index=True)):
            out.append((i, int(near[j])))
            label[label == k] = label[i]
    return out


def _ranks(rows: DataFrame) -> np.ndarray:
    """Shingles per cell, from the rows without an id: a fixed number of sums."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_RANGES, dtype=np.int32)), pa.array([v.tobytes() for v in total.reshape(_RANGES, -1)], pa.binary())], names=["r", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in group["v"].to_pylist())
        return pa.table({"r": pa.array([group["r"][0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((_RANGES, CELLS // _RANGES), np.int64)
    for r in rows.where("doc_id IS NULL").select("print").mapInArrow(cut, "r int, v binary").groupBy("r").applyInArrow(add, "r int, v binary").collect():
        out[r.r] = np.frombuffer(r.v, np.int64)
    return out.ravel()


def similar_groups(docs: DataFrame, similarity: float = 0.8, n: int = 5, pairs_to: int = 4, tile: int = 1024, text: str = "text", ident: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): for every row with an id the smallest id that a chain of links reaches.

    ``groups`` (doc_id, component_id) are links that hold already, such as those of `simhash.near_duplicates`: every id with its
    group's smallest one. Chains go through them too, and only pairs of different groups are looked at.

    Null and empty texts have the fingerprint zero and are one group. Rows with a null id are left out. Ids that come with
    several texts join their groups. An empty table gives an empty result; other columns are ignored.
    """
    loose = round(LOOSE * most_bits(similarity))
    source = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["doc_id", "print", "total", "m"]
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                h, doc = shingle_hashes(part.column(1), n)
                cells += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=CELLS)
                total = np.zeros(len(part), np.uint64)
                np.add.at(total, doc, h)
                prints = majorities(h, doc, len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(total.view(np.int64)), pa.array(np.bincount(doc, minlength=len(part)), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([cells.tobytes()], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], names=names)

    rows = written(source.mapInArrow(run, "doc_id long, print binary, total long, m long"), "wide")
    rank = docs.sparkSession.sparkContext.broadcast(_ranks(rows))  # a fixed size
    rows = rows.where("doc_id IS NOT NULL")
    distinct = rows.groupBy("print", "total", "m").agg(F.min("doc_id").alias("id"))
    if groups is None:
        distinct = distinct.withColumn("had", F.col("id"))
    else:
        groups = groups.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("a"), F.col("component_id").cast("long").alias("b"))
        had = groups.groupBy("a").agg(F.min("b").alias("had")).withColumnRenamed("a", "id")  # of an id with several texts any group will do
        distinct = distinct.join(had.hint("shuffle_hash"), "id", "left").withColumn("had", F.coalesce("had", "id"))
    distinct = written(distinct, "wide-distinct")
    same = rows.join(distinct, ["print", "total", "m"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    if groups is not None:
        same = same.unionByName(groups.where("a <> b"))
    prints = distinct.select("id", "m", "print")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                h, doc, size = prefixes(part.column(1), n, similarity, rank.value)
                at = np.cumsum(np.bincount(doc, minlength=len(part)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], at)), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), lists], names=["id", "m", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                h, doc = shingle_hashes(part.column(1), n)
                cut = np.searchsorted(doc, np.arange(len(part) + 1)).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["id", "s"])

    def hamming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _distance(_prints(batch.column(2)), _prints(batch.column(3))) <= loose if len(batch) else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(near))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield batch.select([0, 1]).filter(pa.array([alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity) for p, q in both], pa.bool_()))

    def of(table: DataFrame, value: str, side: str, name: str) -> DataFrame:
        return table.select(F.col("id").alias(side), F.col(value).alias(name))

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose fingerprints and then whose sets are near enough, as a written table."""
        pairs = pairs.distinct().join(of(prints, "print", "a", "p"), "a").join(of(prints, "print", "b", "q"), "b")
        pairs = written(pairs.select("a", "b", "p", "q").mapInArrow(hamming, "a long, b long").distinct(), "wide-pairs")
        needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        held = written(source.join(needed.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(sets, "id long, s binary"), "wide-sets")
        out = pairs.join(of(held, "s", "a", "p"), "a").join(of(held, "s", "b", "q"), "b").select("a", "b", "p", "q").mapInArrow(exact, "a long, b long")
        out = written(out, "wide-links")
        drop(pairs, held)
        return out

    found = source.mapInArrow(keys, "id long, m long, keys array<long>").where("m > 0")
    found = found.join(distinct.groupBy("id").agg(F.min("had").alias("had")).hint("shuffle_hash"), "id")
    keyed = written(found.select("id", "m", "had", F.explode("keys").alias("key")), "wide-prefixes")  # an id with several texts may repeat a key
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("had").alias("low"), F.max("had").alias("high"))
    sizes = sizes.where("low < high").select("key", "size")  # keys of one group have nothing left to link
    whole, keyed = keyed, written(keyed.join(sizes, "key"), "wide-keys")
    drop(whole)
    cold = keyed.where(F.col("size") <= pairs_to).select("id", "m", "had", "key")
    pairs = cold.select("key", F.col("id").alias("a"), F.col("m").alias("x"), F.col("had").alias("u")).join(cold.select("key", F.col("id").alias("b"), F.col("m").alias("y"), F.col("had").alias("v")), "key")
    pairs = pairs.where("a < b AND u <> v").where(F.least("x", "y") >= similarity * F.greatest("x", "y") - 1e-9).select("a", "b")
    crowded = keyed.where(F.col("size") > pairs_to)
    # one leader a key, from four orders of the ids, so that a key's rows do not all depend on one of them
    leader = F.min(F.struct(F.xxhash64("id", F.pmod("key", F.lit(4))).alias("h"), "id", "had"))
    leaders = written(crowded.groupBy("key").agg(leader.alias("s")).select("key", F.col("s.id").alias("leader"), F.col("s.had").alias("led")), "wide-leaders")
    stars = crowded.join(leaders, "key").where("had <> led").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    links = checked(pairs.unionByName(stars))
    drop(leaders)
    parts = written(connected_components(same.unionByName(links)), "wide-parts")

    # crowded keys whose rows are still in several components
    crowded = crowded.select("id", "m", "key", "size").join(parts, F.col("id") == F.col("node"), "left").select("id", "m", "key", "size", F.coalesce("root", "id").alias("part"))
    several = crowded.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")

    def tiled(rows: DataFrame, by: str) -> DataFrame:
        """Rows of each group ``by`` of ``size`` rows, dealt into tiles: a copy for each pair (i, j) of tiles that a row is in."""
        rows = rows.withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
        mine = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
        rows = rows.select("id", "m", by, "part", mine.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
        return rows.select("id", "m", by, "part", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j")).join(prints, ["id", "m"])

    def compare(group: pa.Table) -> pa.Table:
        """The pairs in different components that sizes and fingerprints allow, if they are no more than the rows; else only
        so many of them (``few`` is false) that connect the same rows."""
        ids, pairs, links, count = group["id"].to_numpy(), [], [], 0
        cluster = np.arange(len(group))
        for i, some in partners(group, similarity, loose):
            count += len(some)
            if count <= len(group):
                pairs += [(int(ids[i]), int(ids[j])) for j in some]
            for k, j in zip(*np.unique(cluster[some], return_index=True)):
                if k != cluster[i]:
                    links.append((int(ids[i]), int(ids[some[j]])))
                    cluster[cluster == k] = cluster[i]
        found = pairs if count <= len(group) else links
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64()), "few": pa.array([count <= len(group)] * len(found), pa.bool_())})

    def settle(group: pa.Table) -> pa.Table:
        """Links that connect what the sets of the group's rows connect: fewer than there are rows."""
        ids, found = group["id"].to_numpy(), spanning_links(group, similarity, loose)
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in found], pa.int64()), "b": pa.array([int(ids[y]) for _, y in found], pa.int64())})

    dealt = tiled(crowded.join(several, "key"), "key")
    left = written(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, few boolean").distinct(), "wide-left")
    few = checked(left.where("few").select("a", "b"))
    # many pairs: their rows are grouped once, however many keys they share, and a set is moved once for each pair of tiles
    clusters = written(connected_components(left.where("NOT few").select("a", "b")), "wide-clusters")
    size = clusters.groupBy("root").agg(F.count("*").alias("size"))
    members = clusters.join(size, "root").select(F.col("node").alias("id"), F.col("root").alias("cluster"), "size")
    members = members.join(prints.select("id", "m"), "id").join(parts.select(F.col("node").alias("id"), "root"), "id", "left").select("id", "m", "cluster", "size", F.coalesce("root", "id").alias("part"))
    held = written(source.join(members.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(sets, "id long, s binary"), "wide-sets")
    more = tiled(members, "cluster").join(held, "id").groupBy("cluster", "i", "j").applyInArrow(settle, "a long, b long").unionByName(few)
    parts = connected_components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    out = rows.select("doc_id").distinct().join(parts, F.col("doc_id") == F.col("node"), "left")
    drop(keyed)
    return out.select(F.col("doc_id").alias(ident), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = 0.8, n: int = 5, text: str = "text", ident: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the row with its smallest id; rows with a null id stay.

    Repeated rows with that id are one group too: one of them stays. ``groups``: as in `similar_groups`.
    """
    groups = written(similar_groups(docs, similarity, n, text=text, ident=ident, groups=groups), "groups")
    stay = groups.where(F.col(ident) == F.col("component_id")).select(F.col(ident).alias("_stay"))
    kept = docs.where(F.col(ident).isNotNull()).join(stay.hint("shuffle_hash"), docs[ident] == F.col("_stay"), "left_semi")  # the same plan at every size
    if not docs.groupBy(ident).agg(F.count("*").alias("_n")).where(F.col(ident).isNotNull() & (F.col("_n") > 1)).isEmpty():
        kept = kept.dropDuplicates([ident])
    return kept.unionByName(docs.where(F.col(ident).isNull()))
