"""Removal of repeated byte strings by a sparse suffix array, merge-sorted across the cluster.

A byte goes if a string of ``W`` bytes that covers it starts at two places of the corpus. Sorting every suffix would
move each byte hundreds of times, so suffixes are sorted only where a repeat can be anchored:

1. Every window of W bytes picks an *anchor* in it: the place of its least K-byte hash, leftmost on ties. Equal windows pick
   the same place, so a repeated window's anchor is a K-byte string that occurs twice. Anchors whose hash is unique go.
2. The remaining anchors' suffixes (W bytes to the right, and W - K to the left as context) are sorted in runs, each run is
   cut at common splitters and front-coded (each suffix as its common prefix with the last one, and the rest), and only
   that crosses the network.
3. A task merges its runs with a loser tree of longest common prefixes: two heads that share different prefixes with the
   last winner are ordered by those lengths alone, and equal ones are compared beyond the known prefix only.
4. In sorted order, suffixes that share a prefix are neighbours; the reversed left contexts of a group are sorted likewise. A
   window at offset o before its anchor is repeated if another context has both the same o bytes on the left and the same
   W - o on the right: both classes are running counts over the two common-prefix arrays. No pairs are formed.

Equal texts are one text with a count; equal contexts are one context with a weight. The same order also tells which bytes are covered
by shorter repeats (``PASSAGE`` bytes: a copied passage of some 50 words); anchors are chosen in windows of that size, so a window of
W bytes has one too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, _BYTE, _powers, drop, mix, text_buffers, written

W, K = 400, 80
PASSAGE = 256  #: bytes of a shorter repeat that is reported, and not removed: some 50 words
RUN_BYTES, PART_BYTES = 10 << 20, 8 << 20
_LOW = np.uint64((1 << 22) - 1)


# ---------------------------------------------------------------- anchors


def anchors(column: pa.Array, w: int = W, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place in the text, hash) of the anchors of all windows, each once, in order."""
    data, at = text_buffers(column)
    size, span = np.diff(at), w - k + 1
    i = 0
    while i < len(size):
        if size[i] < w:
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        last = -1
        for a in range(int(at[i]), int(at[j]), PIECE):  # one step but for a very long text
            b = min(int(at[j]), a + PIECE + w - 1)
            if b - a < w:
                break
            raw = data[a:b]
            power, inverse = _powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
            n = len(raw) - k + 1
            h = mix((total[k:] - total[:-k]) * inverse[:n])
            key = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
            pad = -n % span
            rows = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, span)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            starts = n - span + 1
            least = np.minimum(back[:starts], ahead[span - 1 : span - 1 + starts])
            fits = np.ones(starts, bool)  # windows must not pass the end of their text
            ends = at[i + 1 : j + 1]
            for e in (ends[(ends > a) & (ends < b)] - a).tolist():
                fits[max(0, e - w + 1) : e] = False
            place = (least[fits] & _LOW).astype(np.int64)
            place = place[np.diff(place, prepend=-1) != 0]
            if len(place) and place[0] + a == last:
                place = place[1:]
            if len(place):
                last = int(place[-1]) + a
                doc = np.searchsorted(at, place + a, "right") - 1
                yield doc, place + a - at[doc], h[place]
        i = j


# ---------------------------------------------------------------- runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes are common."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    low, high = known, min(known + step, n)  # the first difference lies in [low, high)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """(common prefix with the one before, remaining length) pairs, and the remaining bytes, of sorted strings."""
    head, rest, before = np.zeros((len(strings), 2), np.uint16), [], b""
    for i, s in enumerate(strings):
        c = common_prefix(before, s)
        head[i] = c, len(s) - c
        rest.append(s[c:])
        before = s
    return head, b"".join(rest)


def front_decode(head: np.ndarray, rest: bytes) -> tuple[list[bytes], list[int]]:
    out, at, before, lcps = [], 0, b"", head[:, 0].tolist()
    for c, n in head.tolist():
        before = before[:c] + rest[at : at + n]
        at += n
        out.append(before)
    return out, lcps


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in the run, common prefix with the string before) in sorted order, by a loser tree.

    A leaf's string is known to share ``known[leaf]`` bytes with the last winner. A leaf that shares more comes first;
    with equal knowledge the comparison starts at that length, and the loser's new knowledge is the prefix it shares with the
    winner. Equal strings go by run.
    """
    count = max(1, len(runs))
    size = 1 << (count - 1).bit_length()
    place = [0] * size
    head: list[bytes | None] = [runs[r][0][0] if r < len(runs) and runs[r][0] else None for r in range(size)]
    known = [0] * size
    loser = [-1] * size

    def wins(a: int, b: int) -> bool:
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        if known[a] != known[b]:
            return known[a] > known[b]  # the loser's knowledge holds for the winner too
        c = common_prefix(x, y, known[a])
        if c == len(x) == len(y):
            first = a < b
        else:
            first = c == len(x) or (c < len(y) and x[c] < y[c])
        known[b if first else a] = c
        return first

    winner = list(range(size)) if size > 1 else [0]
    level = winner
    base = size
    while len(level) > 1:
        base //= 2
        up = []
        for n in range(0, len(level), 2):
            a, b = level[n], level[n + 1]
            if wins(a, b):
                up.append(a)
                loser[base + n // 2] = b
            else:
                up.append(b)
                loser[base + n // 2] = a
        level = up
    top = level[0]
    while head[top] is not None:
        yield top, place[top], known[top]
        place[top] += 1
        strings, lcps = runs[top]
        if place[top] < len(strings):
            head[top], known[top] = strings[place[top]], lcps[place[top]]
        else:
            head[top] = None
        node = (size + top) // 2
        while node:
            if wins(loser[node], top):
                loser[node], top = top, loser[node]
            node //= 2


# ---------------------------------------------------------------- repeated windows


def repeated(rights: list[bytes], lefts: list[bytes], weights: np.ndarray, lcp: np.ndarray, widths: tuple[int, ...] = (W, PASSAGE), k: int = K) -> list[tuple[int, int, int, int]]:
    """(context, first, last + 1, place of the width): bytes around an anchor that repeated windows of each width cover, from
    sorted contexts.

    ``lefts`` are reversed (nearest byte first); ``lcp`` is each right side's common prefix with the one before. Only contexts
    that share an anchor's K bytes with a neighbour, or have a weight over 1, can have any.
    """
    n = len(rights)
    joined = lcp >= k
    if n:
        joined[0] = False
    busy = joined.copy()
    busy[:-1] |= joined[1:]
    busy |= weights > 1
    at = np.flatnonzero(busy)
    if not len(at):
        return []
    lcp = np.where(joined, lcp, 0)[at]  # groups do not touch each other
    group = np.cumsum(lcp == 0)
    weights = weights[at]
    left_size = np.array([len(lefts[i]) for i in at])
    right_size = np.array([len(rights[i]) for i in at])
    order = sorted(range(len(at)), key=lambda i: (group[i], lefts[at[i]]))
    shared, before = np.zeros(len(at), np.int64), None
    for rank, i in enumerate(order):
        if before is not None and group[before] == group[i]:
            shared[rank] = common_prefix(lefts[at[before]], lefts[at[i]])
        else:
            shared[rank] = -1
        before = i
    rank_of = np.empty(len(at), np.int64)
    rank_of[order] = np.arange(len(at))
    out = []
    for which, w in enumerate(widths):
        marks = np.zeros((len(at), w - k + 2), bool)
        for o in range(w - k + 1):
            valid = np.flatnonzero((left_size >= o) & (right_size >= w - o))
            if not len(valid):
                continue
            right_class = np.cumsum(lcp < w - o)[valid]
            left_class = np.cumsum(shared < o)[rank_of[valid]]
            _, where = np.unique(right_class * (len(at) + 1) + left_class, return_inverse=True)
            marks[valid, o] = np.bincount(where, weights[valid])[where] > 1
        edge = np.diff(marks.astype(np.int8), axis=1, prepend=0)
        begin, end = np.argwhere(edge == 1), np.argwhere(edge == -1)
        for (i, o), (_, p) in zip(begin.tolist(), end.tolist()):
            out.append((int(at[i]), -(p - 1), w - o, which))
    return out


def _contexts(texts: pa.Array, places: pa.Array, w: int, k: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    for i in range(len(texts)):
        raw = texts[i].as_buffer().to_pybytes()
        for p in places[i].values.to_pylist():
            yield i, p, raw[p : p + w], raw[max(0, p - (w - k)) : p][::-1]


def _identity(right: bytes, left: bytes) -> bytes:
    return hashlib.blake2b(len(right).to_bytes(2, "big") + right + left, digest_size=16).digest()


def merged_spans(candidates: DataFrame, widths: tuple[int, ...], k: int) -> DataFrame:
    """(key, first, last, which): bytes of each candidate text that repeated windows of each width cover; spans may overlap."""
    w = max(widths)
    volume = candidates.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = max(1, int(volume * (2 * w - k) // PART_BYTES))
    every = max(1, volume // (64 * parts))  # a bounded number of splitter candidates
    prefix = candidates.select(F.explode("places").alias("p"), "text", "key").where(F.pmod(F.xxhash64("key", "p"), F.lit(every)) == 0).select(F.substring(F.col("text").cast("binary"), F.col("p") + 1, F.lit(24)).alias("s"))
    drawn = sorted(bytes(r.s) for r in prefix.collect()) if parts > 1 else []
    cuts = [drawn[len(drawn) * i // parts] for i in range(1, parts)] if len(drawn) >= parts else []
    cuts = sorted(set(cuts))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "head", "rest", "left_size", "left", "weight", "ids", "key", "place", "id"]
        kinds = [pa.int32(), *[pa.binary()] * 6, pa.binary(), pa.int32(), pa.binary()]

        def flush(found: dict[bytes, list], members: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows: list[list] = [[] for _ in range(7)]
            ordered = sorted((v[0], v[1], i, v[2]) for i, v in found.items())
            cut = [0]
            for c in cuts:  # strings with a cut's first bytes go to its right
                low, high = cut[-1], len(ordered)
                while low < high:
                    middle = (low + high) // 2
                    if ordered[middle][0] < c:
                        low = middle + 1
                    else:
                        high = middle
                cut.append(low)
            cut.append(len(ordered))
            for part, (a, b) in enumerate(zip(cut, cut[1:])):
                if a == b:
                    continue
                chunk = ordered[a:b]
                head, rest = front_code([c[0] for c in chunk])
                for column, value in zip(rows, (part, head.tobytes(), rest, np.array([len(c[1]) for c in chunk], np.uint16).tobytes(), b"".join(c[1] for c in chunk), np.array([c[3] for c in chunk], np.int32).tobytes(), b"".join(c[2] for c in chunk))):
                    column.append(value)
            n, m = len(rows[0]), len(members)
            key, place, ident = ([x[c] for x in members] for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([*c, *[None] * m], t) for c, t in zip(rows, kinds)] + [pa.array([*[None] * n, *c], t) for c, t in zip((key, place, ident), kinds[7:])], names=names)

        found: dict[bytes, list] = {}
        members: list[tuple] = []
        held = 0
        for batch in batches:
            keys = batch.column(0)
            for i, p, right, left in _contexts(batch.column(1), batch.column(2), w, k):
                ident = _identity(right, left)
                members.append((keys[i].as_py(), p, ident))
                if ident in found:
                    found[ident][2] += 1
                else:
                    found[ident] = [right, left, 1]
                    held += len(right) + len(left) + 150
                held += 100
                if held > 4 * RUN_BYTES:
                    yield from flush(found, members)
                    found, members, held = {}, [], 0
        if members:
            yield from flush(found, members)

    exchange = written(candidates.select("key", "text", "places").mapInArrow(runs, "part int, head binary, rest binary, left_size binary, left binary, weight binary, ids binary, key binary, place int, id binary"), "runs")

    def combine_runs(table: pa.Table) -> pa.Table:
        found = []
        for row in table.to_pylist():
            strings, lcps = front_decode(np.frombuffer(row["head"], np.uint16).reshape(-1, 2).astype(np.int64), row["rest"])
            sizes = np.frombuffer(row["left_size"], np.uint16).astype(np.int64)
            ends = np.cumsum(sizes)
            lefts = [row["left"][a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            ids = [row["ids"][j : j + 16] for j in range(0, len(row["ids"]), 16)]
            found.append((strings, lcps, lefts, np.frombuffer(row["weight"], np.int32), ids))
        rights, lefts, weights, lcp, ids, at = [], [], [], [], [], {}
        for r, p, c in merge([(f[0], f[1]) for f in found]):
            ident = found[r][4][p]
            if rights and c == len(found[r][0][p]) == len(rights[-1]) and ident in at:  # the same context from another run
                weights[at[ident]] += int(found[r][3][p])
                continue
            if not rights or not c == len(found[r][0][p]) == len(rights[-1]):
                at = {}  # contexts of one right side
            at[ident] = len(rights)
            rights.append(found[r][0][p])
            lefts.append(found[r][2][p])
            weights.append(int(found[r][3][p]))
            lcp.append(c)
            ids.append(ident)
        spans = repeated(rights, lefts, np.array(weights, np.int64), np.array(lcp, np.int64), widths, k)
        columns = list(zip(*spans)) or [()] * 4
        return pa.table({"id": pa.array([ids[i] for i in columns[0]], pa.binary()), **{n: pa.array(v, pa.int32()) for n, v in zip(("a", "b", "which"), columns[1:])}})

    coded = exchange.where("part IS NOT NULL").select("part", "head", "rest", "left_size", "left", "weight", "ids")
    covered = coded.groupBy("part").applyInArrow(combine_runs, "id binary, a int, b int, which int")
    members = exchange.where("part IS NULL").select("key", "place", "id")
    return members.join(covered, "id").select("key", (F.col("place") + F.col("a")).alias("first"), (F.col("place") + F.col("b")).alias("last"), "which")


# ---------------------------------------------------------------- the operator


def _union(first: np.ndarray, last: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs that spans cover, within a text of ``size`` bytes."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, end = np.maximum(first[order], 0), np.maximum.accumulate(np.minimum(last[order], size))
    head = np.flatnonzero(np.concatenate(([True], first[1:] > end[:-1])))
    return list(zip(first[head].tolist(), end[np.append(head[1:], len(end)) - 1].tolist()))


def remove_repeats(docs: DataFrame, w: int = W, k: int = K, text: str = "text", ident: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null where the text stays whole), n_shared for every row.

    ``n_shared`` counts the bytes that repeats of ``passage`` bytes (``w`` at most) cover; nothing is removed for their sake.

    Texts are UTF-8 bytes (null: empty); what remains may cut a character, hence bytes. Matches stay within a text; equal
    rows are two places. Null ids are carried; an empty table gives an empty result; other columns are ignored.
    """
    passage = min(passage, w)
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(ident).alias("doc_id"), raw.alias("text"))
    source = source.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    key = F.unhex(F.substring("sha", 1, 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for doc, place, h in anchors(batch.column(1), passage, k):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], names=["key", "place", "h"])

    ids = written(source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha", key.alias("key")), "ids")
    one = ids.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    found = written(source.select(key.alias("key"), "text").mapInArrow(run, "key binary, place int, h long"), "anchors")
    tag = F.xxhash64("key", "place")
    again = found.groupBy("h").agg(F.min(tag).alias("x"), F.max(tag).alias("y")).where("x <> y").select("h")
    again = written(again, "repeated")  # on its own, so that the join below can split a hash that very many texts share
    places = found.join(again, "h", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"))
    wanted = written(places.join(one, "key"), "places")
    texts = source.withColumn("key", key).select("doc_id", "key", "text").join(wanted.withColumnRenamed("key", "_k").hint("shuffle_hash"), (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    if ids.groupBy("key", "doc_id").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["key"])
    candidates = written(texts.select("key", "text", "places"), "candidates")
    drop(found)
    spans = merged_spans(candidates, (w, passage), k).groupBy("key").agg(F.collect_set(F.struct("first", "last", "which")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, runs, kept, shared = [], [], [], []
            cut_at, (first, last, which) = batch.column(2).offsets.to_pylist(), (np.asarray(x) for x in batch.column(2).values.flatten())
            for t, i, j in zip(batch.column(1), cut_at, cut_at[1:]):
                raw = t.as_buffer().to_pybytes()
                wide, short = (_union(first[i:j][which[i:j] == k], last[i:j][which[i:j] == k], len(raw)) for k in (0, 1))
                gone.append(sum(b - a for a, b in wide))
                runs.append(len(wide))
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in wide)], [*(a for a, _ in wide), len(raw)])))
                shared.append(sum(b - a for a, b in short))
            numbers = [pa.array(v, pa.int64()) for v in (gone, runs, shared)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array([hashlib.sha256(c).hexdigest() for c in kept], pa.string()), pa.array(kept, pa.binary())], names=["key", "n_removed", "n_spans", "n_shared", "kept_sha256", "kept"])

    cuts = candidates.select("key", "text").join(spans, "key").mapInArrow(cut, "key binary, n_removed long, n_spans long, n_shared long, kept_sha256 string, kept binary")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= w)
    out = ids.join(one, "key").join(cuts, "key", "left")
    pick = lambda all_gone, cut_, none: F.when(whole, all_gone).otherwise(F.coalesce(cut_, none))
    return out.select(
        F.col("doc_id").alias(ident),
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when((F.col("copies") > 1) & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("n_shared", F.lit(0).cast("long"))).alias("n_shared"),
    )
