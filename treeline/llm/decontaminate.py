"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every start in a test item opens a seed: the shortest run of 3 to 8 words that is rare, that is, whose chance count in
the corpus (tokens times the words' corpus shares) is at most one. Copies of an item do not make its seeds common, and a
larger corpus gets longer seeds, so chance hits never outnumber the seeds. Items shorter than that are one seed. Hits
open a window of the document around the place that the item would take there; the window is aligned with the
whole item, so edits, gaps and paraphrased stretches between seeds lower the score instead of losing the copy.

Documents are never shuffled. Items go to the executors in blocks of a bounded size, one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, combine
from .common import words as exact_words

SHORTEST, LONGEST = 3, 8
MATCH, MISMATCH, GAP = 2, -1, -1
SIMILARITY = 0.5
BLOCK_BYTES = 8 << 20


def words(column: pa.Array) -> Iterator[Words]:
    """Words in lower case of all scripts: an upper-cased copy is still a copy."""
    return exact_words(pc.utf8_lower(column), lower=False)


@dataclass(frozen=True)
class Seeds:
    """Items as word hashes, and for each seed length the sorted seed hashes with (item, place) lists."""

    ids: list
    items: list[np.ndarray]
    index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _hashes(texts: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for w in words(pa.array(texts, pa.string())):
        for d in np.unique(w.doc):
            parts[d].append(w.hashes[w.doc == d])
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Corpus counts of the (sorted) vocabulary's words, and of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for w in words(batch.column(0)):
                at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
                total[:-1] += np.bincount(at[known[at] == w.hashes], minlength=len(known))
                total[-1] += len(w.hashes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    return out[:-1], int(out[-1])


def seeds(ids: list, items: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray, total: int) -> Seeds:
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, item in enumerate(items):
        if not len(item):
            continue
        logs = np.log(np.maximum(counts[np.searchsorted(vocabulary, item)], 1) / max(total, 1))
        sums = np.concatenate(([0.0], np.cumsum(logs)))
        grams = {n: combine(item, n) for n in {min(n, len(item)) for n in range(SHORTEST, LONGEST + 1)}}
        for at in range(max(1, len(item) - SHORTEST + 1)):
            for n in range(SHORTEST, LONGEST + 1):
                if at + n > len(item):
                    if at == 0:  # the whole item
                        found.setdefault(len(item), []).append((int(grams[len(item)][0]), k, 0))
                    break
                if sums[at + n] - sums[at] + np.log(max(total, 1)) <= 0 or n == LONGEST:
                    found.setdefault(n, []).append((int(grams[n][at]), k, at))
                    break
    index = {}
    for n, rows in found.items():
        rows.sort()
        index[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Seeds(ids, items, index)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int, int]:
    """Smith-Waterman with linear gaps: score, and the first and last + 1 word in item and window.

    Row by row over the item; within a row, gaps along the window come from a running maximum. Ties go to the earliest
    end, and to a match before a gap.
    """
    m = len(window)
    ramp = np.arange(1, m + 1, dtype=np.int32) * -GAP
    rows = np.zeros((len(item) + 1, m + 1), np.int32)
    for i, word in enumerate(item):
        best = np.maximum(rows[i, :-1] + np.where(window == word, MATCH, MISMATCH), rows[i, 1:] + GAP)
        np.maximum(best, 0, out=best)
        rows[i + 1, 1:] = np.maximum.accumulate(best + ramp) - ramp
    end = int(rows.argmax())
    i, j = divmod(end, m + 1)
    score, last_i, last_j = int(rows[i, j]), i, j
    while i and j and rows[i, j]:
        if rows[i, j] == rows[i - 1, j - 1] + (MATCH if item[i - 1] == window[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, i, last_i, j, last_j


def _hits(h: np.ndarray, doc: np.ndarray, model: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in h, item, place in item) of every seed hit."""
    out = [(np.zeros(0, np.int64),) * 3]
    for n, (keys, item, place) in model.index.items():
        g = combine(h, n)
        if not len(g):
            continue
        low = np.searchsorted(keys, g, "left")
        at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == g)
        at = at[doc[at] == doc[at + n - 1]]
        first = low[at]
        many = np.searchsorted(keys, g[at], "right") - first
        if not len(at):
            continue
        k = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append((np.repeat(at, many), item[k], place[k]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _windows(spans: list[list[int]], stop: int, size: int) -> Iterator[tuple[int, int]]:
    """Spans in overlapping windows of bounded length. An alignment of a positive score has at most three words of the text for
    each of the item's (MATCH pays for two gaps), so one of the windows holds it whole."""
    reach = 3 * size + 16
    for low, high in spans:
        high = min(high, stop)
        yield low, min(high, low + 2 * reach)
        for a in range(low + reach, high - reach, reach):
            yield a, min(high, a + 2 * reach)


def _matches(column: pa.Array, model: Seeds, similarity: float) -> dict[tuple[int, int], tuple]:
    """Best alignment per (row, item): (score, similarity, first and last + 1 word of the row, of the item)."""
    widest = max((len(x) for x in model.items), default=0)
    carry, found = 4 * widest + 32, {}
    tail_h, tail_doc, base = np.zeros(0, np.uint64), -1, 0
    for w in words(column):
        h, doc = w.hashes, w.doc
        if tail_doc == w.docs[0] and len(tail_h):
            h = np.concatenate((tail_h, h))
            doc = np.concatenate((np.full(len(tail_h), tail_doc), doc))
        else:
            base = 0
        place, item, at = _hits(h, doc, model)
        if len(place):
            edge = np.flatnonzero(np.diff(doc, prepend=-1))
            begin = edge[np.searchsorted(edge, place, "right") - 1]
            order = np.lexsort((place - at, item, begin))
            groups: dict[tuple[int, int], list[list[int]]] = {}
            for p, k, a, s in zip(place[order].tolist(), item[order].tolist(), at[order].tolist(), begin[order].tolist()):
                size = len(model.items[k])
                pad = max(8, size // 4)
                low, high = max(s, p - a - pad), p - a + size + pad
                spans = groups.setdefault((s, k), [])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            for (s, k), spans in groups.items():
                d = int(doc[s])
                stop = int(np.searchsorted(doc, d, "right"))
                own = base if d == w.docs[0] else 0
                for low, high in _windows(spans, stop, len(model.items[k])):
                    score, i0, i1, j0, j1 = align(model.items[k], h[low:high])
                    like = score / (MATCH * len(model.items[k]))
                    if like >= similarity and (score, -(own + low - s + j0)) > (lambda b: (b[0], -b[2]) if b else (0, 0))(found.get((d, k))):
                        found[d, k] = (score, like, own + low - s + j0, own + low - s + j1, i0, i1)
        if w.last:
            tail_h, tail_doc = np.zeros(0, np.uint64), -1
        else:
            keep = min(carry, len(h))
            base += len(h) - keep
            tail_h, tail_doc = h[len(h) - keep :], w.docs[0]
    return found


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of about ``size`` bytes: what is sent to the executors at once is bounded, the benchmark is not."""
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = int(total // size) + 1
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        if rows:
            rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
            yield [r.item_id for r in rows], [r.text for r in rows]


def _models(docs: DataFrame, benchmark: DataFrame) -> Iterator[Seeds]:
    for ids, texts in blocks(benchmark):
        items = _hashes(texts)
        vocabulary = np.unique(np.concatenate(items))
        if len(vocabulary):
            yield seeds(ids, items, vocabulary, *word_counts(docs, vocabulary))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, item_id) pairs that align at ``similarity`` or more, each with its best alignment.

    Columns: doc_id, item_id, score, similarity (score over that of the whole item), doc_first, doc_last, item_first,
    item_last (in words, last exclusive). Null or empty texts and items match nothing; null ids are carried as they are; a
    repeated row gives its pairs again. Other columns are ignored; empty tables give an empty result.
    """
    source = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    doc_type, item_type = source.schema[0].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, score long, similarity double, doc_first long, doc_last long, item_first long, item_last long"
    out = None
    for model in _models(source.select("text"), benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                found = sorted(_matches(batch.column(1), model, similarity).items())
                if found:
                    rows = pa.array([d for (d, _), _ in found], pa.int64())
                    columns = [pa.array([v[c] for _, v in found]) for c in range(6)]
                    ids = pa.array([model.ids[k] for (_, k), _ in found])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), ids, *columns], names=["doc_id", "item_id", "score", "similarity", "doc_first", "doc_last", "item_first", "item_last"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, unchanged; nothing is shuffled.

    Null and empty texts hold none and stay, as do all rows where the benchmark is empty; repeated rows stay or go together;
    ids are not looked at; other columns are passed on, whatever their names.
    """
    place = docs.columns.index(text)
    out = docs
    for model in _models(docs.select(F.col(text).cast("string").alias("text")), benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.array(sorted({d for d, _ in _matches(batch.column(place), shared.value, similarity)}), np.int64)
                stay = np.ones(len(batch), bool)
                stay[bad] = False
                yield batch.filter(pa.array(stay))

        out = out.mapInArrow(run, docs.schema)
    return out
