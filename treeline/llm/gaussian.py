"""Regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance that is shrunk twice: towards the covariance pooled over the classes, then
towards its own diagonal mean. A score is the posterior from log densities: the Mahalanobis distance through a cached
Cholesky factor, and the log determinant read off that factor's diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, bounded_sample, combine, drop, labelled, remainder, text_buffers, words, written

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 sentence marks, 4 other marks, 5 white space, 6 not ASCII, 7 newline
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 4
_KIND[[0x2E, 0x2C]] = 3
_KIND[[0x20, 9, 11, 12, 13]] = 5
_KIND[10] = 7
_KIND[0x80:] = 6

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "short_words", "distinct_words", "distinct_triples", "top_word",
    "upper", "digits", "stops", "marks", "spaces", "not_ascii", "newlines", "distinct_lines", "marked_words",
)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A share a/b on the log-odds scale, smoothed by half a count; 0 of 0 is even."""
    return np.log((a + 0.5) / (np.maximum(b - a, 0) + 0.5))


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct hashes, and how often the most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    base = int(doc[0])
    bits = np.uint64(44)  # of a hash; the text's place in the run stands above them
    key = np.sort(((doc - base).astype(np.uint64) << bits) | (h >> np.uint64(20)))
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(key)))
    d = (key[first] >> bits).astype(np.int64) + base
    top = np.zeros(n)
    heads = np.flatnonzero(np.diff(d, prepend=-1))
    top[d[heads]] = np.maximum.reduceat(run, heads)
    return np.bincount(d, minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of `FEATURES` for each text; a null or empty text has the values of no word."""
    n = len(column)
    _, at = text_buffers(column)
    size = np.diff(at).astype(float)
    kinds = np.zeros((n, 8))
    count, length, square, short, marked, distinct, top, triples, triple, lines, line = (np.zeros(n) for _ in range(11))
    held: list[tuple[np.ndarray, np.ndarray]] = []  # words of a text that is not complete yet, and their lines
    newlines = 0
    for w in words(column, lower=True, limit=PIECE):
        # a piece holds whole texts, a part of a long one, or the end of one and whole texts: counts add up, and what is distinct is told of whole texts
        i, j = w.docs
        cuts = np.maximum(at[i : j + 1] - at[j] + len(w.data), 0) if w.last else np.array([0, len(w.data)])  # the first text may have begun before
        kind = _KIND[w.data]
        some = np.flatnonzero(np.diff(cuts))
        begin = cuts[some]
        if len(w.data):
            for k in range(1, 8):
                kinds[i + some, k] += np.add.reduceat(kind == k, begin, dtype=np.int64)
        long = (w.end - w.start).astype(float)
        count += np.bincount(w.doc, minlength=n)
        length += np.bincount(w.doc, long, minlength=n)
        square += np.bincount(w.doc, long * long, minlength=n)
        short += np.bincount(w.doc, long <= 3, minlength=n)
        if len(w.end):
            marked += np.bincount(w.doc, _KIND[w.data[w.end - 1]] == 4, minlength=n)
        ends = np.concatenate(([0], np.cumsum(w.data == 10)))
        held.append((w.hashes, newlines + ends[w.start]))
        if not w.last:
            newlines += int(ends[-1])
            continue
        before = sum(len(x) for x, _ in held[:-1])
        hashes, newline = (np.concatenate(x) for x in zip(*held))
        doc = np.concatenate((np.full(before, i), w.doc))
        held, newlines = [], 0
        a, b = _distinct(doc, hashes, n)
        distinct, top = distinct + a, np.maximum(top, b)
        h3 = combine(hashes, 3)
        inside = doc[: len(h3)] == doc[len(doc) - len(h3) :]
        a, _ = _distinct(doc[: len(h3)][inside], h3[inside], n)
        triples, triple = triples + a, triple + np.bincount(doc[: len(h3)][inside], minlength=n)
        if len(hashes):  # lines: runs of words without a newline between
            head = np.flatnonzero(np.concatenate(([True], (newline[1:] != newline[:-1]) | (doc[1:] != doc[:-1]))))
            place = np.arange(len(hashes)) - np.repeat(head, np.diff(np.append(head, len(hashes))))
            with np.errstate(over="ignore"):
                h = np.add.reduceat(hashes * (2 * place + 1).astype(np.uint64), head)
            a, _ = _distinct(doc[head], h, n)
            lines, line = lines + a, line + np.bincount(doc[head], minlength=n)
    some = np.maximum(count, 1)
    mean = length / some
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(np.sqrt(np.maximum(square / some - mean * mean, 0))), _share(short, count), _share(distinct, count), _share(triples, triple), _share(top, count),
        _share(kinds[:, 1], size), _share(kinds[:, 2], size), _share(kinds[:, 3], size), _share(kinds[:, 4], size), _share(kinds[:, 5], size), _share(kinds[:, 6], size), _share(kinds[:, 7], size), _share(lines, line), _share(marked, count),
    ])


def features(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id and ``x``, its statistics as an array of doubles, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "x"])

    source = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, lower Cholesky factors of the shrunk covariances, log determinants and log priors."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    logpriors: np.ndarray

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Rows of class probabilities."""
        d = self.means.shape[1]
        logs = np.empty((len(x), len(self.means)))
        for k, (mean, factor) in enumerate(zip(self.means, self.factors)):
            z = np.linalg.solve(factor, (x - mean).T)
            logs[:, k] = self.logpriors[k] - 0.5 * (self.logdets[k] + (z * z).sum(0) + d * np.log(2 * np.pi))
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(1, keepdims=True)


def moments(rows: DataFrame, size: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label: rows, sum and sum of outer products of ``x``; the cluster adds up, ``size``-squared numbers return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, size)
            y = np.asarray(batch.column(0))
            one = np.column_stack([np.ones(len(x)), x])
            for k in np.unique(y):
                total[int(k)] = total.get(int(k), 0) + one[y == k].T @ one[y == k]
        for k, m in total.items():
            at = pa.array(np.arange(m.size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([k] * m.size, pa.int32()), at, pa.array(m.ravel())], names=["label", "i", "v"])

    found = rows.select("label", "x").mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        out.setdefault(r.label, np.zeros((size + 1) ** 2))[r.i] = r.v
    return {k: (m.reshape(size + 1, -1)[0, 0], m.reshape(size + 1, -1)[0, 1:], m.reshape(size + 1, -1)[1:, 1:]) for k, m in sorted(out.items())}


def fit(found: dict[int, tuple[float, np.ndarray, np.ndarray]], classes: tuple[int, ...], size: int, pooled: float = 0.5, ridge: float = 0.02) -> Discriminant:
    """A class without rows takes the pooled mean and covariance, and the prior of half a row."""
    n = {k: found[k][0] if k in found else 0.0 for k in classes}
    rows = sum(n.values())
    scatter, mean = np.zeros((size, size)), np.zeros(size)
    for k in classes:
        if n[k]:
            s = found[k][1]
            scatter += found[k][2] - np.outer(s, s) / n[k]
            mean += s
    mean = mean / max(rows, 1)
    within = scatter / max(rows, 1) + 1e-9 * np.eye(size) if rows else np.eye(size)
    means, factors, logdets = [], [], []
    for k in classes:
        m = found[k][1] / n[k] if n[k] else mean
        own = (found[k][2] / n[k] - np.outer(m, m)) if n[k] else within
        a = max(pooled, min(1.0, size / max(n[k], 1)))  # few rows: more of the pooled covariance
        cov = (1 - a) * own + a * within
        cov = (1 - ridge) * cov + ridge * np.diag(np.maximum(np.diag(within), 1e-3))
        factor = np.linalg.cholesky(cov)
        means.append(m)
        factors.append(factor)
        logdets.append(2 * np.log(np.diag(factor)).sum())
    priors = np.array([n[k] + 0.5 for k in classes])
    return Discriminant(np.array(means), np.array(factors), np.array(logdets), np.log(priors / priors.sum()))


def posteriors(rows: DataFrame, model: Discriminant, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``p``, the class probabilities, from rows with ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(keep)).flatten()).reshape(-1, model.means.shape[1])
            p = model.posterior(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], flat], names=[*keep, "p"])

    source = rows.select(*keep, "x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, p array<double>")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: int = 5, held: int = 0, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (posterior of label 1) and predicted (score >= ``threshold``) for every row.

    Labels are learnt from all labelled ids whose crc32 modulo ``fold`` is not ``held``; only the text gives features. A
    null or empty text gets the score of its (empty) statistics; an id with several labels counts once, with the
    largest; without any training label all scores are one half. Repeated rows stay; other columns are ignored.
    """
    x = written(features(docs, text, ident), "statistics")
    train = labelled(labels, "quality").where(remainder(F.col("doc_id"), fold) != held)
    once = x.join(train, "doc_id").select("label", "x")
    model = fit(moments(once, len(FEATURES)), (0, 1), len(FEATURES))
    scored = posteriors(x, model)
    return scored.select(F.col("doc_id").alias(ident), (remainder(F.col("doc_id"), fold) == held).alias("held_out"), F.col("p")[1].alias("score"), (F.col("p")[1] >= threshold).cast("int").alias("predicted"))



def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 60_000, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose posterior of label 1 is at least ``threshold``, unchanged; no text is shuffled.

    Fitted on at most ``sample`` labelled ids (those of the smallest id hash), so that they can be sent to the documents. A null
    or empty text has the posterior of its (empty) statistics, a long one that of the whole text; null ids are judged like
    any other, repeated rows are kept or dropped together, an id with several labels counts with the largest; without labels
    every row stays; an empty table stays empty; other columns are passed on, whatever their names.
    """
    ids = bounded_sample(labelled(labels, "quality"), sample)
    train = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")  # at most `sample` rows of 12 bytes
    x = written(features(train, ident="label"), "statistics")  # else a task has two Python workers, and they stay
    model = fit(moments(x.withColumnRenamed("doc_id", "label"), len(FEATURES)), (0, 1), len(FEATURES))
    drop(x)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.posterior(statistics(batch.column(place)))[:, 1] >= threshold))

    return docs.mapInArrow(run, docs.schema)
