"""Mixing by soft domain membership.

A classifier fitted on the `labels` table gives each document posteriors over the domains ``low`` (quality 0),
``clean`` (quality 1, not toxic) and ``toxic`` (quality 1, toxic). Projected least squares then finds nonnegative document
rates, as near 1 as possible, whose expected tokens per domain meet the target weights. The rates are 1 minus the posteriors'
product with one multiplier per domain, cut at 0; the multipliers follow the gradient, scaled by the second moments of the
documents above 0 (Newton steps). Each step is one distributed sum over documents of a few numbers per domain, and a
document's rate follows from its posteriors and the multipliers, so no rate table is passed around.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, labelled, written
from .gaussian import FEATURES, Discriminant, fit, moments, posteriors, statistics
from .toxicity import Lexicon, scan
from .toxicity import fit as fit_toxicity

DOMAINS = ("low", "clean", "toxic")
TARGETS = {"low": 0.05, "clean": 0.92, "toxic": 0.03}
NEAR = 1e-8  #: weight of keeping rates near 1 against meeting the targets
STEPS = 60
TOLERANCE = 1e-3  #: targets are met to this share of each; `solve` warns where they cannot be
SIZE = len(FEATURES) + 1


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): the domain's place in `DOMAINS`; a missing toxic label counts as 0."""
    q, t = labelled(labels, "quality"), labelled(labels, "toxic").withColumnRenamed("label", "toxic")
    return q.join(t, "doc_id", "left").select("doc_id", F.when(F.col("label") == 0, 0).when(F.col("toxic") == 1, 2).otherwise(1).alias("label"))


def _vector(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    beyond, count, _ = scan(column, lexicon)
    return np.column_stack([statistics(column), np.cbrt(beyond)]), count


def evidence(docs: DataFrame, model: Lexicon) -> DataFrame:
    """doc_id, n_tokens, x: document statistics and the toxicity scan's evidence, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, count = _vector(batch.column(1), shared.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), flat], names=["doc_id", "n_tokens", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, x array<double>")


def _classifier(plain: DataFrame, labels: DataFrame) -> tuple[Lexicon, Discriminant, DataFrame]:
    """Lexicon and domain model, and the evidence of every row as a written table."""
    lexicon, _ = fit_toxicity(plain, labels, fold=None)
    rows = written(evidence(plain, lexicon), "evidence")
    return lexicon, fit(moments(rows.join(domain_labels(labels), "doc_id"), SIZE), (0, 1, 2), SIZE), rows


def membership(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, p (posteriors in the order of `DOMAINS`) for every row, as a written table."""
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    _, model, rows = _classifier(plain, labels)
    out = written(posteriors(rows, model, ("doc_id", "n_tokens")), "membership")
    drop(rows)
    return out


def rate(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps: each is a move along minus the posteriors' product with its direction (and back towards 1),
    cut at 0. A step is (domains' direction, shrink)."""
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(0.0, r + step[-1] * (1.0 - r) - p @ step[:-1])
    return r


def _sums(members: DataFrame, steps: list[np.ndarray], k: int) -> np.ndarray:
    """Expected tokens per domain, tokens, tokens times squared rate, and the second moments of documents above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + 2 + k * k)
        for batch in batches:
            n = np.asarray(batch.column(0)).astype(float)
            p = np.asarray(batch.column(1).flatten()).reshape(-1, k)
            r = rate(p, steps)
            total[:k] += (n * r) @ p
            total[k] += n.sum()
            total[k + 1] += (n * r**2).sum()
            total[k + 2 :] += ((p * (n * (r > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(k + 2 + k * k)
    for row in members.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row.i] = row.v
    return out


def solve(members: DataFrame, targets: dict[str, float], near: float = NEAR, most: int = STEPS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The step from rates of 1 to the solution, expected domain tokens reached, and target tokens.

    Minimises  |expected / T - weight|^2 / 2 + near / 2 * sum n (rate - 1)^2 / T  over rates >= 0, T all tokens: a
    convex problem. Its rates are max(0, 1 - p m) for the multipliers m that minimise the convex
    sum n rate^2 / 2 T + weight m + near |m|^2 / 2, whose gradient is weight + near m - expected / T. Warns if a target is
    not met to `TOLERANCE`, as where no document belongs to its domain.
    """
    k = len(DOMAINS)
    weight = np.array([targets[d] for d in DOMAINS], float)
    weight = weight / weight.sum()
    m = np.zeros(k)
    now = _sums(members, [], k)
    total = now[k]
    if not total:
        return [], now[:k], weight * 0
    value = lambda s, m: s[k + 1] / total / 2 + weight @ m + near * m @ m / 2
    passes = 1
    while passes < most:
        slope = weight + near * m - now[:k] / total
        if np.abs(slope).max() <= 1e-10:
            break
        move = -np.linalg.solve(now[k + 2 :].reshape(k, k) / total + max(near, 1e-12) * np.eye(k), slope)
        length = 1.0
        while passes < most:
            then = _sums(members, [np.append(m + length * move, 0.0)], k)
            passes += 1
            if value(then, m + length * move) <= value(now, m) + 1e-4 * length * (slope @ move) + 1e-14:
                break
            length /= 2
        else:
            break
        m, now = m + length * move, then
        if length * -(slope @ move) <= 1e-16 * (1 + abs(value(now, m))):
            break
    goal = weight * total
    if (np.abs(now[:k] - goal) > TOLERANCE * goal).any():
        warnings.warn(f"targets not met: {dict(zip(DOMAINS, (now[:k] / total).round(5).tolist()))} instead of {dict(zip(DOMAINS, weight.tolist()))}", stacklevel=2)
    return [np.append(m, 0.0)], now[:k], goal


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, near: float = NEAR, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, p_low, p_clean, p_toxic, rate, copies for every row.

    ``copies`` is the rate, rounded up or down by a hash of the id so that its expectation is the rate. A null or empty
    text has no tokens and follows its posteriors like any other; null ids share one hash; an empty table gives an empty
    result; without labels the posteriors are equal and rates meet no more than the total. Repeated rows stay; other
    columns are ignored.
    """
    members = membership(docs, labels, text, ident)
    steps, _, _ = solve(members, targets or TARGETS, near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(2).flatten()).reshape(-1, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, p.T.copy()), pa.array(rate(p, steps))], names=["doc_id", "n_tokens", "p_low", "p_clean", "p_toxic", "rate"])

    out = members.mapInArrow(run, f"doc_id {members.schema[0].dataType.simpleString()}, n_tokens long, p_low double, p_clean double, p_toxic double, rate double")
    return out.withColumn("copies", F.floor(F.col("rate") + coin(F.col("doc_id"))).cast("int")).withColumnRenamed("doc_id", ident)


def coin(ident):
    """A fixed number in [0, 1) for an id."""
    return F.pmod(F.xxhash64(ident, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)



def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, near: float = NEAR, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` as mixed: each row as many times as `mix` gives copies, its columns unchanged; no text is shuffled.

    Null and empty texts, ties, repeated rows, null ids, empty tables and missing labels are as in `mix`; other columns are
    passed on, whatever their names.
    """
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    lexicon, model, rows = _classifier(plain, labels)
    members = written(posteriors(rows, model, ("doc_id", "n_tokens")), "membership")
    steps, _, _ = solve(members, targets or TARGETS, near)
    drop(rows, members)
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, toss = batch.column(place), np.asarray(batch.column(batch.num_columns - 1))
            copies = np.floor(rate(model.posterior(_vector(column, shared.value)[0]), steps) + toss).astype(np.int64)
            yield batch.select(range(batch.num_columns - 1)).take(pa.array(np.repeat(np.arange(len(batch)), copies)))

    return docs.withColumn("_toss_of_mixed", coin(F.col(ident))).mapInArrow(run, docs.schema)
