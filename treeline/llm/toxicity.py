"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

A token's score is its log-odds between toxic and other training texts under Dirichlet priors (pseudo-counts in
proportion to class sizes, so that a token that nothing is known of scores nought), less a drift that makes a random
token's mean negative. A linear-time scan finds all maximal scoring segments of a text; a segment's significance
comes from extreme-value theory: with n tokens and score S, about K n exp(-lambda S) such segments arise by chance.
What a text's segments exceed chance by is added up, set against the Gumbel law that clean texts follow, and turned
into a probability by a one-variable logistic fit on training texts that the token counts have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, bounded_sample, labelled, remainder, words

BITS = 20  #: tokens are counted in 2^BITS cells, so that the model has one size for any vocabulary
SAMPLE = 60_000  #: labelled texts that the model is fitted on at most (those of the smallest id hash)
PRIOR = 1.0
DRIFT = 2.5
_SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Lexicon:
    """Cell scores and the Karlin-Altschul parameters of clean text."""

    score: np.ndarray
    lam: float
    k: float


@dataclass(frozen=True)
class Calibration:
    """Gumbel location and scale of clean texts, and the logistic fit on its reduced variate."""

    loc: float
    scale: float
    a: float
    b: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * (x - self.loc) / self.scale, -700, 700)))


def lexicon(toxic: np.ndarray, clean: np.ndarray, prior: float = PRIOR, drift: float = DRIFT) -> Lexicon:
    """From the cells' token counts in toxic and in other texts. Without counts of both classes every score is -drift."""
    n1, n0 = toxic.sum(), clean.sum()
    if not n1 or not n0:
        return Lexicon(np.full(len(toxic), -drift, np.float32), 1.0, 0.1)
    share = n1 / (n1 + n0)
    odds = np.log((toxic + prior * share) / (clean + prior * (1 - share))) - np.log(share / (1 - share))
    score = odds - drift
    weight = (clean + prior * (1 - share)) / (n0 + len(clean) * prior * (1 - share))
    mean = float((weight * score).sum())
    score = score - max(0.0, mean + drift / 2)
    low, high = 1e-3, 1.0  # lambda: the positive root of E[exp(lambda score)] = 1 over clean tokens
    value = lambda lam: float((weight * np.exp(np.minimum(lam * score, 500))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return Lexicon(score.astype(np.float32), high, 0.1)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), left to right, in linear time.

    Runs of tokens without a positive score only lower the running total, so the scan visits positive tokens alone. Ties
    go to the shorter segment; a text without a positive token has none.
    """
    total = np.concatenate(([0.0], np.cumsum(score, dtype=np.float64)))
    stack: list[list[float]] = []  # first, last + 1, total before, total after
    for i in np.flatnonzero(score > 0).tolist():
        now = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j -= 1
            if j < 0 or stack[j][3] >= now[3]:
                stack.append(now)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(int(a), int(b), float(d - c)) for a, b, c, d in stack]


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> _SHIFT).astype(np.int64)


def scan(column: pa.Array, model: Lexicon, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """Per text: evidence beyond chance, tokens, and significant segments as (first, last + 1, excess).

    Scores of a text that comes in several pieces are put together first, so that no segment ends at a cut.
    """
    n = len(column)
    count, evidence = np.zeros(n, np.int64), np.zeros(n)
    raw: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    held: list[np.ndarray] = []
    for w in words(column, limit=limit):
        held.append(model.score[_cells(w.hashes)])
        if not w.last:
            continue
        score, of = np.concatenate(held), np.concatenate((np.full(sum(map(len, held[:-1])), w.docs[0]), w.doc))
        held = []
        edges = np.flatnonzero(np.diff(of, prepend=-1, append=n + 1))
        hot = np.concatenate(([0], np.cumsum(score > 0)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d = int(of[a])
            if hot[b] > hot[a]:
                raw[d] = segments(score[a:b])
            count[d] = b - a
    for d in range(n):
        bar = np.log(max(model.k * count[d], 1.0))  # what chance reaches in so many tokens
        raw[d] = [(p, q, model.lam * s - bar) for p, q, s in raw[d] if model.lam * s > bar]
        evidence[d] = sum(x for _, _, x in raw[d])
    return evidence, count, raw


def count_cells(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of the cells for label 1 and label 0; 2^BITS small rows at most come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(2 << BITS, np.int64)
        total = flat.reshape(2, -1)
        for batch in batches:
            y = np.asarray(batch.column(0)).astype(np.int64)
            for w in words(batch.column(1)):
                np.add.at(flat, _cells(w.hashes) + (y[w.doc] << BITS), 1)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[1][at]), pa.array(total[0][at])], names=["cell", "toxic", "clean"])

    found = rows.select("label", "text").mapInArrow(run, "cell int, toxic long, clean long").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    out = np.zeros((2, 1 << BITS))
    cells = found["cell"].to_numpy()
    out[0][cells], out[1][cells] = found["toxic"].to_numpy(), found["clean"].to_numpy()
    return out[0], out[1]


def calibrate(evidence: np.ndarray, label: np.ndarray) -> Calibration:
    """Gumbel by moments on clean texts, then Newton steps for the logistic fit (with a weak prior on its slope)."""
    clean = evidence[label == 0]
    scale = max(float(clean.std()) * np.sqrt(6) / np.pi, 1e-3) if len(clean) > 1 else 1.0
    loc = float(clean.mean()) - 0.5772156649 * scale if len(clean) else 0.0
    x = np.column_stack([np.ones(len(evidence)), (evidence - loc) / scale])
    w = np.array([np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5)), 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - label) + np.array([0, 0.01]) * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.01])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return Calibration(loc, scale, float(w[0]), float(max(w[1], 0.0)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int | None = 3, held: int = 1) -> tuple[Lexicon, Calibration]:
    """From (doc_id, text) and labelled ids: a quarter, by id hash, is kept for the calibration, the rest gives token counts."""
    spark = docs.sparkSession
    ids = labelled(labels, "toxic")
    if fold:
        ids = ids.where(remainder(F.col("doc_id"), fold) != held)
    ids = bounded_sample(ids, sample)
    rows = docs.join(F.broadcast(ids), "doc_id")  # at most `sample` rows of 12 bytes
    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(4)) == 1
    model = lexicon(*count_cells(rows.where(~aside)))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, _, _ = scan(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(evidence)], names=["label", "x"])

    seen = rows.where(aside).select("label", "text").mapInArrow(run, "label int, x double").toArrow()  # at most `sample` rows
    return model, calibrate(seen["x"].to_numpy(), seen["label"].to_numpy())


def passages(docs: DataFrame, model: Lexicon, calibration: Calibration, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, score, n_tokens, passages (first and last + 1 token, excess over chance) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model, calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_, calibration_ = shared.value
        for batch in batches:
            evidence, count, found = scan(batch.column(1), lexicon_)
            spans = pa.array([[{"first": a, "last": b, "excess": x} for a, b, x in row] for row in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("excess", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calibration_.probability(evidence)), pa.array(count), spans], names=["doc_id", "score", "n_tokens", "passages"])

    source = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, score double, n_tokens long, passages array<struct<first:long,last:long,excess:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, fold: int = 3, held: int = 1, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= ``threshold``), n_tokens, passages for every row.

    Token counts and calibration come from labelled ids whose crc32 modulo ``fold`` is not ``held``, at most ``sample`` of
    them; ids with several labels count with the largest. Null or empty texts have no token, no passage and the lowest
    score. Repeated rows stay as they are; an empty table gives an empty result; other columns are ignored.
    """
    plain = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = passages(plain, *fit(plain, labels, sample, fold, held))
    return out.select(F.col("doc_id").alias(ident), (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_tokens", "passages")
