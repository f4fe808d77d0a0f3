"""Operators 2, 3 and 7: brute force, edge cases and held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from treeline.llm import common, lines, pitmanyor, seating, toxicity

EDGE = [(1, None), (2, ""), (None, "a b c d"), (3, "Same text here"), (3, "Same text here"), (4, "same TEXT  here"), (5, "w " * 3000), (6, "\n\t \x0b"), (7, "é ü 漢字 🙂")]


# ---------------------------------------------------------------- words


@pytest.mark.parametrize("limit", [1, 3, 7, 1 << 19])
def test_words_equal_split(limit):
    r = random.Random(limit)
    texts = [None if r.random() < 0.1 else "".join(r.choice("ab AB\t\n\x0béü ") for _ in range(r.randrange(0, 40))) for _ in range(60)]
    got, names = [[] for _ in texts], {}
    for w in common.words(pa.array(texts), limit=limit):
        for h, d, a, b in zip(w.hashes, w.doc, w.start, w.end):
            word = bytes(w.data[a:b]).lower()
            got[d].append(word)
            assert names.setdefault(h, word) == word
    assert got == [(t or "").encode().lower().split() for t in texts]


# ---------------------------------------------------------------- Pitman-Yor


def test_stirling_numbers_against_recursion_by_enumeration():
    d = 0.3

    def weight(n, t):  # sum over set partitions of n into t blocks of the product of rising factorials
        if n == 0:
            return 1.0 if t == 0 else 0.0
        return sum(math.comb(n - 1, k - 1) * math.prod(j - d for j in range(1, k)) * weight(n - k, t - 1) for k in range(1, n + 1)) if t else 0.0

    table = seating.log_stirling(d, 7)
    for n, t in itertools.product(range(1, 8), range(1, 8)):
        assert (t > n and table[n, t] == -np.inf) or abs(math.exp(table[n, t]) - weight(n, t)) < 1e-9 * max(1, weight(n, t))


def test_table_draws_follow_their_law():
    d, a, c, n = 0.4, 0.7, 5, 40000
    table = seating.log_stirling(d)
    got = np.bincount(seating.draw_tables(np.full(n, c), np.full(n, a), d, table, np.random.default_rng(1)), minlength=c + 1)[1:] / n
    p = np.exp(table[c, 1 : c + 1] + np.log(a) * np.arange(1, c + 1))
    assert np.abs(got - p / p.sum()).max() < 0.02
    big = seating.draw_tables(np.array([1, 0, 5000]), np.array([1.0, 1.0, 50.0]), d, table, np.random.default_rng(1))
    assert big[0] == 1 and big[1] == 0 and 1 <= big[2] <= 5000


def test_scores(spark):
    r = random.Random(5)
    docs = [(k, " ".join(r.choice(["The", "the", "cat", "sat", f"w{r.randrange(40)}"]) for _ in range(r.randrange(0, 60)))) for k in range(150)] + EDGE
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, bucket int").repartition(3)
    rows = pitmanyor.score(df, bucket_bytes=2000, chunk_bytes=1500).collect()
    assert len(rows) == len(docs)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in docs)
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in rows) == want
    assert all(x.score < 0 and x.perplexity > 1 for x in rows)
    again = pitmanyor.score(df, bucket_bytes=2000, chunk_bytes=1500).collect()
    assert Counter((x.doc_id, round(x.score, 9)) for x in again) == Counter((x.doc_id, round(x.score, 9)) for x in rows)
    assert pitmanyor.score(df.limit(0)).collect() == []


def test_better_than_the_base_on_held_out_texts(spark):
    rows = pitmanyor.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


# ---------------------------------------------------------------- toxicity


def brute_segments(score):
    """Ruzzo and Tompa's definition: the best segment (shortest on ties), then the same left and right of it."""
    best = None
    for i in range(len(score)):
        for j in range(i + 1, len(score) + 1):
            s = sum(score[i:j])
            if s > 1e-9 and (best is None or s > best[2] + 1e-9 or (abs(s - best[2]) <= 1e-9 and j - i < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(score[:i]) + [best] + [(a + j, b + j, c) for a, b, c in brute_segments(score[j:])]


def test_segments_against_brute_force():
    r = random.Random(1)
    for _ in range(120):
        score = [r.choice([-3, -1, -0.5, 0.7, 1.9, 4.1]) + r.random() * 1e-3 for _ in range(r.randrange(0, 14))]
        got = toxicity.segments(np.array(score))
        want = brute_segments(score)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_edges_and_passages(spark):
    r = random.Random(3)
    text = lambda toxic: " ".join(r.choice(["vile", "scum"]) if toxic and r.random() < 0.2 else f"w{r.randrange(300)}" for _ in range(80))
    docs = [(k, text(k % 4 == 0)) for k in range(10, 800)] + EDGE
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(10, 800)] + [(None, 1, 1), (11, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    held = [d for d in range(10, 800) if rows[d].held_out]
    assert np.mean([rows[d].predicted == int(d % 4 == 0) for d in held]) > 0.95
    words_of = dict(docs)
    for d in held[:50]:
        for p in rows[d].passages:
            assert {"vile", "scum"} & set(words_of[d].split()[p["first"] : p["last"]])
    assert rows[1].score == rows[2].score <= min(r.score for r in rows.values()) + 1e-9 and rows[1].passages == []
    assert toxicity.toxicity(df.limit(0), labels).collect() == []
    assert len(toxicity.toxicity(df, labels.limit(0)).collect()) == len(docs)


# ---------------------------------------------------------------- lines


def brute_lines(docs):
    sets = [(d if d is not None else 1 << 62, i, frozenset(x.translate(str.maketrans(lines._UPPER, lines._LOWER)).split(" ")) - {""}) for d, t in docs for i, x in enumerate((t or "").split("\n"))]
    out = {}
    for d, i, s in sets:
        out.setdefault(d, []).append(bool(s) and any((e, j) < (d, i) and 5 * len(s & u) >= 4 * len(s | u) for e, j, u in sets if u))
    return out


@pytest.mark.parametrize("hot", [48, 1])
def test_line_join_against_brute_force(spark, hot):
    r = random.Random(hot)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randrange(1, 22))] for _ in range(25)]
    docs = []
    for k in range(60):
        text = []
        for _ in range(r.randrange(1, 6)):
            line = list(r.choice(base))
            for _ in range(r.randrange(0, 4)):
                line[r.randrange(len(line))] = r.choice(["the", "OF", f"w{r.randrange(60)}"])
            text.append(" ".join(line) if r.random() > 0.05 else "")
        docs.append((k, "\n".join(text)))
    docs += [(100, None), (101, ""), (None, docs[3][1]), (102, "a\tB  c\n\nA b C")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, line int")
    want = brute_lines(docs)
    rows = lines.line_duplicates(df, hot=hot).collect()
    assert {(x.doc_id if x.doc_id is not None else 1 << 62): [i in x.removed for i in range(x.n_lines)] for x in rows} == want
    kept = {x.doc_id: x.text for x in lines.without_duplicates(df.where("doc_id IS NOT NULL")).collect()}
    assert kept[102] in ("a\tB  c\n", "")


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c\na b c"), (1, "a b c\na b c"), (2, "A b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in lines.line_duplicates(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 1, 1)]
    assert lines.line_duplicates(df.limit(0)).collect() == []
