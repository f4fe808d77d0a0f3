"""Texts that are handled in pieces give what whole texts give."""

import random

import numpy as np
import pyarrow as pa
import pytest

from treeline.llm import gaussian, lines, toxicity


def texts(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["bad", "worse", "good", "fine", "the", f"w{r.randrange(30)}", "Mixed,", "42", "é!"])
    out = [None, "", "one", "  \n\n "]
    for _ in range(12):
        out.append("".join(word() + r.choice([" ", " ", "\n", "\n\n", "\t"]) for _ in range(r.randrange(1, 120))))
    out.append("same line here\n" * 40)
    return out


@pytest.mark.parametrize("limit", [7, 40, 300])
def test_statistics_do_not_depend_on_pieces(monkeypatch, limit):
    column = pa.array(texts(limit), pa.string())
    whole = gaussian.statistics(column)
    monkeypatch.setattr(gaussian, "PIECE", limit)
    assert np.allclose(gaussian.statistics(column), whole, atol=1e-12)


def test_statistics_against_plain_counts():
    from collections import Counter

    for text, x in zip(texts(1), gaussian.statistics(pa.array(texts(1), pa.string()))):
        words = (text or "").encode().lower().split()
        odds = lambda a, b: np.log((a + 0.5) / (max(b - a, 0) + 0.5))
        names = dict(zip(gaussian.FEATURES, x))
        raw = (text or "").encode()
        triples = list(zip(words, words[1:], words[2:]))
        lines = [tuple(p) for p in ((q.split()) for q in raw.lower().split(b"\n")) if p]
        assert np.isclose(names["log_words"], np.log1p(len(words))) and np.isclose(names["log_bytes"], np.log1p(len(raw)))
        assert np.isclose(names["distinct_words"], odds(len(set(words)), len(words)))
        assert np.isclose(names["distinct_triples"], odds(len(set(triples)), len(triples)))
        assert np.isclose(names["top_word"], odds(max(Counter(words).values(), default=0), len(words)))
        assert np.isclose(names["distinct_lines"], odds(len(set(lines)), len(lines)))
        assert np.isclose(names["newlines"], odds(raw.count(b"\n"), len(raw)))
        assert np.isclose(names["upper"], odds(sum(65 <= c <= 90 for c in raw), len(raw)))
        assert np.isclose(names["digits"], odds(sum(48 <= c <= 57 for c in raw), len(raw)))
        assert np.isclose(names["not_ascii"], odds(sum(c >= 128 for c in raw), len(raw)))
        assert np.isclose(names["short_words"], odds(sum(len(w) <= 3 for w in words), len(words)))


@pytest.mark.parametrize("limit", [7, 40, 300])
def test_passages_do_not_depend_on_pieces(limit):
    column = pa.array(texts(limit), pa.string())
    r = np.random.default_rng(limit)
    model = toxicity.Lexicon(r.normal(-0.3, 1.0, 1 << toxicity.BITS).astype(np.float32), 0.5, 0.1)
    whole, cut = toxicity.scan(column, model), toxicity.scan(column, model, limit)
    assert np.allclose(whole[0], cut[0]) and (whole[1] == cut[1]).all() and any(whole[2])
    assert [[(a, b) for a, b, _ in x] for x in whole[2]] == [[(a, b) for a, b, _ in x] for x in cut[2]]


@pytest.mark.parametrize("limit", [7, 40, 300, 1 << 19])
def test_words_of_lines_do_not_depend_on_pieces(limit):
    column = pa.array(texts(limit), pa.string())
    names, got = {}, []
    for h, doc, line in lines.line_words(column, limit):
        got += zip(doc.tolist(), line.tolist(), h.tolist())
    want = [(d, k, w) for d, t in enumerate(texts(limit)) for k, x in enumerate((t or "").encode().lower().split(b"\n")) for w in x.split()]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    for (_, _, h), (_, _, w) in zip(got, want):
        assert names.setdefault(h, w) == w


def test_masks_never_rule_out_a_similar_pair():
    r = np.random.default_rng(4)
    ruled = 0
    for _ in range(400):
        n = int(r.integers(60, 900))
        a = r.choice(1 << 40, n, replace=False).astype(np.uint64)
        kept = a[: int(n * r.uniform(0.1, 1.0))]
        b = np.concatenate((kept, r.choice(1 << 40, int(r.integers(0, n // 3 + 1)), replace=False).astype(np.uint64) + np.uint64(1 << 41)))
        x, y = (lines.sketches(np.sort(v), np.array([len(v)]))[0] for v in (a, b))
        if x is not None and y is not None:
            far = lines.far_apart(x, len(a), y, len(b))
            ruled += far
            assert not (far and len(kept) >= 0.8 * (len(a) + len(b) - len(kept)))
    assert ruled > 100
