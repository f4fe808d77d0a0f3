"""The sampler in one process: against brute-force counts, its posterior by enumeration, and sums of predictive probabilities."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from treeline.llm import pitmanyor as m
from treeline.llm.seating import log_stirling

NONE = {f.name: None for f in m.RESTAURANT[1]}


def full(rows):
    return [NONE | r for r in rows]


class Local:
    """What the driver and the cluster do, in plain Python."""

    def __init__(self, chunks, held, buckets, hot, discounts=None, seed=5):
        self.buckets, self.hot = buckets, hot
        self.chunks = [m.Chunk(pa.array(t, pa.string()), buckets, hot) for t in chunks]
        requests = [r | {"chunk": k} for k, (c, h) in enumerate(zip(self.chunks, held)) for r in c.requests(np.array(h))]
        self.first = full(x for b in sorted({r["bucket"] for r in requests}) for x in m.merge([r for r in requests if r["bucket"] == b], buckets, hot))
        s = self.sums(self.first)
        get = lambda i: s.get(i, (0, 0))[0]
        trained = [int(i) for i in hot if int(i) in s]
        singles, repeated = np.array([s[i] for i in trained]).reshape(-1, 2).T
        d, d0 = discounts or (0.5, 0.6)
        self.c = m.Constants(int(get(m.TOKENS)), int(get(m.KNOWN)), d, d0, np.array(trained, np.uint64), singles, get(m.QUIET), get(m.QUIET_WORDS), seed=seed)
        self.root = m.Root.mean(self.c, get(m.ROOT) + (singles + repeated).sum(), singles + repeated)
        self.now, self.number = self.first, 0

    def sums(self, rows):
        out = {}
        for r in rows:
            if r["kind"] == m.SUM:
                v, g = out.get(r["id"], (0.0, 0.0))
                out[r["id"]] = v + r["value"], g + (r["gamma"] or 0.0)
        return out

    def of(self, rows):
        by = {}
        for r in rows:
            by.setdefault(r["bucket"], []).append(r)
        return by.values()

    def sweep(self):
        self.number += 1
        own = [r for r in self.first if r["kind"] == m.OWN]
        mail = [r for r in self.now if r["kind"] == m.MAIL]
        replies = full(x for g in self.of(mail + own) for x in m.reply(g, self.c, self.number))
        state = [r for r in self.now if r["kind"] == m.STATE]
        self.now = full(x for g in self.of(state + replies) for x in m.swept(g, self.c, self.root, self.number, self.buckets))
        s = self.sums(self.now)
        at_hot = self.c.hot_singles + np.array([s.get(int(i), (0, 0))[0] for i in self.c.hot])
        customers, gamma = s.get(m.GAMMA, (0.0, 0.0))
        self.root = m.Root.drawn(self.c, customers + self.c.quiet + at_hot.sum(), at_hot, gamma, self.number)

    def answers(self):
        rows = [r | {"sample": -1} for r in self.first if r["kind"] in (m.OWN, m.ASK)] + [r | {"sample": 0} for r in self.now if r["kind"] in (m.STATE, m.MAIL)]
        return [x for g in self.of(rows) for x in m.answers(g, self.c, [self.root])]

    def tables(self):
        """(word, context) -> tables of the repeated types."""
        out = {}
        for r in self.now:
            if r["kind"] == m.STATE:
                s = m.State.of(r, self.c.hot)
                out |= {(int(s.ids[w]), int(u)): int(t) for w, u, t in zip(s.word, s.context, s.tables)}
        return out


def ids(text):
    return m.stream(pa.array([text]))[0].tolist()


def corpus(seed, n=60):
    r = random.Random(seed)
    texts = [" ".join(r.choice("a b c d e f g h".split()) if r.random() < 0.8 else f"w{r.randrange(50)}" for _ in range(r.randrange(0, 25))) for _ in range(n)]
    return [texts[:20], texts[20:45], texts[45:]], [[r.random() < 0.2 for _ in p] for p in (texts[:20], texts[20:45], texts[45:])]


@pytest.mark.parametrize("buckets,hot_words", [(1, ""), (3, ""), (4, "a c"), (7, "a b c zz")])
def test_counts_and_predictive_sums(buckets, hot_words):
    chunks, held = corpus(buckets)
    hot = np.array(sorted({*ids(hot_words)}), np.uint64) if hot_words else np.zeros(0, np.uint64)  # the end token too
    run = Local(chunks, held, buckets, hot)
    count, words, openers = Counter(), Counter(), Counter()
    for part, flags in zip(chunks, held):
        for t, h in zip(part, flags):
            if not h:
                seq = ids(t)
                count.update(zip(seq, [m._START, *seq[:-1]]))
                words.update(seq)
                openers.update([m._START, *seq[:-1]])
    assert (run.c.tokens, run.c.known) == (sum(words.values()), len(words))
    for _ in range(3):
        run.sweep()
        t = run.tables()
        assert set(t) == {k for k, n in count.items() if n > 1} and all(1 <= t[k] <= count[k] for k in t)
        at_root = Counter()
        for (w, u), n in count.items():
            at_root[w] += t.get((w, u), 1)
        assert run.root.customers == sum(at_root.values())
    c = run.c
    p0 = {w: (n - c.root_discount) / (c.strength + run.root.customers) for w, n in at_root.items()}
    new = c.new / (c.strength + run.root.customers)
    assert abs(sum(p0.values()) + new - 1) < 1e-9
    opened = Counter()
    for (w, u), n in count.items():
        opened[u] += t.get((w, u), 1)
    predict = lambda w, u: ((count[w, u] - c.discount * t.get((w, u), 1) if count[w, u] else 0) + (c.strength + c.discount * opened[u]) * p0.get(w, new)) / (c.strength + openers[u])
    for u in openers:
        assert abs(sum(predict(w, u) for w in words) + predict(None, u) - 1) < 1e-9
    found = run.answers()
    for k, part in enumerate(chunks):
        got, base, known = m.log_scores(run.chunks[k], [r for r in found if r["chunk"] == k], c, [run.root])
        for i, text in enumerate(part):
            seq = ids(text)
            assert abs(got[i] - sum(math.log10(predict(w, u)) for w, u in zip(seq, [m._START, *seq[:-1]]))) < 1e-9
            assert abs(base[i] - sum(math.log10((words[w] + 1) / (c.tokens + c.known + 1)) for w in seq)) < 1e-9
            assert known[i] == sum(words[w] > 0 for w in seq)


def test_sweeps_settle_on_the_posterior():
    """Mean table counts against the enumerated posterior of a tiny corpus, with one word dealt by context."""
    chunks, d, d0 = [["a b a b a b", "b a a", "a a a b"], ["c a c a", "b b b b"]], 0.5, 0.6
    hot = np.array(sorted(set(ids("b"))), np.uint64)
    run = Local(chunks, [[False] * 3, [False] * 2], 3, hot, (d, d0))
    count = Counter()
    for t in itertools.chain(*chunks):
        seq = ids(t)
        count.update(zip(seq, [m._START, *seq[:-1]]))
    many = sorted(k for k, n in count.items() if n > 1)
    stirling = log_stirling(d)
    mean, total = np.zeros(len(many)), 0.0
    for t in itertools.product(*(range(1, count[k] + 1) for k in many)):
        now = dict(zip(many, t))
        context, word = Counter(), Counter()
        for w, u in count:
            context[u] += now.get((w, u), 1)
            word[w] += now.get((w, u), 1)
        log = sum(n * math.log(d) + math.lgamma(1 / d + n) for n in context.values()) + sum(math.lgamma(n - d0) for n in word.values()) - math.lgamma(1 + sum(word.values())) + sum(stirling[count[k], now[k]] for k in many)
        mean, total = mean + math.exp(log) * np.array(t), total + math.exp(log)
    mean = mean / total
    seen = np.zeros(len(many))
    for k in range(4000):
        run.sweep()
        t = run.tables()
        if k >= 100:
            seen += [t[x] for x in many]
    assert np.abs(seen / 3900 - mean).max() < 0.06, (seen / 3900, mean)
