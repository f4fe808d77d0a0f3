import hashlib
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import suffixes as s


def brute(texts, w):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - w + 1):
            seen.setdefault(t[i : i + w], []).append((d, i))
    out = []
    for d, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if len(seen[t[i : i + w]]) > 1:
                gone[i : i + w] = b"\1" * w
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcd é") for _ in range(r.randrange(0, 90))) for _ in range(12)]
    texts = [None, "", "ab", "a" * 70, base[0], base[0], "ababab" * 9]
    for _ in range(25):
        parts = []
        for _ in range(r.randrange(1, 4)):
            t = r.choice(base)
            a = r.randrange(0, len(t) + 1)
            parts.append(t[a : a + r.randrange(0, 60)])
        texts.append("".join(parts))
    return texts


@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_merge_and_front_code(runs):
    runs = [sorted(r) for r in runs]
    coded = [s.front_decode(s.front_code(r)[0].astype(int), s.front_code(r)[1]) for r in runs]
    assert [c[0] for c in coded] == runs
    got = list(s.merge(coded))
    strings = [runs[r][p] for r, p, _ in got]
    assert strings == sorted(x for r in runs for x in r)
    for (_, _, c), a, b in zip(got[1:], strings, strings[1:]):
        assert c == s.common_prefix(a, b)


def test_anchor_of_every_window_and_equal_windows_agree():
    texts = [t.encode() for t in corpus(3) if t]
    found = {}
    for doc, place, h in s.anchors(pa.array([t.decode() for t in texts]), 12, 4):
        found.update(zip(zip(doc.tolist(), place.tolist()), h.tolist()))
    offsets = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 11):
            mine = [(found[d, p], p - i) for p in range(i, i + 9) if (d, p) in found]
            assert mine
            offsets.setdefault(t[i : i + 12], set()).add(min(mine)[0])
    assert all(len(x) == 1 for x in offsets.values())


def test_against_brute_force(spark, monkeypatch):
    for seed, w, k, passage, size in ((1, 12, 4, 12, 12 << 20), (2, 20, 8, 13, 12 << 20), (4, 12, 12, 12, 12 << 20), (5, 20, 6, 9, 3000)):
        monkeypatch.setattr(s, "PART_BYTES", size)  # the last one merges many runs in many parts
        monkeypatch.setattr(s, "RUN_BYTES", size // 8)
        texts = corpus(seed)
        docs = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
        rows = s.remove_repeats(docs, w, k, passage=passage).collect()
        want = brute([(t or "").encode() for t in texts], w)
        assert sorted(((r.doc_id or -1), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(((i if i % 9 else -1) or -1, *x) for i, x in enumerate(want))
        shared = brute([(t or "").encode() for t in texts], passage)
        assert sorted(((r.doc_id or -1), r.n_bytes, r.n_shared) for r in rows) == sorted(((i if i % 9 else -1) or -1, x[0], x[1]) for i, x in enumerate(shared))


def test_long_text_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(s, "PIECE", 64)
    texts = corpus(7) + ["".join(random.Random(5).choice("abc") for _ in range(700))]
    found = [(int(d), int(p)) for doc, place, _ in s.anchors(pa.array(texts), 12, 4) for d, p in zip(doc, place)]
    monkeypatch.setattr(s, "PIECE", 1 << 21)
    assert sorted(set(found)) == sorted((int(d), int(p)) for doc, place, _ in s.anchors(pa.array(texts), 12, 4) for d, p in zip(doc, place))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abcabcdefxyz" * 3), (1, "abcabcdefxyz" * 3), (2, None)], "doc_id long, text string")
    rows = s.remove_repeats(docs, 12, 4).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in rows) == [(1, 36, 1), (1, 36, 1), (2, 0, 0)]
    assert s.remove_repeats(docs.limit(0), 12, 4).collect() == []
