"""Operators 1, 4, 6, 8, 10, their edge cases, and the pipeline."""

import random

import numpy as np
import pytest

from treeline.llm import components, decontaminate, gaussian, mixing, sharding, simhash, wide

EDGE = [(1, None, "x"), (2, "", "x"), (None, "a b c d", "x"), (3, "Same text here", "x"), (3, "Same text here", "x"), (4, "same TEXT  here", "x"), (5, "w " * 30000, "x"), (6, "\n\t \x0b", "x"), (7, "é ü 漢字 🙂", "x")]


@pytest.fixture(scope="module")
def edge(spark):
    # clashing and odd extra columns
    return spark.createDataFrame([(*r, 1, 2) for r in EDGE], "doc_id long, text string, fp string, label int, shard int")


@pytest.fixture(scope="module")
def labels(spark):
    r = random.Random(2)
    return spark.createDataFrame([(k, r.randrange(2), r.randrange(2)) for k in range(1, 8)] + [(1, None, 1), (None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- sharding


def test_shards(spark, edge):
    docs = spark.createDataFrame([(k, "x" * (k * 37 % 500)) for k in range(3000)], "doc_id long, text string")
    rows = sharding.assign(docs, 7, slots=512).collect()
    assert len(rows) == 3000
    size = [sum(r["size"] for r in rows if r.shard == s) for s in range(7)]
    assert max(size) <= 1.01 * min(size)
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    out = sharding.assign(edge, 4).collect()
    assert len(out) == len(EDGE) and sorted(r["size"] for r in out)[:2] == [1, 1]
    assert sharding.assign(edge.limit(0), 4).collect() == []


def test_map_versions(spark, tmp_path):
    weight = [random.Random(k).randrange(1000) for k in range(256)]
    first = sharding.first_map(5, 256)
    even = sharding.rebalance(first, weight)
    grown = sharding.grow(even, weight)
    for m in (first, even, grown):
        m.store(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown and sharding.SlotMap.load(spark, str(tmp_path / "map"), 2) == even
    load = [sum(w for w, s in zip(weight, even.shard_of) if s == k) for k in range(5)]
    assert max(load) <= 1.01 * min(load)
    moved = {(a, b) for a, b in zip(even.shard_of, grown.shard_of) if a != b}
    assert {b for _, b in moved} == {5}
    share = sum(w for w, s in zip(weight, grown.shard_of) if s == 5)
    assert abs(share - sum(weight) / 6) < 0.05 * sum(weight)


# ---------------------------------------------------------------- SimHash


def brute_components(prints, distance):
    above = list(range(len(prints)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                above[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("distance,pairs_to", [(0, 64), (1, 64), (2, 64), (1, 1), (2, 1), (2, 3)])
def test_links_against_brute_force(spark, distance, pairs_to):
    r = random.Random(distance + pairs_to)
    prints = {r.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        for _ in range(8):
            q = p
            for _ in range(r.randrange(1, 4)):
                q ^= 1 << r.randrange(64)
            prints.add(q)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.links(df, distance, pairs_to)
    for a, b in found.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= distance
    for one_task in (10**6, 0):
        root = {x.node: x.root for x in components.connected_components(found, one_task=one_task).collect()}
        mine = {}
        for p in signed:
            mine.setdefault(root.get(p, p), set()).add(p)
        theirs = {}
        for p, k in zip(signed, brute_components(prints, distance)):
            theirs.setdefault(k, set()).add(p)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_fingerprints_of_edges(spark, edge):
    rows = {(r.doc_id, r.fingerprint): r for r in simhash.near_duplicates(edge).collect()}
    assert rows[1, "0" * 16].component_id == 1 == rows[2, "0" * 16].component_id == rows[6, "0" * 16].component_id
    same = {r.component_id for (d, _), r in rows.items() if d in (3, 4)}
    assert same == {3}
    assert simhash.near_duplicates(edge.limit(0)).collect() == []


def test_wide_groups(spark, edge):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    docs, base = [], [[word() for _ in range(r.randrange(80, 300))] for _ in range(40)]
    for k, w in enumerate(base):
        docs.append((10 * k, " ".join(w)))
        docs.append((10 * k + 1, " ".join(w).upper()))
        edited = list(w)
        edited[len(w) // 2] = word()
        docs.append((10 * k + 2, " ".join(edited)))
        docs.append((10 * k + 3, " ".join(w[: len(w) // 2] + [word() for _ in range(100)])))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, id int").repartition(3)
    for pairs_to, tile in ((64, 1024), (1, 1024), (1, 2)):
        got = {x.doc_id: x.component_id for x in wide.similar_groups(df, pairs_to=pairs_to, tile=tile).collect()}
        assert all(got[10 * k] == got[10 * k + 1] == 10 * k and got[10 * k + 3] == 10 * k + 3 for k in range(40))
        assert sum(got[10 * k + 2] == 10 * k for k in range(40)) >= 38
    kept = wide.keep_one(edge).collect()
    assert sorted((x.doc_id or 0) for x in kept) == [0, 1, 3, 5, 7] and kept[0].asDict().keys() == {"doc_id", "text", "fp", "label", "shard"}
    assert wide.keep_one(edge.limit(0)).collect() == []


def test_wide_prints_against_brute_force():
    import pyarrow as pa

    from treeline.llm.common import mix

    texts = ["a b c d e f g", "x y", "", None, " ".join(str(k % 700) for k in range(1500))]
    prints = wide.fingerprints_of(pa.array(texts), 5)
    h, doc = wide.shingle_hashes(pa.array(texts), 5)
    for d, t in enumerate(texts):
        w = (t or "").split()
        assert (doc == d).sum() == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else [])
        for k in (0, 7, 15):
            x = [int(v) for v in mix(h[doc == d] ^ wide._SALTS[k])]
            assert int(prints[d, k]) == sum((2 * sum(v >> b & 1 for v in x) > len(x)) << b for b in range(64))
    import functools

    whole = wide.shingle_hashes(pa.array(texts), 5)
    words, wide.words = wide.words, functools.partial(wide.words, limit=9)
    cut = wide.shingle_hashes(pa.array(texts), 5)
    wide.words = words
    assert all((a == b).all() for a, b in zip(whole, cut))


# ---------------------------------------------------------------- decontamination


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_score_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 14))] for _ in range(2))
        got = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got[0] == smith_waterman(a, b)
        assert got[0] == smith_waterman(a[got[1] : got[2]], b[got[3] : got[4]])


def test_copies_edits_and_clean_texts(spark, edge):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(25))) for k in range(20)] + [(90, None), (91, ""), (92, "tiny item")]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = []
    for k in range(20):
        w = items[k][1].split()
        docs.append((100 + k, f"{noise(50)} {items[k][1].upper()} {noise(40)}"))
        edited = [x if i % 6 else word() for i, x in enumerate(w)]
        docs.append((200 + k, f"{noise(20)} {' '.join(edited)} {noise(9)}"))
        docs.append((300 + k, f"{noise(20)} {' '.join(w[:11] + [word(), word()] + w[11:])} {noise(9)}"))
        docs.append((400 + k, noise(120)))
        docs.append((500 + k, f"{noise(20)} {' '.join(w[:6])} {noise(60)}"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(df, bench).collect()}
    assert pairs == {(h + k, k) for k in range(20) for h in (100, 200, 300)}
    kept = {x.doc_id for x in decontaminate.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs if d >= 400}
    assert decontaminate.clean(edge, bench).count() == len(EDGE)
    assert decontaminate.contaminated(df.limit(0), bench).collect() == [] == decontaminate.contaminated(df, bench.limit(0)).collect()


def test_passage_across_pieces(spark, monkeypatch):
    from functools import partial

    item = " ".join(f"word{k}" for k in range(30))
    text = " ".join(f"pad{k}" for k in range(500)) + " " + item + " " + " ".join(f"end{k}" for k in range(300))
    import pyarrow as pa

    hashes = decontaminate._hashes([item])
    vocabulary = np.unique(hashes[0])
    model = decontaminate.seeds([1], hashes, vocabulary, np.ones(len(vocabulary)), 1000)
    whole = decontaminate._matches(pa.array([text]), model, 0.5)
    monkeypatch.setattr(decontaminate, "exact_words", partial(decontaminate.exact_words, limit=64))
    assert decontaminate._matches(pa.array([text]), model, 0.5) == whole and len(whole) == 1


# ---------------------------------------------------------------- quality


def test_posterior_against_the_formula():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(80, 3)), r.normal(2, 3, size=(50, 3))])
    y = np.repeat([0, 1], [80, 50])
    found = {k: (float((y == k).sum()), x[y == k].sum(0), x[y == k].T @ x[y == k]) for k in (0, 1)}
    model = gaussian.fit(found, (0, 1), 3, pooled=0.3, ridge=0.05)
    within = sum((x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in (0, 1)) / len(x)
    logs = []
    for k in (0, 1):
        own = np.cov(x[y == k].T, bias=True)
        cov = 0.95 * (0.7 * own + 0.3 * within) + 0.05 * np.diag(np.diag(within))
        d = x - x[y == k].mean(0)
        logs.append(np.log((y == k).sum() + 0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert np.allclose(model.posterior(x)[:, 1], want, atol=1e-6)


def test_quality_edges(edge, labels):
    rows = gaussian.quality(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert gaussian.quality(edge.limit(0), labels).collect() == []
    assert {r.score for r in gaussian.quality(edge, labels.limit(0)).collect()} == {0.5}
    assert gaussian.accepted(edge, labels.limit(0)).count() == len(EDGE)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = gaussian.quality(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


# ---------------------------------------------------------------- mixing


def test_rates_meet_targets_and_stay_near_one(spark):
    r = np.random.default_rng(3)
    p = r.dirichlet([0.3, 0.6, 0.2], 400)
    n = r.integers(1, 900, 400)
    members = spark.createDataFrame([(k, int(n[k]), [float(v) for v in p[k]]) for k in range(400)], "doc_id long, n_tokens long, p array<double>")
    targets = {"low": 0.1, "clean": 0.8, "toxic": 0.1}
    steps, reached, goal = mixing.solve(members, targets, near=1e-3, most=400)
    rate = mixing.rate(p, steps)
    assert (rate >= 0).all() and np.allclose((n * rate) @ p, reached)
    # against a dense projected gradient on the same objective
    want, t = np.ones(400), n.sum()
    w = np.array([0.1, 0.8, 0.1])
    for _ in range(20000):
        g = p @ ((n * want) @ p / t - w) + 1e-3 * (want - 1)
        want = np.maximum(0, want - 0.5 * g)
    value = lambda x: (((n * x) @ p / t - w) ** 2).sum() / 2 + 1e-3 * (n * (x - 1) ** 2).sum() / t / 2
    assert value(rate) <= value(want) * 1.02 + 1e-9 and np.abs(goal - t * w).max() < 1e-6


def test_mix_edges(edge, labels):
    rows = mixing.mix(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(abs(r.p_low + r.p_clean + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    mixed = mixing.mixed(edge, labels).collect()
    assert len(mixed) == sum(r.copies for r in rows)
    assert mixing.mix(edge.limit(0), labels).collect() == []


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    for k, (_, stage) in enumerate(c.STAGES):
        before = docs
        docs = stage(spark, before, sf).cache()
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            texts = {(r.doc_id, r.text) for r in before.collect()}
            assert {(r.doc_id, r.text) for r in docs.collect()} <= texts
        if k == 1:  # brute force: one of each component, the smallest id
            import pyarrow as pa

            rows = sorted((r.doc_id, r.text) for r in before.collect())
            prints = [int.from_bytes(p.tobytes(), "little") for p in wide.fingerprints_of(pa.array([t for _, t in rows]))]
            least = {}
            for (d, _), root in zip(rows, brute_components(prints, wide.most_bits(0.8))):
                least.setdefault(root, d)
            kept = {r.doc_id for r in docs.collect()}
            assert set(least.values()) <= kept and len(kept) <= len(least) + 3  # a block may miss a pair near 0.8
    assert sorted(map(tuple, c.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))
    assert sizes[0] < 200 and sizes[-1] == sizes[-2] > 100


def test_slot_map_is_stored_and_edited(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * (k % 90)) for k in range(3000)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    first = sharding.assign(docs, 5, slots=256, map_path=path).collect()
    versions = spark.read.parquet(path).select("version").distinct().count()
    assert versions == 2 and {r.map_version for r in first} == {2}
    again = sharding.assign(docs, 5, slots=256, map_path=path).collect()  # nothing to move: no further version
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in first)
    more = spark.createDataFrame([(k, "y" * 400) for k in range(3000, 3400)], "doc_id long, text string").unionByName(docs)
    later = sharding.assign(more, 5, slots=256, map_path=path).collect()
    moved = {r.doc_id: r.shard for r in later}
    assert sum(moved[r.doc_id] != r.shard for r in first) < 0.5 * len(first)
    grown = sharding.assign(more, 6, slots=256, map_path=path).collect()
    assert {r.shard for r in grown} == set(range(6)) and {r.map_version for r in grown} > {2}.difference({2})
    sizes = [sum(r.size for r in grown if r.shard == s) for s in range(6)]
    assert max(sizes) < 1.1 * min(sizes)
    with pytest.raises(ValueError):
        sharding.assign(docs, 3, slots=256, map_path=path)
