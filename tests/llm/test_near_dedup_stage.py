"""The near-dedup stage gets its groups from op10's fingerprints; pairs of similar shingle sets beyond their distance join them."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from treeline.llm import simhash, wide


def brute(rows, similarity=0.8, distance=2):
    h, doc = wide.shingle_hashes(pa.array([t for _, t in rows]), 5)
    sets = [set(h[doc == k].tolist()) for k in range(len(rows))]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_bits, by_sets = set(), set()
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            pair = (rows[j][0], a)
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                by_bits.add(pair)
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                by_sets.add(pair)
            if pair in by_bits | by_sets:
                x, y = find(a), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}, by_bits, by_sets


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 7)))
    rows = []
    for k in range(12):
        w = [word() for _ in range(r.randrange(60, 200))]
        edit = [word() for _ in range(6)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w).upper()), (10 * k + 2, " ".join(w[:-6] + edit)), (10 * k + 3, " ".join(w[:-9] + edit + w[-3:]))]
    for k in range(6):  # one run of words most of the time: equal fingerprints, few common shingles among the distinct ones
        rows += [(200 + 10 * k + i, " ".join([word()] + [f"tick{k}"] * 300 + [word() for _ in range(12)])) for i in range(3)]
    rows += [(400 + k, " ".join(word() for _ in range(80))) for k in range(10)]
    return rows


@pytest.mark.parametrize("pairs_to,tile", [(4, 1024), (1, 4)])
def test_known_groups_are_taken_in(spark, pairs_to, tile):
    rows = texts()
    want, by_bits, by_sets = brute(rows)
    assert by_bits - by_sets and by_sets - by_bits and by_bits & by_sets
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = simhash.near_duplicates(df).select("doc_id", "component_id")
    assert {x.doc_id: x.component_id for x in wide.similar_groups(df, pairs_to=pairs_to, tile=tile, groups=groups).collect()} == want


def test_stage_against_brute_force(spark):
    rows = texts()
    want = brute(rows)[0]
    odd = [(None, rows[0][1]), (None, ""), (500, ""), (501, None), (502, " \n")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(3)
    kept = sorted((x.doc_id is None, x.doc_id or 0) for x in corpus_pipeline.simhash_near_dedup(spark, df, "").collect())
    assert kept == sorted([(False, d) for d in {*want.values(), 500}] + [(True, 0)] * 2)
    assert corpus_pipeline.simhash_near_dedup(spark, df.limit(0), "").collect() == []
