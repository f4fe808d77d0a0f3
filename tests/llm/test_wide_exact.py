"""Near-dedup links exactly the pairs at the stated Jaccard similarity: no pair is missed, none below is linked."""

import random

import pyarrow as pa
import pytest

from treeline.llm import wide


def brute(rows, similarity):
    h, doc = wide.shingle_hashes(pa.array([t for _, t in rows]), 5)
    sets = [set(h[doc == k].tolist()) for k in range(len(rows))]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                x, y = find(a), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("pairs_to,tile", [(64, 1024), (1, 1024), (1, 8)])
def test_groups_against_brute_force(spark, pairs_to, tile):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 7)))
    rows = []
    for k in range(60):  # similarities around 0.8
        w = [word() for _ in range(r.randrange(20, 260))]
        cut = r.uniform(0.86, 0.92)  # the head's share at Jaccard near 0.8
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[: int(cut * len(w))] + [word() for _ in range(len(w) - int(cut * len(w)))]))]
    common = " ".join(word() for _ in range(60))  # one passage that many dissimilar texts share, and near copies of one text
    rows += [(1000 + k, common + " " + " ".join(word() for _ in range(r.randrange(5, 120)))) for k in range(30)]
    got = {x.doc_id: x.component_id for x in wide.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), pairs_to=pairs_to, tile=tile).collect()}
    want = brute(rows, 0.8)
    assert got == want
    assert 10 < sum(want[10 * k + 1] == 10 * k for k in range(60)) < 50


def test_sample_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((x.doc_id, x.text) for x in docs.collect())
    assert {x.doc_id: x.component_id for x in wide.similar_groups(docs).collect()} == brute(rows, 0.8)
