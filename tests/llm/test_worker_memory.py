"""What an executor holds in the pipeline: one Python worker a task, and no sort of all keys of the near-dedup stage."""

import random
import re

from treeline.llm import gaussian, wide


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_has_one_python_node_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words of text number {k} " * (1 + k % 3)) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    seen, moments = [], gaussian.moments
    monkeypatch.setattr(gaussian, "moments", lambda rows, size: seen.append(plan(rows)) or moments(rows, size))
    gaussian.accepted(docs, labels).collect()
    assert len(seen) == 1 and "InArrow" not in seen[0]


def test_keys_are_neither_sorted_nor_moved_for_leaders(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(80)]
    rows = [(k, " ".join(base[:-3] + [word() for _ in range(3)])) for k in range(12)] + [(20 + k, " ".join(word() for _ in range(40))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, written = {}, wide.written
    monkeypatch.setattr(wide, "written", lambda df, name: plans.setdefault(name, plan(df)) and written(df, name))
    found = {x.doc_id: x.component_id for x in wide.similar_groups(docs).collect()}
    assert found == {k: 0 for k in range(12)} | {20 + k: 20 + k for k in range(8)}
    assert "SortAggregate" not in plans["wide-keys"] and not re.search(r"Aggregate\(keys=\[[^\]]*\bkey#", plans["wide-prefixes"])


def test_an_id_that_repeats_keys(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    same = [(7, " ".join(base[:-1] + [f"end{k}"])) for k in range(9)]  # one id, many texts of the same keys
    rows = same + [(3, " ".join(base)), (9, " ".join(reversed(base)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for pairs_to, tile in ((4, 1024), (1, 4)):
        got = wide.similar_groups(docs, pairs_to=pairs_to, tile=tile).collect()
        assert {x.doc_id: x.component_id for x in got} == {3: 3, 7: 3, 9: 9}
